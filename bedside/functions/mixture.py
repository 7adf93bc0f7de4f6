"""Column expressions over a mixture of logits: arrays ``pis`` (weights) and
``mus`` (logits), one entry per component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda z: F.exp(z - top))
    return F.transform(raised, lambda e: e / total(raised))


def bce_with_logits(logit: Column, y: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(total(F.transform(values, lambda v: F.exp(v - top))))


def mixture_probability(pis: Column, mus: Column) -> Column:
    return total(F.zip_with(pis, mus, lambda p, m: p * sigmoid(m)))


def binary_entropy(probability: Column) -> Column:
    """Entropy in bits; the probability is kept 1e-7 away from 0 and 1."""
    p = F.least(F.greatest(probability, F.lit(1e-7)), F.lit(1.0 - 1e-7))
    return -(p * F.log2(p) + (1.0 - p) * F.log2(1.0 - p))


def predictive_entropy(pis: Column, mus: Column) -> Column:
    return binary_entropy(mixture_probability(pis, mus))


def logit_variance(pis: Column, mus: Column) -> Column:
    mean = total(F.zip_with(pis, mus, lambda p, m: p * m))
    square = total(F.zip_with(pis, mus, lambda p, m: p * m * m))
    return F.greatest(F.lit(0.0), square - mean * mean)


def mixture_nll(pis: Column, mus: Column, y: Column) -> Column:
    """Negative log likelihood of one outcome, in nats."""
    terms = F.zip_with(pis, mus, lambda p, m: F.ln(p + 1e-8) - bce_with_logits(m, y))
    return -log_sum_exp(terms)


def decay_factor(gamma: Column, delta: Column) -> Column:
    return F.exp(-F.greatest(gamma, F.lit(0.0)) * delta)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def squared_distance(pairs: list[tuple[Column, Column]]) -> Column:
    """Squared distance over fixed columns, summed left to right."""
    return reduce(lambda x, y: x + y, [(a - b) * (a - b) for a, b in pairs])
