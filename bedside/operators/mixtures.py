"""A gated mixture of logistic models whose weights are learned: expectation
maximisation as grouped sums, one scan of the rows a step."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bedside.functions.mixture import bce_with_logits, sigmoid, softmax
from bedside.operators.ranking import one_row
from bedside.session import new_path

ENOUGH = 1e-7  # rise of the mean log likelihood at which steps end


@dataclass(frozen=True)
class Mixture:
    """Weights of the gate and of each part's logit, one row per part: a number per
    feature, then the shift."""

    features: tuple[str, ...]
    gate: np.ndarray
    parts: np.ndarray

    @staticmethod
    def start(features: list[str], parts: int, seed: int) -> "Mixture":
        """Small random weights; they depend on nothing but the seed."""
        draw = np.random.default_rng(seed)
        shape = parts, len(features) + 1
        return Mixture(tuple(features), draw.normal(0, 0.5, shape), draw.normal(0, 0.5, shape))


def _logits(weights: Column, model: Mixture) -> list[Column]:
    """A logit per part; ``weights`` holds the rows of the parts one after another."""
    inputs, width = [F.col(f) for f in model.features], len(model.features) + 1
    return [
        reduce(add, [x * F.get(weights, F.lit(k * width + i)) for i, x in enumerate(inputs)])
        + F.get(weights, F.lit(k * width + width - 1))
        for k in range(len(model.parts))
    ]


def _weights(rows: DataFrame, model: Mixture) -> Column:
    """The weights as a scalar subquery: plans of all steps have the same code, which
    is compiled once."""
    lists = [(model.gate.ravel().tolist(), model.parts.ravel().tolist())]
    return one_row(rows.sparkSession.createDataFrame(lists, "gate array<double>, parts array<double>"))


def with_mixture(rows: DataFrame, model: Mixture) -> DataFrame:
    """Add ``pis`` and ``mus``, the inputs of the mixture functions. Features must not
    be NULL."""
    weighted = rows.withColumn("_w", _weights(rows, model))
    return weighted.withColumns({
        "pis": softmax(F.array(*_logits(F.col("_w.gate"), model))),
        "mus": F.array(*_logits(F.col("_w.parts"), model)),
    }).drop("_w")


def responsibilities(rows: DataFrame, model: Mixture, label: str = "y") -> DataFrame:
    """The expectation step: per row ``fit``, the log likelihood of its outcome, and for
    each part k ``g<k>`` (gate), ``p<k>`` (probability of class 1) and ``r<k>`` (chance
    that the part made the outcome)."""
    ks = range(len(model.parts))
    out = rows.withColumn("_w", _weights(rows, model))
    out = out.withColumns(
        {f"_a{k}": a for k, a in zip(ks, _logits(F.col("_w.gate"), model))}
        | {f"_b{k}": b for k, b in zip(ks, _logits(F.col("_w.parts"), model))}
    ).drop("_w")

    def log_sum(names: list[str], most: str) -> Column:
        return F.col(most) + F.ln(reduce(add, [F.exp(F.col(n) - F.col(most)) for n in names]))

    def top(names: list[str]) -> Column:
        return F.greatest(*names) if len(names) > 1 else F.col(names[0])

    gates, joint = [f"_a{k}" for k in ks], [f"_l{k}" for k in ks]
    out = out.withColumn("_top", top(gates)).withColumn("_z", log_sum(gates, "_top"))
    out = out.withColumns({
        f"_l{k}": F.col(f"_a{k}") - F.col("_z") - bce_with_logits(F.col(f"_b{k}"), F.col(label)) for k in ks
    })
    out = out.withColumn("_most", top(joint)).withColumn("fit", log_sum(joint, "_most"))
    return out.withColumns(
        {f"g{k}": F.exp(F.col(f"_a{k}") - F.col("_z")) for k in ks}
        | {f"p{k}": sigmoid(F.col(f"_b{k}")) for k in ks}
        | {f"r{k}": F.exp(F.col(f"_l{k}") - F.col("fit")) for k in ks}
    ).drop("_top", "_z", "_most", *gates, *joint, *[f"_b{k}" for k in ks])


@dataclass(frozen=True)
class Sums:
    """What a step needs, per row: sums of a size that only features and parts set."""

    fit: float
    gate_slope: np.ndarray  # (part, weight)
    part_slope: np.ndarray
    held: np.ndarray  # (part, weight, weight): products of inputs weighted by r
    bend: np.ndarray  # the same weighted by r p (1 - p)
    gate_bend: np.ndarray  # curvature of the gate, all its weights by all


def _log_sums(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column the log of the sum of exponentials, and each row's share of the sum."""
    most = logits.max(axis=0)
    shares = np.exp(logits - most)
    total = shares.sum(axis=0)
    return most + np.log(total), shares / total


def _pairs(x: np.ndarray) -> np.ndarray:
    """Products of the inputs, (weight, row), for each pair once; the same for all models."""
    return np.concatenate([x[i] * x[i:] for i in range(len(x))])


def _batch_sums(model: Mixture, x: np.ndarray, pairs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sums over one batch of rows, one after another, the number of rows first. Rows
    lie along the last axis of ``x`` and ``pairs``, so every step runs over whole columns
    and all products of inputs come from one matrix product."""
    (parts, width), a, b = model.gate.shape, model.gate @ x, model.parts @ x
    log_total, g = _log_sums(a)
    tail = np.exp(-np.abs(b))
    joint = a - log_total - np.maximum(b, 0) + b * y - np.log1p(tail)
    fit, r = _log_sums(joint)
    p = np.where(b >= 0, 1.0, tail) / (1.0 + tail)
    bends = r * p * (1 - p)
    lower = [(k, m) for k in range(parts) for m in range(k)]
    shared = [g[k] * g[m] for k, m in lower]
    sums = np.vstack([r, bends, *shared]) @ pairs.T
    first, second = np.triu_indices(width)
    products = np.empty((len(sums), width, width))
    products[:, first, second] = products[:, second, first] = sums
    both = np.zeros((parts, width, parts, width))
    for (k, m), found in zip(lower, products[2 * parts:]):
        both[k, :, m], both[m, :, k] = -found, -found
        both[k, :, k] += found
        both[m, :, m] += found
    found = [
        len(y), fit.sum(), (r - g) @ x.T, (r * (y - p)) @ x.T,
        products[:parts], products[parts : 2 * parts], both,
    ]
    return np.concatenate([np.ravel(f) for f in found])


def _packed(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """The rows as written blocks of numbers (``data``: inputs, then the label, a column
    after the other), so that a scan hands over blocks and not rows. They are not
    compressed: what a task reads of a file then bounds what it holds."""
    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c).to_numpy(zero_copy_only=False).astype("<f8") for c in (*features, label)]
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(columns).tobytes()], pa.binary())], names=["data"])

    path = new_path(rows.sparkSession, "packed")
    rows.select(*features, label).dropna().mapInArrow(pack, "data binary").write.option("compression", "none").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _task_sums(models: list[Mixture], inputs: int):
    """The sums of each model over the blocks of one task as (model, slot, value)."""
    def run(batches):
        totals = None
        for block in (block for batch in batches for block in batch.column("data")):
            numbers = np.frombuffer(block.as_buffer(), "<f8").reshape(inputs + 1, -1)
            x, y = np.vstack([numbers[:-1], np.ones(numbers.shape[1])]), numbers[-1]
            pairs = _pairs(x)
            found = np.array([_batch_sums(m, x, pairs, y) for m in models])
            totals = found if totals is None else totals + found
        if totals is not None:
            which, slot = np.indices(totals.shape, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.ravel()) for c in (which, slot, totals)], names=["model", "slot", "value"]
            )

    return run


def _sums(rows: DataFrame, models: list[Mixture], label: str) -> list[Sums]:
    """The sums of each model over rows that are not packed yet."""
    return _block_sums(_packed(rows, list(models[0].features), label), models)


def _block_sums(blocks: DataFrame, models: list[Mixture]) -> list[Sums]:
    """The sums of each model; one scan for all, added up by Spark."""
    parts, width = models[0].gate.shape
    found = (
        blocks.mapInArrow(_task_sums(models, width - 1), "model int, slot int, value double")
        .groupBy("model", "slot").agg(F.sum("value").alias("value")).collect()
    )
    if not found:
        raise ValueError("a mixture needs rows")
    totals = np.zeros((len(models), 1 + max(r["slot"] for r in found)))
    for r in found:
        totals[r["model"], r["slot"]] = r["value"]
    shapes = [(), (parts, width), (parts, width), (parts, width, width), (parts, width, width), (parts * width,) * 2]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    out = []
    for total in totals:
        split = [part.reshape(shape) for part, shape in zip(np.split(total[1:] / total[0], ends), shapes)]
        out.append(Sums(float(split[0]), *split[1:]))
    return out


def _goal(model: Mixture, sums: Sums, penalty: float) -> float:
    return sums.fit - penalty / 2 * float((model.gate**2).sum() + (model.parts**2).sum())


def _moved(model: Mixture, sums: Sums, penalty: float, newton: bool) -> Mixture:
    """The maximisation step. The gate's curvature is at most half the products of the
    inputs and a logistic model's a quarter of them, so a step by these bounds never
    lowers the goal; Newton's step is longer and has to be checked."""
    width = model.gate.shape[1]
    ridge = penalty * np.eye(width)
    slope = sums.gate_slope - penalty * model.gate
    if newton:
        bent = sums.gate_bend + penalty * np.eye(model.gate.size)
        gate = model.gate + np.linalg.solve(bent, slope.ravel()).reshape(-1, width)
    else:
        gate = model.gate + np.linalg.solve(sums.held.sum(axis=0) / 2 + ridge, slope.T).T
    bends = sums.bend if newton else sums.held / 4
    parts = np.array([
        w + np.linalg.solve(bend + ridge, up - penalty * w)
        for w, bend, up in zip(model.parts, bends, sums.part_slope)
    ])
    return Mixture(model.features, gate, parts)


@dataclass
class _Climb:
    """One start: where it is, and whether its next step is Newton's."""

    model: Mixture
    sums: Sums
    goals: list[float]
    newton: bool = True
    done: bool = False


def _advance(blocks, climbs, penalty, steps, enough) -> None:
    """Up to ``steps`` scans. A step that would lower the goal is not taken; the bounds
    decide the next one, and if that fails too, only rounding is left."""
    for _ in range(steps):
        going = [c for c in climbs if not c.done]
        if not going:
            break
        wanted = [_moved(c.model, c.sums, penalty, c.newton) for c in going]
        for c, model, sums in zip(going, wanted, _block_sums(blocks, wanted)):
            goal = _goal(model, sums, penalty)
            if goal >= c.goals[-1]:
                c.done = goal - c.goals[-1] < enough
                c.model, c.sums, c.newton = model, sums, True
                c.goals.append(goal)
            else:
                c.done, c.newton = not c.newton, False


def fit_mixture(
    rows: DataFrame, features: list[str], label: str = "y", parts: int = 3, starts: int = 5, warm: int = 8,
    steps: int = 60, penalty: float = 1e-4, seed: int = 42,
) -> tuple[Mixture, list[float]]:
    """The mixture and the goal (mean log likelihood less the penalty on the weights)
    before and after each step of the start that was kept.

    ``rows`` are packed into written blocks once; each step scans these, numpy adds up
    each block, and a step sends one set of sums to the driver.
    Rows with a NULL in a feature or the label take no part. All starts take ``warm``
    steps in the same scans, the best goes on.
    """
    blocks = _packed(rows, features, label)
    models = [Mixture.start(features, parts, seed + i) for i in range(starts)]
    climbs = [_Climb(m, s, [_goal(m, s, penalty)]) for m, s in zip(models, _block_sums(blocks, models))]
    _advance(blocks, climbs, penalty, warm, 0.0)
    best = max(climbs, key=lambda c: c.goals[-1])
    _advance(blocks, [best], penalty, steps, ENOUGH)
    return best.model, best.goals
