"""Quality classifier by positive-unlabelled learning.

The non-negative unbiased risk of a linear model with logistic loss is
minimised: prior * R_P(f) + max(0, R_U(-f) - prior * R_P(-f)), where P are
trusted positives, U all web text of the learning folds, labels unseen, and the
prior is the share of positives, estimated from the labels of those folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bedside.llm.common import held_out, one_row
from bedside.session import cut

CLASSES = 8
#: Class of each byte: lower, upper, digit, blank, line end, sentence mark, other mark, beyond ASCII.
BYTE_CLASS = np.full(256, 7, np.uint8)
BYTE_CLASS[:128] = 6
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 0, 1, 2
BYTE_CLASS[[32, 9]], BYTE_CLASS[[10, 13]] = 3, 4
BYTE_CLASS[[ord(c) for c in ".,;:?!'\"-()"]] = 5
SIZE = 256 + CLASSES * CLASSES + 7
SLICE = 1 << 20  # bytes counted at once


def features(text: str | None) -> bytes:
    """Shares of bytes and of pairs of byte classes (square roots), length, line
    and word shape and repetition in the whole text, one byte each."""
    whole = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(whole, np.uint8)
    single, pairs = np.zeros(256), np.zeros(CLASSES * CLASSES)
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE + 1]
        kinds = BYTE_CLASS[part]
        single += np.bincount(part[:SLICE], minlength=256)
        pairs += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
    n = max(len(raw), 1)
    lines, blanks = single[10] + 1, single[9] + single[10] + single[13] + single[32] + 1
    words, rows = whole.split(), whole.split(b"\n")
    stutter = sum(map(eq, words, words[1:])) / max(len(words) - 1, 1)
    shape = [
        min(np.log2(n) / 32, 1), min(np.log2(n / lines) / 16, 1), min(n / blanks / 64, 1), len(raw) == 0,
        np.sqrt(stutter), np.sqrt(len(set(words)) / max(len(words), 1)), 1 - len(set(rows)) / len(rows),
    ]
    values = np.concatenate([np.sqrt(single / n), np.sqrt(pairs / n), shape])
    return np.rint(values * 255).astype(np.uint8).tobytes()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIZE).astype(np.float32) / 255


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, x binary")


def _summed(rows: DataFrame, of_batch) -> np.ndarray:
    """Sum of ``of_batch(positive, x)`` over all rows: one vector per task, then per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + of_batch(batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = rows.select("positive", "x").mapInArrow(run, "v array<double>")
    sums = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in sorted(sums.collect(), key=lambda r: r["i"])])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float
    risks: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = np.clip(x @ self.weights + self.bias, -60, 60) if len(x) else np.empty(0)
        return 1 / (1 + np.exp(-f.astype(np.float64)))


def fit(rows: DataFrame, prior: float, steps: int = 50, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Minimise the risk over ``rows`` (positive, x) by full passes with moments.

    When the negative part of the risk falls below 0, the step undoes that part
    instead, as the non-negative estimator prescribes. Without positives or
    rows the model is constant at the prior.
    """
    log_odds = float(np.log(prior / (1 - prior)))
    flat = Model(np.zeros(SIZE, np.float32), log_odds, prior, [])
    sums = _summed(rows, lambda p, x: np.concatenate([
        [len(p), p.sum()], x.sum(0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(0), x[p].sum(0, dtype=np.float64)
    ]))
    if not len(sums) or not sums[1]:
        return flat
    n, n_pos = sums[:2]
    mean = sums[2 : 2 + SIZE] / n
    spread = np.sqrt(np.maximum(sums[2 + SIZE : 2 + 2 * SIZE] / n - mean**2, 0))
    scale = np.where(spread > 0, 1 / np.maximum(spread, 0.01), 0)
    pos_mean = np.append((sums[2 + 2 * SIZE :] / n_pos - mean) * scale, 1.0)
    w, first, second, risks = np.zeros(SIZE + 1), 0.0, 0.0, []
    w[-1] = log_odds
    for step in range(1, steps + 1):
        slope = (w[:-1] * scale).astype(np.float32)
        bias = float(w[-1] - mean @ (w[:-1] * scale))

        def of_batch(p, x, slope=slope, bias=bias):
            f = x @ slope + bias
            pull = 1 / (1 + np.exp(-np.clip(f, -60, 60)))
            cost = np.logaddexp(0, f)
            own = np.concatenate([pull @ x, [pull.sum(), cost.sum()]])
            return np.concatenate([own, pull[p] @ x[p], [pull[p].sum(), cost[p].sum(), f[p].sum()]])

        s = _summed(rows, of_batch)
        unl, pos = s[: SIZE + 2], s[SIZE + 2 :]
        grad_u = np.append((unl[:SIZE] - mean * unl[SIZE]) * scale, unl[SIZE]) / n
        grad_p = np.append((pos[:SIZE] - mean * pos[SIZE]) * scale, pos[SIZE]) / n_pos
        negative = unl[SIZE + 1] / n - prior * pos[SIZE + 1] / n_pos
        positive = prior * (pos[SIZE + 1] - pos[SIZE + 2]) / n_pos
        risks.append(float(positive + max(negative, 0)))
        grad_negative = grad_u - prior * grad_p
        grad = -grad_negative if negative < 0 else prior * (grad_p - pos_mean) + grad_negative
        grad = grad + decay * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model((w[:-1] * scale).astype(np.float32), float(w[-1] - mean @ (w[:-1] * scale)), prior, risks)


def estimated_prior(labels: DataFrame) -> float:
    """Share of positives among the labels, kept off 0 and 1."""
    n = one_row(labels.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("positive"), F.lit(0)).alias("p")))
    return float((n["p"] + 1) / (n["n"] + 2))


def classify_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_positives: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """Score of every row: ``doc_id``, ``held_out``, ``score`` in [0, 1], ``predicted``.

    Labels are learned only outside the held-out fold (``crc32(id) mod 5 = 0``).
    Trusted positives are rows labelled 1, at most about ``max_positives`` of
    them, chosen by a hash of the id; an id labelled both ways is not trusted.
    All documents outside the fold are the unlabelled text. Scores depend on the
    text alone; null counts as empty, and empty texts are scored too. A null id
    is held out, repeated rows are scored alike, other columns are never read.
    Without positives all scores are the prior; an empty table gives no rows.
    """
    rows, model = _learned(docs, labels, max_positives, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(_matrix(batch.column(2)))
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _learned(
    docs: DataFrame, labels: DataFrame, max_positives: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> tuple[DataFrame, Model]:
    """Features of every row (``doc_id``, ``held_out``, ``positive``, ``x``) and the model."""
    known = labels.select(F.col(label_col).alias("q"), F.col(id_col).alias("doc_id"))
    known = known.filter(F.col("q").isNotNull() & ~held_out("doc_id")).groupBy("doc_id")
    known = cut(known.agg(F.min("q").cast("int").alias("positive")), "labels")
    prior = estimated_prior(known)
    total = one_row(known.agg(F.count(F.lit(1)).alias("n")))["n"]
    share = min(1.0, max_positives / max(total, 1))
    trusted = known.filter((F.col("positive") == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = cut(
        featured(docs, id_col, text_col)
        .join(trusted.select("doc_id", F.lit(True).alias("positive")), "doc_id", "left")
        .select("doc_id", held_out("doc_id").alias("held_out"), F.coalesce("positive", F.lit(False)).alias("positive"), "x"),
        "features",
    )
    return rows, fit(rows.filter("not held_out"), prior)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.3, text_col: str = "text", **settings
) -> DataFrame:
    """The rows that the classifier accepts, with their columns as they are. Each
    row is scored where it is, so null and repeated ids decide nothing."""
    _, model = _learned(docs, labels, id_col=id_col, text_col=text_col, **settings)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column(place)], pa.binary())
            yield batch.filter(pa.array(model.scores(_matrix(x)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
