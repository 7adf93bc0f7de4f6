"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bedside.llm.components import components
from bedside.session import cut

BITS = 64
SEED = 42
LEAF = 64  # pairs of rows below which a node pair is compared row by row
WAVE = 1 << 17  # node pairs opened at once
TASK_ROWS = 1 << 16  # rows of one trie join


def fingerprint(text: str | None, words: int) -> int:
    """Majority bits over the XXH64 of the word shingles; 0 if there is no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), TASK_ROWS):
        spans = zip(starts[at : at + TASK_ROWS], ends[at : at + TASK_ROWS])
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the signed 64-bit fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


class _Labels:
    """Union of row numbers; labels are smallest members."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.run_end = np.arange(1, n + 1)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.waiting.append((a, b))
            self.count += len(a)

    def settle(self) -> None:
        if not self.waiting:
            return
        a = np.concatenate([x for x, _ in self.waiting])
        b = np.concatenate([x for _, x in self.waiting])
        self.waiting, self.count = [], 0
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                far = label[label]
                if np.array_equal(far, label):
                    break
                label = far
        self.label = label
        last = np.flatnonzero(np.append(label[1:] != label[:-1], True))
        self.run_end = last[np.searchsorted(last, np.arange(len(label)))] + 1


def trie_join(group: np.ndarray, fps: np.ndarray, budget: int) -> np.ndarray:
    """Label of every row: the first row of its component, rows of one group being
    linked when at most ``budget`` bits differ.

    Rows are sorted by group and fingerprint, so a node of a group's binary trie
    is a range of rows. Pairs of nodes of equal depth go down together; a step
    to unlike children spends one bit of the budget, and a pair that has spent
    more is dropped with all below it. So is a pair whose rows are known to be
    linked already, which keeps dense clusters from being compared pair by pair.
    """
    n = len(fps)
    labels = _Labels(n)
    near = (group[1:] == group[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= budget)
    at = np.flatnonzero(near)
    labels.link(at, at + 1)
    labels.settle()
    ones = {}
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    last = np.append(first[1:], n)
    many = last - first > 1
    stack = [(0, np.stack([first[many], last[many], first[many], last[many], np.zeros(many.sum(), np.int64)]))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > WAVE:
            stack.append((depth, pairs[:, WAVE:]))
            pairs = pairs[:, :WAVE]
        a0, a1, b0, b1, spent = pairs
        known = (labels.run_end[a0] >= a1) & (labels.run_end[b0] >= b1) & (labels.label[a0] == labels.label[b0])
        open_ = ~known & ((a0 != b0) | (a1 - a0 > 1))
        pairs = pairs[:, open_]
        a0, a1, b0, b1, spent = pairs
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth == BITS)
        _compare(fps, pairs[:, small], budget, labels)
        if labels.count > WAVE:
            labels.settle()
        a0, a1, b0, b1, spent = pairs[:, ~small]
        if not len(a0):
            continue
        if depth not in ones:
            bit = (fps >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        own = (a0 == b0) & (a1 == b1)
        below = np.concatenate([
            np.stack([a0, am, b0, bm, spent]),
            np.stack([am, a1, bm, b1, spent]),
            np.stack([a0, am, bm, b1, spent + 1]),
            np.stack([am, a1, b0, bm, spent + 1])[:, ~own],
        ], axis=1)
        keep = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget)
        stack.append((depth + 1, below[:, keep]))
    labels.settle()
    return labels.label


def _compare(fps: np.ndarray, pairs: np.ndarray, budget: int, labels: _Labels) -> None:
    """Compare all rows of small node pairs, some at a time."""
    sizes = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
    borders = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + 1, WAVE * 8), side="left")
    for lo, hi in zip(borders, np.append(borders[1:], len(sizes))):
        a0, a1, b0, b1, _ = pairs[:, lo:hi]
        size = (a1 - a0) * (b1 - b0)
        if not size.sum():
            continue
        which = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        width = (b1 - b0)[which]
        a, b = a0[which] + place // width, b0[which] + place % width
        close = np.bitwise_count(fps[a] ^ fps[b]) <= budget
        labels.link(a[close], b[close])


def _join_parts(budget: int):
    """Trie joins over the rows of a task, which come sorted by (key, unit, turned)."""

    def joined(keys, units, turned, fps):
        group = np.cumsum(np.append(0, (keys[1:] != keys[:-1]) | (units[1:] != units[:-1])))
        label = trie_join(group, turned.view(np.uint64), budget)
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[label[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(4)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if len(held[0]) >= TASK_ROWS:
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                if len(last):
                    cutoff = last[-1] + 1
                    yield joined(*[h[:cutoff] for h in held])
                    held = [h[cutoff:] for h in held]
        if len(held[0]):
            yield joined(*held)

    return run


def near_links(prints: DataFrame, bits: int = 4, heavy: int = TASK_ROWS) -> DataFrame:
    """Edges (u, v) that connect all fingerprints linked at ``bits`` or fewer
    differing bits; ``prints`` holds distinct fingerprints ``fp``.

    Of ``bits + 1`` blocks of a fingerprint at least one is equal in both of a
    linked pair. Each block in turn leads the trie: its levels are walked with
    a budget of no bits, which is an equality join on the block, and the tries
    below it are joined in tasks with the full budget. A block value held by
    more than ``heavy`` fingerprints is cut into pieces by hash, and every two
    pieces meet in a task of their own, so no task grows with the data. A task
    returns one edge per linked row, not its pairs.
    """
    spark = prints.sparkSession
    borders = [BITS * i // (bits + 1) for i in range(bits + 2)]
    copies = []
    for i, (start, end) in enumerate(zip(borders, borders[1:])):
        width = end - start
        value = F.shiftrightunsigned("fp", BITS - end).bitwiseAND(F.lit((1 << width) - 1))
        turned = F.shiftleft("fp", end).bitwiseOR(F.shiftrightunsigned("fp", BITS - end)) if end < BITS else F.col("fp")
        copies.append(F.struct((value * (bits + 1) + i).alias("key"), turned.alias("turned")))
    rows = prints.select("fp", F.explode(F.array(*copies)).alias("c")).select("c.key", "c.turned", "fp")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy)
    crowded = cut(counts.select("key", F.ceil(F.col("n") * 2 / heavy).cast("int").alias("g")), "crowded")
    whole = rows.withColumn("unit", F.lit(0).cast("long"))
    if not crowded.isEmpty():
        piece = F.pmod(F.xxhash64("fp"), F.col("g"))
        other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o")
        split = rows.join(crowded, "key").select("key", "turned", "fp", "g", piece.alias("p"), other)
        split = split.withColumn("unit", F.least("p", "o").cast("long") * F.col("g") + F.greatest("p", "o"))
        whole = whole.join(crowded, "key", "left_anti").unionByName(split.select("key", "turned", "fp", "unit"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.repartition(tasks, "key", "unit").sortWithinPartitions("key", "unit", F.col("turned").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.select("key", "unit", "turned", "fp").mapInArrow(_join_parts(bits), "u long, v long")


def near_duplicates(
    docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Class of near duplicates of every row: ``doc_id``, ``fp``, ``component_id``.

    Texts are lower-cased in A-Z and cut at ASCII white space; shingles of
    ``words`` words count as often as they occur, a text of fewer words is one
    shingle, and null, empty and blank texts have fingerprint 0. Fingerprints
    that differ in at most ``bits`` bits are linked, and a class is all that can
    be reached. ``component_id`` is the smallest id of the class; null ids are
    members but never name it, unless all are null. Equal fingerprints meet
    once. Rows repeated stay repeated; other columns are never read; an empty
    table gives an empty result.
    """
    found, named = _classes(docs, words, bits, id_col, text_col)
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def _classes(docs: DataFrame, words: int, bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row and (fp, label, component_id) of every fingerprint."""
    found = cut(fingerprints(docs, words, id_col, text_col), "prints")
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(near_links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    named = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    # Written first: then a component that holds most fingerprints is the side of the
    # join that Spark can split.
    names = cut(named.groupBy("label").agg(F.min("first").alias("component_id")), "names")
    return found, cut(named.select("fp", "label").join(names, "label").select("fp", "label", "component_id"), "named")


def drop_near_copies(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with its columns as they are: that of the smallest
    id (null last), then of the smallest fingerprint, then by a hash of the row."""
    found, named = _classes(docs, words, bits, id_col, text_col)
    namers = found.join(named, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    # An id that names a class tells its row unless the id is met again, in any class.
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    repeated = cut(repeated, "repeated")
    if repeated.isEmpty():
        return docs.join(namers, docs[id_col].eqNullSafe(namers["doc_id"]), "left_semi")
    apart = namers.join(repeated, namers["doc_id"].eqNullSafe(repeated["doc_id"]), "left_anti")
    alone = docs.join(apart, docs[id_col].eqNullSafe(apart["doc_id"]), "left_semi")
    shared = docs.join(repeated, docs[id_col].eqNullSafe(repeated["doc_id"]), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    shared = _with_print(shared.select(row), words, text_col).join(named, "fp")
    shared = shared.filter(F.col("row")[id_col].eqNullSafe(F.col("component_id")))
    # Copies are reduced in each task before they are shuffled.
    first = shared.groupBy("label").agg(F.min_by("row", F.struct("fp", F.xxhash64("row"))).alias("row"))
    return alone.unionByName(first.select("row.*"))


def _with_print(rows: DataFrame, words: int, text_col: str) -> DataFrame:
    """Rows (``row``) with the fingerprint ``fp`` of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["row", "fp"])

    schema = StructType([rows.schema["row"], StructField("fp", LongType())])
    return rows.select("row", F.col("row")[text_col].alias("text")).mapInArrow(run, schema)
