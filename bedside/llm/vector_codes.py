"""Vector codes by parts: exact assignment rounds with norm-of-sum bounds.

Every part of a vector keeps its code, and for each group of codebook entries a
lower bound of the distance to the group's other entries, with the round in which
the bound was measured. All codebooks of all rounds are retained, so a bound is
lowered by the true distance between an entry now and at the bound's round, not by
the sum of the steps in between. Groups whose bound stays above the distance to
the assigned entry are not scanned again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bedside.llm.common import one_row
from bedside.session import cut

EXACT = 1 << 53  # below this every sum is exact in double precision
GROUPS = 4  # groups of codebook entries with a bound each
SLACK = 1e-9  # relative slack that covers rounding of square roots
CELLS = 1 << 21  # components worked on at once
STATE = "v array<int>, code binary, low binary, stamp binary"


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    """Not null and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


class Codebooks:
    """All rounds' entries, ``[round][part, entry, component]``, and their groups."""

    def __init__(self, first: np.ndarray):
        self.rounds = [first.astype(np.float64)]
        entries = first.shape[1]
        self.groups = []  # per part, entries that lie near each other
        for part in self.rounds[0]:
            widest = int(np.argmax(np.ptp(part, axis=0))) if part.size else 0
            order = np.argsort(part[:, widest], kind="stable") if part.shape[1] else np.arange(entries)
            self.groups.append([g for g in np.array_split(order, GROUPS)])

    def moved(self, part: int, since: int) -> np.ndarray:
        """Net way of each entry from round ``since`` to the last one, rounded up."""
        step = self.rounds[-1][part] - self.rounds[since][part]
        return np.sqrt((step * step).sum(axis=1)) * (1 + SLACK)

    def most_moved(self, part: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per round and group, the longest way of an entry, and the longest
        without each entry that may be the assigned one."""
        ways = np.stack([self.moved(part, r) for r in range(len(self.rounds))])
        most = np.zeros((len(self.rounds), GROUPS))
        without = np.zeros((len(self.rounds), GROUPS, ways.shape[1]))
        for g, members in enumerate(self.groups[part]):
            if not len(members):
                continue
            most[:, g] = ways[:, members].max(axis=1)
            without[:, g, :] = most[:, g, None]
            for j in members:
                others = members[members != j]
                without[:, g, j] = ways[:, others].max(axis=1) if len(others) else 0.0
        return most, without[:, :, own]


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries; whole numbers, exact in doubles."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)


def _down(x: np.ndarray) -> np.ndarray:
    """As 32-bit numbers that are not larger."""
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-1))


def first_codes(x: np.ndarray, books: Codebooks, part: int):
    """Codes, bounds and stamps of one part before any round; all entries are measured."""
    squares = _squares(x, books.rounds[-1][part])
    code = squares.argmin(axis=1)
    error = squares[np.arange(len(x)), code]
    squares[np.arange(len(x)), code] = np.inf
    low = np.full((len(x), GROUPS), np.inf)
    for g, members in enumerate(books.groups[part]):
        if len(members):
            low[:, g] = np.sqrt(squares[:, members].min(axis=1))
    return code, error, _down(low), np.full(low.shape, len(books.rounds) - 1, np.uint8)


def next_codes(x: np.ndarray, code: np.ndarray, low: np.ndarray, stamp: np.ndarray, books: Codebooks, part: int):
    """Codes, bounds and stamps of one part under the last codebook; also how many
    (row, group) pairs were scanned. A group is passed over only if its bound is
    truly above the distance to the assigned entry, so ties are always measured."""
    entries, now, rows = books.rounds[-1][part], len(books.rounds) - 1, np.arange(len(x))
    gap = x - entries[code]
    error = (gap * gap).sum(axis=1)
    _, without = books.most_moved(part, code)  # [round, group, row]
    groups = np.arange(GROUPS)
    bound = low.astype(np.float64) - without[stamp, groups, rows[:, None]]
    near = np.sqrt(error) * (1 + SLACK)
    scan = ~(near[:, None] < bound)
    best, best_error = code.copy(), error.copy()
    low, stamp = low.copy(), stamp.copy()
    measured = []
    for g, members in enumerate(books.groups[part]):
        some = np.flatnonzero(scan[:, g])
        if not len(some) or not len(members):
            continue
        squares = _squares(x[some], entries[members])
        measured.append((members, some, squares))
        least = squares.min(axis=1)
        found = np.where(squares == least[:, None], members, len(entries)).min(axis=1)
        better = (least < best_error[some]) | ((least == best_error[some]) & (found < best[some]))
        best[some[better]], best_error[some[better]] = found[better], least[better]
    for members, some, squares in measured:
        squares[members == best[some][:, None]] = np.inf
        g = next(i for i, m in enumerate(books.groups[part]) if m is members)
        low[some, g] = _down(np.sqrt(squares.min(axis=1)))
        stamp[some, g] = now
    # An entry that lost its row counts in its group's bound from now on.
    home = np.empty(len(entries), np.int64)
    for g, members in enumerate(books.groups[part]):
        home[members] = g
    lost = np.flatnonzero((best != code) & ~scan[rows, home[code]])
    g = home[code[lost]]
    low[lost, g] = _down(np.minimum(np.maximum(bound[lost, g], 0), np.sqrt(error[lost])))
    stamp[lost, g] = now
    return best, best_error, low, stamp, int(scan.sum())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _binary(column: pa.Array, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _rows_as_binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def _assign(shared, width: int, parts: int, last: bool):
    """Assign every part anew; ``last`` hands on code and error instead of state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        begin = len(books.rounds) == 1
        size = width // parts
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, CELLS // width)):
                batch = whole.slice(at, max(1, CELLS // width))
                x = _matrix(batch.column(2), width)
                if not begin:
                    code = _binary(batch.column(3), "u1", (parts,)).astype(np.int64)
                    low = _binary(batch.column(4), "<f4", (parts, GROUPS))
                    stamp = _binary(batch.column(5), "u1", (parts, GROUPS))
                codes, errors, lows, stamps = [], np.zeros(len(x)), [], []
                for p in range(parts):
                    own = x[:, p * size : (p + 1) * size]
                    if begin:
                        found = first_codes(own, books, p)
                    else:
                        found = next_codes(own, code[:, p], low[:, p], stamp[:, p], books, p)
                    codes.append(found[0])
                    errors += found[1]
                    lows.append(found[2])
                    stamps.append(found[3])
                codes = np.stack(codes, axis=1).astype(np.uint8)
                out = [batch.column(0), batch.column(1)]
                if last:
                    out += [pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(errors.astype(np.int64))]
                    names = ["vec_id", "label", "code", "error"]
                else:
                    out += [batch.column(2), _rows_as_binary(codes), _rows_as_binary(np.stack(lows, axis=1).astype("<f4")),
                            _rows_as_binary(np.stack(stamps, axis=1))]
                    names = ["vec_id", "label", "v", "code", "low", "stamp"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _sums(width: int, parts: int, entries: int):
    """Per part and entry the number of parts assigned (place -1) and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width // parts
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts, size)
            code = _binary(batch.column(1), "u1", (parts,))
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p])
        part, entry = np.nonzero(count)
        values = np.concatenate([count[part, entry][:, None], total[part, entry]], axis=1)
        place = np.broadcast_to(np.arange(-1, size), values.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, size + 1).astype(np.int32)), pa.array(np.repeat(entry, size + 1).astype(np.int32)),
             pa.array(place.ravel().astype(np.int32)), pa.array(values.ravel())],
            names=["part", "entry", "place", "value"],
        )

    return run


def _next_entries(state: DataFrame, books: Codebooks, width: int, parts: int) -> np.ndarray:
    """Floors of the means; entries without parts stay. What comes to the driver
    has the size of the codebooks."""
    last = books.rounds[-1]
    sums = state.select("v", "code").mapInArrow(_sums(width, parts, last.shape[1]), "part int, entry int, place int, value long")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    value = {(r.part, r.entry, r.place): int(r.value) for r in sums.toLocalIterator()}
    made = last.copy()
    for (part, entry, place), total in value.items():
        if place >= 0:
            made[part, entry, place] = total // value[part, entry, -1]
    return made


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (``vec_id``, ``label``, ``code`` in hex, ``error``) and
    the final entries as whole numbers ``[part, entry, component]``.

    Components become floor(256 x). A part's codebook starts as that part of the
    ``entries`` (256 at most) smallest ids, in order; each round assigns every part
    to its nearest entry, ties to the lower index, and moves entries to the floors
    of their means; at last parts are assigned again. ``error`` is the squared
    distance, summed over parts. Everything is exact whole-number arithmetic.

    Vectors that are null or hold null, NaN or infinite components take no part.
    Null ids sort last, repeated ids by vector, and each row has its code; labels
    are passed on. Vectors shorter than the longest are read as followed by zeros,
    and so are all if the longest is no multiple of ``parts``. With fewer rows
    than ``entries`` there are fewer entries; an empty table gives no rows. Values
    whose distances could pass 2**53 raise an error. Vectors, codes, bounds and
    stamps are written once a round; a task holds a batch of them. Only codebooks
    are broadcast, and sums of their size collected.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits")
    spark = vectors.sparkSession
    chosen = vectors.filter(usable(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole_numbers(F.col(vector_col)).alias("v")
    )
    most = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x))))
    found = one_row(chosen.agg(F.max(F.size("v")).alias("width"), most.alias("m")))
    width = -(-(found["width"] or 0) // parts) * parts
    if width == 0:
        empty = np.zeros((parts, 0, 0), np.int64)
        ids = chosen.select("vec_id", "label", F.repeat(F.lit("00"), F.lit(parts)).alias("code"), F.lit(0).cast("long").alias("error"))
        return ids, empty
    if 4 * found["m"] ** 2 * width >= EXACT:
        raise ValueError("distances would leave the range of exact sums")
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))).cast("array<int>")
    chosen = chosen.withColumn("v", padded)
    first = chosen.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = Codebooks(np.array([r.v for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    kinds = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    state = chosen
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        state = cut(state.mapInArrow(_assign(shared, width, parts, False), f"{kinds}, {STATE}"), f"codes-{number}")
        books.rounds.append(_next_entries(state, books, width, parts))
    shared = spark.sparkContext.broadcast(books)
    coded = state.mapInArrow(_assign(shared, width, parts, True), f"{kinds}, code string, error long")
    return cut(coded, "codes"), books.rounds[-1].astype(np.int64)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over equal labels, nulls together.
    The sums are written first, so a label that holds most rows is only the
    unsplit side of the join."""
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest(entries: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
