"""Chat formatting: the cheapest repair of a sequence of roles, then rendering.

A turn may be kept, relabelled, merged into the turn before it, or preceded by
empty turns, so that the roles follow the automaton of legal turns. Costs of a
stretch of turns are a matrix from the role before it to the role at its end;
matrices of neighbouring stretches combine, so a conversation of any length is
solved in blocks and no task sees more than one block of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bedside.llm.common import prefix_sums
from bedside.session import cut

ROLES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles that may follow a role; a conversation ends with the assistant.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ASSISTANT
MERGE, MERGE_EMPTY, INSERT, RELABEL = 2, 1, 3, 4
BLOCK = 4096
FAR = 1 << 40
KINDS = len(ROLES) * 2  # role (start stands for unknown) and whether the text is blank
PATH_TYPE = "conv string, block long, above long, moves array<long>"


def _inserts() -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, ...]]]:
    """Fewest empty turns that lead from one role to another, and which."""
    cost = np.full((4, 4), FAR)
    paths: dict[tuple[int, int], tuple[int, ...]] = {(r, r): () for r in range(4)}
    for r in range(4):
        cost[r, r] = 0
        front = [r]
        while front:
            now = front.pop(0)
            for then in LEGAL[now]:
                if cost[r, then] == FAR:
                    cost[r, then] = cost[r, now] + INSERT
                    paths[r, then] = (*paths[r, now], then)
                    front.append(then)
    return cost, paths


INSERT_COST, INSERT_PATH = _inserts()


def _moves() -> tuple[np.ndarray, dict[tuple[int, int, int], tuple[str, tuple[int, ...]]]]:
    """Per kind of turn the cost from role to role and what is done; at equal
    cost a turn of its own goes before a merge, then fewer insertions."""
    cost, act = np.full((KINDS, 4, 4), FAR), {}
    for kind in range(KINDS):
        own, blank = kind // 2, kind % 2
        for before in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                change = RELABEL * (role != own)
                options = [
                    (INSERT_COST[before, at] + change, i, "relabel" if change else "keep", INSERT_PATH[before, at])
                    for i, at in enumerate(range(4)) if role in LEGAL[at] and INSERT_COST[before, at] < FAR
                ]
                if before == role:
                    options.append(((MERGE_EMPTY if blank else MERGE) + change, 9, "merge_relabel" if change else "merge", ()))
                if options:
                    price, _, name, path = min(options, key=lambda o: (o[0], len(o[3]), o[1]))
                    cost[kind, before, role] = price
                    act[kind, before, role] = (name, path)
    return cost, act


MOVE_COST, MOVE_ACT = _moves()
END_COST = INSERT_COST[:, FINAL]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of one stretch followed by another."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def best_path(steps: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """Roles after each step of the cheapest way from ``entry`` to ``leave``; of
    equal ways the one with the smaller role first, from the end back."""
    cost = np.full(4, FAR)
    cost[entry] = 0
    back = []
    for step in steps:
        ways = cost[:, None] + step
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), FAR)
    roles = [leave]
    for from_ in reversed(back[1:]):
        roles.append(int(from_[roles[-1]]))
    return roles[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: int):
    """(key, rows) of rows that come sorted by their first ``keys`` columns; rows
    are tuples of the other columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _emit(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BLOCK:
            yield from _emit(held, names, types)
            held = []
    yield from _emit(held, names, types)


NAMES = ["conv", "block", "matrix"]
TYPES = [pa.string(), pa.int64(), pa.list_(pa.int64())]
MATRIX = "conv string, block long, matrix array<long>"


def _of_turns(batches):
    def rows():
        for (conv, block), turns in _groups(batches, 2):
            total = MOVE_COST[turns[0][1]]
            for _, kind in turns[1:]:
                total = combine(total, MOVE_COST[kind])
            yield conv, block, total.ravel().tolist()

    return _batched(rows(), NAMES, TYPES)


def _of_blocks(batches):
    def rows():
        for (conv, above), blocks in _groups(batches, 2):
            total = np.array(blocks[0][1]).reshape(4, 4)
            for _, matrix in blocks[1:]:
                total = combine(total, np.array(matrix).reshape(4, 4))
            yield conv, above, total.ravel().tolist()

    return _batched(rows(), NAMES, TYPES)


ENDS = ["conv", "block", "entry", "leave"]
END_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int32()]


def _ends_below(batches):
    """Entry and end of every block from those of the block of blocks."""

    def rows():
        for (conv, _, entry, leave), blocks in _groups(batches, 4):
            way = best_path([np.array(m).reshape(4, 4) for _, m in blocks], entry, leave)
            for (block, _), a, b in zip(blocks, [entry, *way], way):
                yield conv, block, a, b

    return _batched(rows(), ENDS, END_TYPES)


def _turn_moves(batches):
    def rows():
        for (conv, block, entry, leave), turns in _groups(batches, 4):
            way = best_path([MOVE_COST[kind] for _, kind in turns], entry, leave)
            for (place, kind), before, role in zip(turns, [entry, *way], way):
                name, path = MOVE_ACT[kind, before, role]
                yield conv, place, name, ROLES[role], [ROLES[r] for r in path], int(MOVE_COST[kind, before, role]), before == START

    names = ["conv", "place", "action", "role_out", "inserted", "cost", "opens"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_()]
    return _batched(rows(), names, types)


def _sorted_by(df: DataFrame, dealt: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*dealt).sortWithinPartitions(*order)


def solve(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, place, action, role_out, inserted, cost, opens) of turns (conv, place, kind).

    ``place`` numbers all turns of the table, conversations one after the other;
    ``opens`` marks the first turn of a conversation.
    Costs are combined per ``block`` turns of a conversation, then per ``block``
    blocks, until one matrix per conversation is left; the choice of the roles
    goes back down the same way.
    """
    at = turns.withColumn("block", F.floor(F.col("place") / block))
    levels = []
    here = cut(
        _sorted_by(at.select("conv", "block", "place", "kind"), ["conv", "block"], ["conv", "block", "place"])
        .mapInArrow(_of_turns, MATRIX), "matrices",
    )
    while not here.groupBy("conv").count().filter("count > 1").isEmpty():
        levels.append(here)
        above = here.withColumn("above", F.floor(F.col("block") / block)).select("conv", "above", "block", "matrix")
        here = cut(_sorted_by(above, ["conv", "above"], ["conv", "above", "block"]).mapInArrow(_of_blocks, MATRIX), "matrices")
    final = F.array(*[F.element_at("matrix", r + 1) + int(min(END_COST[r], FAR)) for r in range(4)])
    leave = (F.array_position(final, F.array_min(final)) - 1).cast("int")
    ends = here.select("conv", "block", F.lit(START).alias("entry"), leave.alias("leave"))
    for below in reversed(levels):
        rows = below.withColumn("above", F.floor(F.col("block") / block)).join(ends.withColumnRenamed("block", "above"), ["conv", "above"])
        rows = rows.select("conv", "above", "entry", "leave", "block", "matrix")
        ends = _sorted_by(rows, ["conv", "above"], ["conv", "above", "block"]).mapInArrow(
            _ends_below, "conv string, block long, entry int, leave int"
        )
        ends = cut(ends, "ends")
    rows = at.join(ends, ["conv", "block"]).select("conv", "block", "entry", "leave", "place", "kind")
    return _sorted_by(rows, ["conv", "block"], ["conv", "block", "place"]).mapInArrow(
        _turn_moves, "conv string, place long, action string, role_out string, inserted array<string>, cost long, opens boolean"
    )


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text)


CLOSE = "<|im_end|>\n"


def repair_and_render(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Repaired and rendered conversations, one row per input turn.

    Columns: ``conv_id``, ``turn``, ``place`` (order in the table), ``action`` (keep,
    relabel, merge, merge_relabel), ``role_out``, ``inserted`` (roles of empty turns
    put before it), ``closing`` (roles of empty turns after the last), ``cost`` (with
    those) and ``piece``. The pieces of a conversation in the order of ``place`` make up its
    text; a conversation is never gathered in one row.

    Turns are ordered by number, then role, then text, null first. Roles
    other than system, user and assistant, null too, must be relabelled. Null texts
    count as empty; merging a blank text costs less and adds nothing. Repeated
    rows are turns of their own. Null conversation ids form one conversation.
    Equal costs are decided by fixed rules, so reruns agree. Marks inside a text
    are broken up by a backslash. Other columns are never read; an empty table gives
    an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("conv"),
        F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text"), F.lit(1).alias("one"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    rows = cut(prefix_sums(rows, order, "one", "turns").withColumnRenamed("rank", "place").drop("before", "one"), "placed")
    known = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES[1:]]), F.col("role")), F.lit(0))
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    kinds = rows.select("conv", "place", (known * 2 + blank.cast("long")).cast("int").alias("kind"))
    moves = cut(solve(kinds, block), "moves")
    # The last turn of a conversation is met by its place, so turns of one are never gathered.
    lasts = moves.groupBy("conv").agg(F.max("place").alias("place")).select("place", F.lit(True).alias("closes"))
    moves = moves.join(cut(lasts, "lasts"), "place", "left").withColumn("closes", F.coalesce("closes", F.lit(False)))
    done = rows.join(moves, ["conv", "place"])
    shown = F.regexp_replace("text", r"<\|im_", r"<\\|im_")
    closing = F.lit(None).cast("array<string>")
    for r in range(1, 4):
        path = [F.lit(ROLES[x]) for x in INSERT_PATH[r, FINAL]]
        closing = F.when(F.col("role_out") == ROLES[r], F.array(*path).cast("array<string>")).otherwise(closing)
    closing = F.when(F.col("closes"), closing).otherwise(F.array().cast("array<string>"))
    empties = lambda c: F.concat_ws("", F.transform(c, lambda r: F.concat(_turn(r, F.lit("")), F.lit(CLOSE))))
    merged = F.col("action").isin("merge", "merge_relabel")
    joined = F.when(blank, F.lit("")).otherwise(F.concat(F.lit("\n"), shown))
    opened = F.concat(
        F.when(F.col("opens"), "").otherwise(CLOSE), empties(F.col("inserted")), _turn(F.col("role_out"), shown)
    )
    end = F.when(F.col("closes"), F.concat(F.lit(CLOSE), empties(F.col("closing")))).otherwise("")
    return done.withColumn("closing", closing).select(
        "conv_id", "turn", "place", "action", "role_out", "inserted", "closing",
        (F.col("cost") + F.size("closing") * INSERT).alias("cost"),
        F.concat(F.when(merged, joined).otherwise(opened), end).alias("piece"),
    )
