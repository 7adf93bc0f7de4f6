"""Comma-separated records whose quoted cells hold commas, doubled quotes or line ends,
in files that may be read in splits.

A line turns the state at its start (outside or inside a quoted cell) into that at its
end. It leaves the state alone, swaps it, or sets it whatever it was; so the state at a
line follows from the last line that sets it and the swaps since. Lines of a split are
combined by windows, splits of a file by one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bedside.session import cut

PLACE = ["file", "chunk", "split"]
INSIDE = r'[^"]*+(?:""[^"]*+)*+'  # text of a quoted cell


def split_cells(line: Column) -> Column:
    """Cells of one record, quotes taken off and doubled quotes made single. A quote
    counts at the start of a cell only, and only if it is closed; text behind the
    closing quote belongs to the cell."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f',(?:"{INSIDE}"[^,]*+|[^,]*+)'), F.lit(0))

    def bare(cell: Column) -> Column:
        inside = F.regexp_extract(cell, f'^,"({INSIDE})"', 1)
        behind = F.regexp_extract(cell, f'^,"{INSIDE}"(.*)$', 1)
        plain = F.substring(cell, 2, 1 << 30)
        closed = cell.rlike(f'^,"{INSIDE}"')
        return F.when(closed, F.concat(F.replace(inside, F.lit('""'), F.lit('"')), behind)).otherwise(plain)

    return F.transform(cells, bare)


def _left_open(text: Column) -> Column:
    """Whether text that starts outside ends inside a quoted cell; doubled quotes are gone."""
    return F.regexp_replace(text, r'(^|,)"[^"]*"[^,"]*', "$1").rlike('(^|,)"')


def _transition(value: Column) -> tuple[Column, Column]:
    """State at the end of a line that starts outside, and of one that starts inside."""
    single = F.replace(value, F.lit('""'), F.lit(""))
    place = F.instr(single, '"')
    rest = F.concat(F.lit("x"), F.substr(single, place + 1))
    return _left_open(single), F.when(place == 0, True).otherwise(_left_open(rest))


def _odd(n: Column) -> Column:
    return n % 2 == 1


def _state(start: Column, last: Column, swaps: Column) -> Column:
    """The state after ``swaps`` swaps, ``last`` being the last line that set it."""
    return F.coalesce(last["value"], start) != _odd(swaps - F.coalesce(last["swaps"], F.lit(0)))


def quoted_records(lines: DataFrame) -> DataFrame:
    """The placed lines with each record of a ``.csv`` file as one line at the place of
    its first; ``lines`` should be written, since splits are numbered as they were read.

    Only lines of records over several lines are gathered, each record by itself. A
    quote that is never closed is text, as are the lines behind it. Other files stay as
    they are.
    """
    csv = lines.filter(F.col("file").endswith(".csv"))
    outside, inside = _transition(F.col("value"))
    marked = csv.withColumns({"_out": outside, "_in": inside}).withColumns({
        "_swap": (F.col("_out") & ~F.col("_in")).cast("long"), "_sets": F.col("_out") == F.col("_in"),
    })
    upto = Window.partitionBy(*PLACE).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = marked.withColumn("_swaps", F.sum("_swap").over(upto))
    setting = F.when(F.col("_sets"), F.struct(F.col("_out").alias("value"), F.col("_swaps").alias("swaps")))
    walked = cut(
        walked.withColumn("_last", F.last(setting, ignorenulls=True).over(upto)).select(
            *PLACE, "pos", "value", "_out", "_in", "_swaps", "_last"
        ), "quotes",
    )

    # One row per split: its whole transition, then the state it starts in.
    splits = walked.groupBy(*PLACE).agg(
        F.max("_swaps").alias("_swaps"), F.max_by("_last", "pos").alias("_last")
    )
    order = Window.partitionBy("file").orderBy("chunk", "split")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumn("_total", F.sum("_swaps").over(so_far))
    offset = F.col("_total") - F.col("_swaps")
    setting = F.when(
        F.col("_last").isNotNull(),
        F.struct(F.col("_last.value").alias("value"), (F.col("_last.swaps") + offset).alias("swaps")),
    )
    splits = splits.withColumn("_set", F.last(setting, ignorenulls=True).over(so_far))
    splits = splits.withColumn("_end", _state(F.lit(False), F.col("_set"), F.col("_total")))
    starts = splits.select(*PLACE, F.coalesce(F.lag("_end").over(order), F.lit(False)).alias("_start"))

    # Records are numbered by split; lines before a split's first record belong to the
    # last record of an earlier one.
    after = _state(F.col("_start"), F.col("_last"), F.col("_swaps"))
    stated = walked.join(starts, PLACE).withColumn("_open", after)
    inner = Window.partitionBy(*PLACE).orderBy("pos")
    stated = stated.withColumn("_begun", F.coalesce(F.lag("_open").over(inner), F.col("_start")))
    stated = stated.withColumn(
        "_record", F.sum(F.when(F.col("_begun"), 0).otherwise(1)).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    )
    placed = cut(stated.select(*PLACE, "pos", "value", "_open", "_begun", "_record"), "records")
    counts = placed.groupBy(*PLACE).agg(F.max("_record").alias("_n"), F.max_by("_open", "pos").alias("_end"))
    mine = F.when(F.col("_n") > 0, F.struct("chunk", "split", F.col("_n").alias("record")))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owners = counts.select(
        *PLACE,
        F.last(mine, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_owner"),
        F.last(mine, ignorenulls=True).over(whole).alias("_final"), F.last("_end").over(whole).alias("_unclosed"),
    )
    own = F.struct("chunk", "split", F.col("_record").alias("record"))
    keyed = placed.join(owners, PLACE).withColumn("_key", F.when(F.col("_record") > 0, own).otherwise(F.col("_owner")))
    text = F.col("_unclosed") & (F.col("_key") == F.col("_final"))
    alone = text | (~F.col("_begun") & ~F.col("_open"))
    part = F.struct("chunk", "split", "pos", "value")
    gathered = keyed.filter(~alone).groupBy("file", "_key").agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    first = F.col("_parts")[0]
    records = gathered.select(
        "file", *[first[c].alias(c) for c in ("chunk", "split", "pos")],
        F.array_join(F.transform("_parts", lambda p: p["value"]), "\n").alias("value"),
    )
    return (
        lines.filter(~F.col("file").endswith(".csv")).select(*PLACE, "pos", "value")
        .unionByName(keyed.filter(alone).select(*PLACE, "pos", "value")).unionByName(records)
    )
