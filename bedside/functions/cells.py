"""Column expressions for text cells, labels and availability."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Characters that count as blank around lines and cells.
BLANKS = " \t\r\n\f\v"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_line(line: Column, delimiter: str = "[|]") -> Column:
    """Fields of a trimmed line; empty fields are kept."""
    return F.split(trimmed(line), delimiter, -1)


def cell_present(cell: Column) -> Column:
    """Text is a value unless it is missing, blank, or ``nan`` in any case.

    The ``nan`` test does not trim, so ``' nan'`` counts as a value.
    """
    return cell.isNotNull() & (F.lower(cell) != "nan") & (trimmed(cell) != "")


def value_present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def to_number(cell: Column) -> Column:
    """Number or NULL; NaN and non-numeric text both become NULL."""
    number = cell.try_cast("double")
    return F.when(~F.isnan(number), number)


def label_is_one(label_text: Column) -> Column:
    """Positive only if the label text is exactly ``1`` (``1.0`` is not)."""
    return F.coalesce(label_text == "1", F.lit(False))


def availability_tier(percent: Column) -> Column:
    return (
        F.when(percent >= 80, "High")
        .when(percent >= 40, "Medium")
        .when(percent > 0, "Low")
        .otherwise("None")
    )
