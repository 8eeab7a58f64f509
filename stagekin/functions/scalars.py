"""Column -> Column expressions; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagekin import constants as C


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def falsy_or(first: Column, second: Column, zero_is_missing: bool = True) -> Column:
    """Fallback over two sources of one number; by default zero counts as missing."""
    return F.coalesce(F.nullif(first, F.lit(0)) if zero_is_missing else first, second)


def time_to_seconds(text: Column) -> Column:
    """'H:MM:SS', 'M:SS' or 'SS' to seconds; null when a part is not an integer."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("bigint"),
                       lambda total, part: total * 60 + part.try_cast("bigint"))


def title_from_slug(slug: Column) -> Column:
    """'3daagse-de-panne' -> '3Daagse De Panne': a letter after a non-letter is upper case."""
    marked = F.regexp_replace(F.replace(slug, F.lit("-"), F.lit(" ")), r"(?<=[^\p{L}\s])(?=\p{L})", "\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def is_hard(category: Column) -> Column:
    return F.coalesce(category.isin(*C.HARD_CATEGORIES), F.lit(False))


def victory_label(code: Column) -> Column:
    labels = F.create_map(*[F.lit(part) for pair in C.VICTORY_LABELS.items() for part in pair])
    return F.coalesce(F.try_element_at(labels, code), F.nullif(code, F.lit("")), F.lit(C.NO_LABEL))


def climb_intensity(climb_ratio: Column) -> Column:
    return F.least(climb_ratio / F.lit(C.INTENSITY_SCALE), F.lit(1.0))


def whole_percent(share: Column) -> Column:
    return F.round(share * 100).cast("int")


def page_count(total: Column, page_size: int = C.PAGE_SIZE) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(total / F.lit(page_size)))


def page_offset(page: int | None, page_size: int = C.PAGE_SIZE) -> int:
    return (max(1, page or 1) - 1) * page_size


def season_span(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("–", first, last))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_run(victory_type: Column) -> Column:
    return victory_type.isNotNull()


def cut_reason(reason: Column) -> Column:
    return F.substring(reason, 1, C.REASON_LIMIT)
