"""Column expressions for the reference's scalar functions.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "col_of", "in_set", "not_equal_flag", "any_equal", "contains_any",
    "matches", "replace_first", "paste", "title_case", "snake_case",
    "clean_names", "parse_date", "date_part_text", "month_name",
    "parse_number", "round_half_even", "safe_divide", "is_missing",
    "strict_sum", "cast_all_text", "level_order", "comma",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c, values) -> Column:
    """``x %in% values``: never null; a null x is simply not a member."""
    values = list(values)
    return F.coalesce(col_of(c).isin(values), F.lit(False))


def not_equal_flag(c, code, yes: str, no: str) -> Column:
    """``ifelse(x %in% code, no, yes)``: a null x takes the ``yes`` label."""
    return F.when(in_set(c, [code]), F.lit(no)).otherwise(F.lit(yes))


def any_equal(pairs: dict) -> Column:
    """OR of null-safe equalities ``{column: code}``; never null."""
    return reduce(lambda a, b: a | b,
                  [col_of(c).eqNullSafe(F.lit(v)) for c, v in pairs.items()])


def contains_any(cols, code: str) -> Column:
    """``grepl(code, a) | grepl(code, b)``: substring anywhere, null -> false."""
    return reduce(lambda a, b: a | b,
                  [F.coalesce(col_of(c).contains(code), F.lit(False)) for c in cols])


def matches(c, pattern: str) -> Column:
    """Regex test with ``grepl`` null handling."""
    return F.coalesce(col_of(c).rlike(pattern), F.lit(False))


def replace_first(c, pattern: str, replacement: str) -> Column:
    """``str_replace``: replace only the first regex match.

    What lies before and after the first match is captured by name, so groups
    of the pattern's own don't matter; the lazy prefix guarantees the leftmost
    match is the one replaced.
    """
    rx = f"^(?s)(?<headOfText>.*?)(?:{pattern})(?<tailOfText>.*)$"
    rep = "${headOfText}" + replacement.replace("\\", r"\\").replace("$", r"\$") + "${tailOfText}"
    return F.when(col_of(c).rlike(f"(?s){pattern}"),
                  F.regexp_replace(col_of(c), rx, rep)).otherwise(col_of(c))


def paste(*cols, sep: str = " ", na_as_text: bool = False) -> Column:
    """``paste``: with ``na_as_text`` a null prints as ``NA``."""
    cs = [col_of(c).cast("string") for c in cols]
    if na_as_text:
        cs = [F.coalesce(c, F.lit("NA")) for c in cs]
    return F.concat_ws(sep, *cs)


def title_case(c) -> Column:
    """``str_to_title`` approximated by ``initcap`` (T15: splits on spaces only)."""
    return F.initcap(col_of(c))


def snake_case(name: str) -> str:
    s = re.sub(r"[^0-9A-Za-z]+", "_", name.strip())
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = s.strip("_").lower()
    return s or "x"


def clean_names(df: DataFrame) -> DataFrame:
    """``clean_names``: snake_case, de-duplicated with ``_2``, ``_3`` suffixes."""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        base = snake_case(name)
        if base[0].isdigit():
            base = "x" + base
        n = seen.get(base, 0) + 1
        seen[base] = n
        out.append(base if n == 1 else f"{base}_{n}")
    return df.toDF(*out)


def parse_date(c, fmt: str = "M/d/yyyy") -> Column:
    """``as.Date(x, "%m/%d/%Y")``: junk -> null."""
    return F.try_to_date(col_of(c), fmt)


def date_part_text(c, part: str) -> Column:
    """``format(d, "%m")`` / ``"%Y"`` as text."""
    return F.date_format(col_of(c), {"month": "MM", "year": "yyyy", "day": "dd"}[part])


def month_name(c) -> Column:
    """``month.name[m]`` for a date: full English month name."""
    return F.date_format(col_of(c), "MMMM")


def parse_number(c, to: str = "double") -> Column:
    """``as.numeric``: junk -> null."""
    return F.trim(col_of(c).cast("string")).try_cast(to)


def round_half_even(c, digits: int = 0) -> Column:
    """R ``round``: IEC 60559 half-to-even."""
    return F.bround(col_of(c), digits)


def safe_divide(num, den) -> Column:
    """x / 0 -> null instead of Inf/NaN or an ANSI error."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def is_missing(c) -> Column:
    return col_of(c).isNull()


def strict_sum(c) -> Column:
    """``sum(x)`` without ``na.rm``: null as soon as one input is null."""
    return F.when(F.count_if(col_of(c).isNull()) > 0, F.lit(None)).otherwise(F.sum(col_of(c)))


def cast_all_text(df: DataFrame) -> DataFrame:
    """``mutate_all(as.character)``."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def level_order(c, levels) -> Column:
    """Position of a label in an ordered level list (factor levels, I17/G4);
    labels outside the list sort last."""
    arr = F.array(*[F.lit(v) for v in levels])
    pos = F.array_position(arr, col_of(c))
    return F.when(pos == 0, F.lit(len(levels) + 1)).otherwise(pos).cast("int")


def comma(c, digits: int = 0) -> Column:
    """``scales::comma``: number as text with thousands separators (I6); only
    at the report edge, after all arithmetic."""
    return F.format_number(col_of(c).cast("double"), digits)
