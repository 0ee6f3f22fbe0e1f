"""Text feeds with a quarantine for what doesn't fit.

The reference reads a register as text, promotes the first row to names, keeps the first
columns and turns what isn't a number into a missing value.  Here each missing value that
comes of junk is told: a parsed line carries, beside its typed columns, a list of (field, reason,
text) for all that didn't fit.  A line without any is typed; every other one is rejected, so
``lines = typed + rejected`` and the rejects can be counted by field and reason.

A line is a record: it is split by the JVM's CSV parser with quoted fields, and a quoted line end
isn't supported.  Nothing but the header line reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.functions.scalars import parse_number, snake_case

#: the reasons of a reject; the last four concern a whole line, whose fields are then all null
MISSING, JUNK, UNKNOWN, RANGE = "missing", "not a {}", "unknown value", "out of range"
EMPTY, FEW, MANY, QUOTE = "empty line", "too few fields", "too many fields", "open quote"
LINE = "(line)"
REJECTS = "_rejects"


@dataclass(frozen=True)
class Field:
    """What a column has to be.  ``type`` is string, date or any type text can be cast to; a ``date``
    is written as ``pattern`` says.  ``known`` are the only values, ``least`` and ``most`` the bounds."""

    name: str
    type: str = "string"
    required: bool = False
    known: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    pattern: str = "M/d/yyyy"

    def value(self, text: Column) -> Column:
        if self.type == "string":
            return text
        return F.try_to_date(F.trim(text), self.pattern) if self.type == "date" else parse_number(text, self.type)

    def reason(self, text: Column, value: Column | None = None) -> Column:
        """Why the text doesn't fit; null if it does.  ``value`` is what it is read as, where that is at hand."""
        value = self.value(text) if value is None else value
        blank = F.coalesce(F.trim(text) == "", F.lit(True))
        found = F.when(blank, F.lit(MISSING) if self.required else F.lit(None).cast("string"))
        if self.type != "string":
            found = found.when(value.isNull(), F.lit(JUNK.format({"date": "date"}.get(self.type, "number"))))
        if self.known:
            found = found.when(~text.isin(*self.known), F.lit(UNKNOWN))
        if self.least is not None:
            found = found.when(value < F.lit(self.least), F.lit(RANGE))
        if self.most is not None:
            found = found.when(value > F.lit(self.most), F.lit(RANGE))
        return found


def fields_of(schema: T.StructType | str) -> list[Field]:
    """A field for each column of a schema: any value that has its type, or none."""
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return [Field(f.name, f.dataType.simpleString()) for f in known.fields]


def header_names(line: str, delimiter: str = ",") -> list[str]:
    """Snake-case, unique names from a header line."""
    import csv

    seen: dict[str, int] = {}
    out = []
    for cell in next(csv.reader([line.lstrip("﻿")], delimiter=delimiter), []):
        base = snake_case(cell)
        base = f"x{base}" if base[0].isdigit() else base
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def promote_header(lines: DataFrame, text: str, order: str) -> str | None:
    """The text of the first line by ``order``: the one row that reaches the driver."""
    row = lines.agg(F.min_by(text, order).alias("header")).first()
    return row["header"] if row else None


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with more columns, each made once for a row.  A generator has one row for each: as conditions on
    its columns aren't pushed below it, they don't bring the parsing with them, as often as they name a column."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def parse_lines(lines: DataFrame, text: str, header: Sequence[str], fields: Sequence[Field], n_cols: int | None = None,
                delimiter: str = ",", keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, the first ``n_cols`` columns of the header with the types of their ``fields`` (text
    where none is given), and ``_rejects``.

    An empty field is null; a value that doesn't fit is null and rejected.  The fields of a line that is
    empty, has another number of fields than the header or an open quote are null, as no one can tell
    which is which.  A null line is an empty one."""
    wanted = list(header)[:n_cols] if n_cols is not None else list(header)
    by_name = {f.name: f for f in fields}
    unknown = sorted(set(by_name) - set(wanted))
    if unknown:
        raise ValueError(f"fields that the header doesn't have: {unknown}")
    line = F.col(text)
    plain = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")     # without quoted fields
    opened = F.contains(plain, F.lit('"'))
    count = F.size(F.split(plain, F.lit("\\Q" + delimiter + "\\E"), F.lit(-1)))
    broken = (F.when(F.coalesce(F.trim(line) == "", F.lit(True)), EMPTY).when(opened, QUOTE)
              .when(count < len(header), FEW).when(count > len(header), MANY))
    schema = ", ".join(f"c{i} STRING" for i in range(len(header)))
    options = {"mode": "PERMISSIVE", "sep": delimiter, "quote": '"', "escape": '"', "nullValue": ""}
    cells = F.when(F.col("_broken").isNull(), F.from_csv(line, schema, options))
    split = _once(lines.withColumn("_broken", broken), cells.alias("_cells"))
    told = [by_name.get(name, Field(name)) for name in wanted]
    values = [f.value(F.col(f"_cells.c{i}")).alias(f"v{i}") for i, f in enumerate(told)]
    reasons = [f.reason(F.col(f"_cells.c{i}"), F.col(f"_values.v{i}")).alias(f"r{i}") for i, f in enumerate(told) if f in by_name.values()]
    if values:
        split = _once(split, F.struct(*values).alias("_values"))
    if reasons:
        split = _once(split, F.struct(*reasons).alias("_reasons"))
    checks, fits = [], []
    for i, f in enumerate(told):
        cell, value, reason = F.col(f"_cells.c{i}"), F.col(f"_values.v{i}"), F.col(f"_reasons.r{i}")
        if f in by_name.values():
            checks.append(F.struct(F.lit(f.name).alias("field"), reason.alias("reason"), cell.alias("text")))
            # a value that is out of range or unknown isn't passed on: it is null, as junk is
            value = F.when(reason.isNull(), value)
        fits.append(value.alias(f.name))
    whole = F.array(F.struct(F.lit(LINE).alias("field"), F.col("_broken").alias("reason"), line.alias("text")))
    found = F.filter(F.array(*checks), lambda x: x["reason"].isNotNull()) if checks else F.filter(whole, lambda x: F.lit(False))
    return split.select(*keep, *fits, F.when(F.col("_broken").isNotNull(), whole).otherwise(found).alias(REJECTS))


def typed_rows(parsed: DataFrame) -> DataFrame:
    """The lines that fit throughout."""
    return parsed.filter(F.size(REJECTS) == 0).drop(REJECTS)


def published_rows(parsed: DataFrame) -> DataFrame:
    """All lines that could be split, junk as null: what the reference goes on with."""
    return parsed.filter((F.size(REJECTS) == 0) | (F.col(REJECTS)[0]["field"] != LINE)).drop(REJECTS)


def rejects(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each thing that didn't fit: ``keep``, field, reason, text."""
    return parsed.select(*keep, F.inline(REJECTS))


def quarantine_report(parsed: DataFrame) -> DataFrame:
    """(field, reason, lines): how many lines each field and reason rejects; and, with a null reason,
    how many lines there are in all, typed and rejected.  One pass; the counts are summed
    map-side, so a reason that most lines share is no hot key."""
    kinds = F.concat(F.array(*[F.struct(F.lit(name).alias("field"), F.lit(None).cast("string").alias("reason"), cond.alias("counts")) for name, cond in (
        ("(all)", F.lit(True)), ("(typed)", F.size(REJECTS) == 0), ("(rejected)", F.size(REJECTS) > 0))]),
        F.transform(F.col(REJECTS), lambda x: F.struct(x["field"].alias("field"), x["reason"].alias("reason"), F.lit(True).alias("counts"))))
    return parsed.select(F.inline(kinds)).groupBy("field", "reason").agg(F.count_if("counts").alias("lines"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file or folder of files: file, line_at (order within the file's split), value."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_at"), "value")


def read_register_quarantined(spark: SparkSession, path: str, fields: Sequence[Field], n_cols: int | None = None,
                              delimiter: str = ",") -> DataFrame:
    """A register feed (A2, A3) with its rejects: the first line promoted to names, only the first
    ``n_cols`` columns kept.  Lines equal to the header, as each file of a folder has one, are dropped."""
    lines = read_lines(spark, path)
    header = promote_header(lines, "value", "line_at")
    if header is None:
        raise ValueError(f"no line in {path}")
    rows = lines.filter(~F.col("value").eqNullSafe(F.lit(header)))
    return parse_lines(rows, "value", header_names(header, delimiter), fields, n_cols, delimiter, keep=["file"])
