"""Sources.

Readers return lazy DataFrames; the first action reads the files in
parallel splits.  Schemas are given wherever the feed is known, so no
inference pass runs over the data.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.functions.scalars import clean_names, parse_number


def read_microdata(spark: SparkSession, path: str, string_cols: Iterable[str] = (),
                   schema: T.StructType | None = None) -> DataFrame:
    """Header CSV with chosen code columns forced to text, so leading zeros
    survive (A1).  With a ``schema`` nothing is inferred; otherwise types
    come from all rows, so that none is read as null, and ``string_cols``
    are overridden to text."""
    reader = spark.read.option("header", True)
    if schema is None:
        inferred = reader.option("inferSchema", True).csv(path)
        keep = set(string_cols)
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in keep else f.dataType, True)
                               for f in inferred.schema.fields])
    return reader.schema(schema).csv(path)


def parse_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of delimited text as typed columns (A1-A3): the reader's parsing for
    text that arrives in a column.  Code columns typed as text keep leading zeros; a value
    that doesn't fit its type is null."""
    return df.select(F.from_csv(F.col(column), schema).alias("_row")).select("_row.*")


def to_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Convert a text feed once to Parquet (column pruning, pushdown)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_register(spark: SparkSession, path: str, n_cols: int | None = None,
                  numeric: dict[str, str] | None = None) -> DataFrame:
    """Licensing register CSV (A2, A3): header row promoted to names, only
    the first ``n_cols`` columns, snake_case names, numeric columns parsed
    with junk -> null."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if n_cols is not None:
        df = df.select(df.columns[:n_cols])
    df = clean_names(df)
    for c, t in (numeric or {}).items():
        df = df.withColumn(c, parse_number(c, t))
    return df


def jdbc_options(url: str, query: str | None = None, table: str | None = None,
                 partition_column: str | None = None, lower: int | None = None,
                 upper: int | None = None, partitions: int | None = None, fetch_size: int = 10000,
                 **extra) -> dict:
    """Options for a database read (A4).  A large table is read in
    ``partitions`` parallel ranges of ``partition_column``."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    opts = {"url": url, "fetchsize": str(fetch_size)}
    if query is not None:
        if partition_column:
            opts["dbtable"] = f"({query}) AS src"
        else:
            opts["query"] = query
    else:
        opts["dbtable"] = table
    if partition_column:
        if lower is None or upper is None or not partitions:
            raise ValueError("partitioned reads need lower, upper and partitions")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower),
                     "upperBound": str(upper), "numPartitions": str(partitions)})
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_table(spark: SparkSession, url: str, **kw) -> DataFrame:
    """``SELECT *`` from a database table or query over JDBC (A4)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **kw)).load()


def read_codes(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Code list, every column as text, key renamed (A5)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.withColumnsRenamed(rename or {})


def read_period_files(spark: SparkSession, files: dict, tag: str = "year",
                      schema: T.StructType | None = None) -> DataFrame:
    """One file per period stacked with a period tag."""
    from indicata.operators.series import read_periods
    frames = {}
    for k, p in files.items():
        r = spark.read.option("header", True)
        frames[k] = (r.schema(schema) if schema is not None else r).csv(p)
    return read_periods(frames, tag)


def read_open_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Open-data dump in UTF-8 with a byte-order mark (A7): the mark is
    stripped from the first column name."""
    r = spark.read.option("header", True).option("encoding", "UTF-8")
    df = (r.schema(schema) if schema is not None else r).csv(path)
    first = df.columns[0]
    clean = first.lstrip("﻿")
    return df.withColumnRenamed(first, clean) if clean != first else df


def select_variables(catalog: DataFrame, estimates: DataFrame, concept: str, label: str,
                     name_col: str = "name", variable_col: str = "variable") -> DataFrame:
    """Variables of a concept+label from the catalogue, as estimate (``E``)
    and margin (``M``) names, semi-joined to a long estimates table (A8).
    Spark broadcasts the selection where it measures it as small."""
    picked = catalog.filter((F.col("concept") == concept) & (F.col("label") == label))
    names = picked.select(F.explode(F.array(F.concat(F.col(name_col), F.lit("E")),
                                            F.concat(F.col(name_col), F.lit("M")))).alias(variable_col))
    return estimates.join(names, variable_col, "left_semi")


def wkt_rings(wkt: Column) -> Column:
    """The rings of a WKT ``POLYGON`` or ``MULTIPOLYGON`` as an array of (sign, xs, ys),
    parsed in the JVM: sign 1 for the outer ring of a part, -1 for a hole.  A closing vertex
    equal to the first is dropped; an empty polygon, a null or another shape has none."""
    ring = r"(\(?)\s*\(\s*([^()]+?)\s*\)"   # a ring whose bracket follows another one opens a part
    polygon = F.coalesce(F.upper(wkt).rlike(r"^\s*(MULTI)?POLYGON"), F.lit(False))
    opens, bodies = (F.regexp_extract_all(wkt, F.lit(ring), F.lit(g)) for g in (1, 2))

    # each step is an array of its own, so that a ring is split once, however often its points are looked at
    split = F.zip_with(opens, bodies, lambda opening, body: F.struct(
        F.when(opening == "(", 1.0).otherwise(-1.0).alias("sign"),
        F.transform(F.split(body, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+")).alias("points")))

    def unclosed(points: Column) -> Column:
        closed = (F.size(points) > 1) & (F.get(points, F.lit(0)) == F.get(points, F.size(points) - 1))
        return F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)

    def axis(points: Column, at: int) -> Column:
        return F.transform(points, lambda p: F.get(p, F.lit(at)).cast("double"))

    rings = F.transform(split, lambda r: F.struct(r["sign"].alias("sign"), unclosed(r["points"]).alias("points")))
    rings = F.transform(rings, lambda r: F.struct(r["sign"].alias("sign"), axis(r["points"], 0).alias("xs"), axis(r["points"], 1).alias("ys")))
    none = F.array().cast("array<struct<sign:double,xs:array<double>,ys:array<double>>>")
    return F.when(polygon, rings).otherwise(none)


def read_polygons(spark: SparkSession, path: str, fmt: str = "parquet", wkt_col: str | None = None) -> DataFrame:
    """Polygon layer (A9): Parquet with ``xs``/``ys`` rings, or any table with
    a WKT column that is parsed into one row per ring, with its sign."""
    df = spark.read.format(fmt).option("header", True).load(path)
    if wkt_col is not None:
        others = [c for c in df.columns if c != wkt_col]
        df = df.select(*others, F.inline(wkt_rings(F.col(wkt_col))))
    return df
