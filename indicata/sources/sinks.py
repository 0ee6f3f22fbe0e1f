"""Sinks."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicata.sources.staging import staged


def write_indicator(df: DataFrame, path: str, fmt: str = "parquet",
                    partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write an indicator table (B1).  The reference's row-name column is not
    written.  Partitioning by geography level / year keeps later reads
    pruned."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_extract(df: DataFrame, predicate: Column, path: str, fmt: str = "csv") -> None:
    """A subset handed to another process (B2), e.g. one year of closures for
    geocoding."""
    write_indicator(df.filter(predicate), path, fmt)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str,
                   sort: bool = True) -> None:
    """Persist a table bucketed (and sorted) by its join key, data at
    ``path`` on shared storage.  Person and household files written with the
    same key and bucket count join, and group by that key, without a shuffle
    in every later run (the published runs reuse the same files many times)."""
    w = df.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys)
    if sort:
        w = w.sortBy(*keys)
    w.saveAsTable(table)


# ---- idempotent partitions -------------------------------------------------
#
# <path>/data/<key>=.../part-*     the rows
# <path>/manifest/<n>/part-*       rows and digest of every partition after run n; the highest n counts

def _same(keys: Sequence[str], left: DataFrame, right: DataFrame, also: Sequence[str] = ()) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in [*keys, *also]])


def partition_manifest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, rows and digest of each partition.  The digest is a sum of row hashes: it doesn't depend on
    the rows' order, tells repeated rows, and is summed map-side."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest"))


def _manifest_schema(schema: T.StructType, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[T.StructField(k, schema[k].dataType) for k in keys], T.StructField("rows", T.LongType()), T.StructField("digest", T.DecimalType(38, 0))])


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished manifests: names of folders, one for each run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame | None:
    runs = _runs(spark, path)
    return spark.read.schema(_manifest_schema(schema, keys)).parquet(f"{path}/manifest/{runs[-1]}") if runs else None


def write_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """``df`` into the partitioned table at ``path`` (B1): partitions that it has rows of are replaced whole,
    others stay.  Returns how many were written: a rerun with the same rows writes none, and leaves
    every file as it is.

    The rows are staged first, so that what is counted is what is written even where ``df`` would come out
    otherwise a second time.  A partition goes by what the manifest says of it; the manifest is
    written after the data, so a run that broke off is made good by the next one.  One writer at a
    time.  Rows are dealt out by partition and a hash of the row, so that a partition that holds most of
    the rows isn't one task's."""
    spark, schema = df.sparkSession, df.schema
    rows = staged(df, "sink")
    new = staged(partition_manifest(rows, keys), "manifest")
    old = read_manifest(spark, path, schema, keys)
    changed = new if old is None else new.join(old, _same(keys, new, old, ["rows", "digest"]), "left_anti")
    changed = staged(changed, "changed")
    n = changed.count()
    if not n:
        return 0
    hit = changed.select(*[F.col(k).alias(f"_{k}") for k in keys])
    mine = rows.join(hit, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_semi")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(8))
    (mine.repartition(*[F.col(k) for k in keys], spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(f"{path}/data"))
    whole = new if old is None else new.unionByName(old.join(new, _same(keys, old, new), "left_anti"))
    runs = _runs(spark, path)
    whole.write.parquet(f"{path}/manifest/{(runs[-1] if runs else 0) + 1}")
    return n


def read_partitions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``write_partitions`` wrote, with the columns' types and order as they were given."""
    return spark.read.schema(schema).parquet(f"{path}/data").select(*schema.names)


def broken_partitions(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """``keys`` of the partitions whose rows aren't what the manifest says: none after a whole run."""
    told = read_manifest(spark, path, schema, keys)
    there = partition_manifest(read_partitions(spark, path, schema), keys)
    if told is None:
        return there.select(*keys)
    lost = told.join(there, _same(keys, told, there, ["rows", "digest"]), "left_anti").select(*keys)
    more = there.join(told, _same(keys, there, told), "left_anti").select(*keys)
    return lost.unionByName(more)
