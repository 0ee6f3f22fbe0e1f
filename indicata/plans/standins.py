"""Stand-ins for the reference's inputs, derived by Spark from the given
tables (``/root/testdata/sf*/``).  The same derivations appear in the SQL
oracle (``indicata.plans.oracle``), so both sides read identical inputs.

person microdata  <- lineitem   (one row per person, household = order)
household file    <- orders     (weights derived from the order key)
geography         <- customer -> nation -> region
facility register <- orders (+ customer geography)
code list         <- part       (code = part key, description = part type)
yearly series     <- events by day
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indicata.operators.households import order_key
from indicata.operators.survey import ReplicateDesign

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed values of the stand-in mapping (shared with the SQL oracle).
HOUSEHOLD_WEIGHT_MOD = 97
HOUSEHOLD_REP_MOD = 11
HOUSEHOLD_REP_SHIFT = 5
PERSON_WEIGHT_MOD = 89
PERSON_REP_MOD = 7
PERSON_REP_SHIFT = 3
REPLICATES = 80
VACANT_STATUS = "P"
RENT_DIVISOR = 5000
PERSON_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_shipdate")
# descriptions in the code list that count for the ancestry flag
CODE_LIST_DESCRIPTIONS = ("PROMO", "SMALL")

HH_DESIGN = ReplicateDesign.acs("WGTP", REPLICATES)
PERSON_DESIGN = ReplicateDesign.acs("PWGTP", REPLICATES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table as it is now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _weight_exprs(key: str, mod: int, rep_mod: int, shift: int, prefix: str,
                  replicates: bool = True, full: bool = True) -> list[str]:
    """Weight columns as SQL expressions: one JVM parse each instead of a
    chain of Python-side Column calls for 81 columns."""
    w0 = f"({key} % {mod} + 1)"
    out = [f"{w0} AS `{prefix}`"] if full else []
    if replicates:
        out += [f"{w0} + ({key} * {k}) % {rep_mod} - {shift} AS `{prefix}{k}`"
                for k in range(1, REPLICATES + 1)]
    return out


def household_weights(key: str, prefix: str = "WGTP", **kw) -> list[str]:
    return _weight_exprs(key, HOUSEHOLD_WEIGHT_MOD, HOUSEHOLD_REP_MOD, HOUSEHOLD_REP_SHIFT, prefix, **kw)


def person_weights(key: str, prefix: str = "PWGTP", **kw) -> list[str]:
    return _weight_exprs(key, PERSON_WEIGHT_MOD, PERSON_REP_MOD, PERSON_REP_SHIFT, prefix, **kw)


def persons(spark: SparkSession, sf_dir: str, with_weights: bool = False) -> DataFrame:
    """Person microdata: codes as text with nulls where the reference's traps need them."""
    li = table(spark, sf_dir, "lineitem")
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    cols = [
        F.col("l_orderkey").alias("SERIALNO"),
        *[F.col(c) for c in PERSON_ORDER],
        F.col("l_quantity").cast("int").alias("AGEP"),
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice") / F.col("l_quantity") / 10).alias("POVPIP"),
        F.when(F.col("l_returnflag") == "N", "01").when(F.col("l_returnflag") == "R", "02").alias("HISP"),
        F.when(F.col("l_discount") != 0, (pk % 9 + 1).cast("string")).alias("RAC1P"),
        F.when(sk % 3 == 0, "0").when(sk % 3 == 1, "1").alias("RACAIAN"),
        F.when(pk % 5 == 0, "1").otherwise("0").alias("RACPI"),
        F.when(sk % 7 == 0, "1").when(sk % 7 != 1, "0").alias("RACNH"),
        pk.cast("string").alias("ANC1P"),
        F.when(F.col("l_linenumber") % 2 == 0, sk.cast("string")).alias("ANC2P"),
    ]
    df = li.select(*cols)
    if with_weights:
        df = df.selectExpr("*", *person_weights("(SERIALNO + l_linenumber)"))
    return df


def households(spark: SparkSession, sf_dir: str, with_replicates: bool = False) -> DataFrame:
    """Household file: key, customer (for the area) and the full-sample
    weight.  The stand-in's replicate weights are a function of the key, so
    plans add them with ``add_household_replicates`` after the joins: rows
    cross the shuffles narrow, and the 80 derived columns only feed the
    map-side partial aggregate."""
    o = table(spark, sf_dir, "orders")
    # a pending order is a vacant unit: a household without a weight (C4); the rent share is of its price
    weights = household_weights("o_orderkey", replicates=with_replicates)
    weights[0] = f"CASE WHEN o_orderstatus <> '{VACANT_STATUS}' THEN o_orderkey % {HOUSEHOLD_WEIGHT_MOD} + 1 END AS WGTP"
    return o.selectExpr("o_orderkey AS SERIALNO", "o_custkey", f"CAST(floor(o_totalprice / {RENT_DIVISOR}) AS INT) AS GRPIP", *weights)


def person_key() -> Column:
    """``PERSON_ORDER`` as one number: lines to 62, parts to 68 billion, suppliers to a billion, whole
    quantities to 126, prices in cents to 10 million, days since 1970 to 2059."""
    cents = F.round(F.col("l_extendedprice") * 100)
    return order_key([("l_linenumber", 6), ("l_partkey", 36), ("l_suppkey", 30), ("l_quantity", 7), (cents, 30),
                      (F.unix_date(F.col("l_shipdate").cast("date")), 15)])


def add_household_replicates(df: DataFrame, key: str = "SERIALNO") -> DataFrame:
    return df.selectExpr("*", *household_weights(key, full=False))


def add_person_weights(df: DataFrame, serial: str = "SERIALNO", line: str = "l_linenumber") -> DataFrame:
    return df.selectExpr("*", *person_weights(f"({serial} + {line})"))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> area: ``geoid`` = region name, ``area`` = nation name.

    nation and region are bounded code tables (25 and 5 rows by
    construction), so they are broadcast; the customer side is left to the
    planner (AQE broadcasts it only when its measured size allows).
    """
    nat = table(spark, sf_dir, "nation")
    reg = table(spark, sf_dir, "region")
    places = F.broadcast(nat.join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey)
                         .select("n_nationkey", "n_name", "r_name"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (c.join(places, c.c_nationkey == places.n_nationkey)
             .select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("geoid"),
                     F.col("n_name").alias("area"), F.col("c_nationkey").alias("nationkey"),
                     "c_mktsegment"))


def code_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code list read as text, key renamed (A5)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("ANC_Code"),
                    F.col("p_type").alias("Description"))
