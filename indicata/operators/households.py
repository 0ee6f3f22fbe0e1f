"""Person -> household selection.

The reference keeps, per household, the first eligible person in file
order (``distinct(SERIALNO, .keep_all = TRUE)``); that person's recodes and
income ratio become the household's.  Here "first" is an explicit ordering
(T4) and the pick is an aggregate, ``min(struct(order..., row))``: it is
computed partially on the map side, so a household holding a large share of
all rows is reduced inside each task before anything is shuffled, and the
result is deterministic, unlike ``dropDuplicates``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indicata.functions.scalars import contains_any


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              keep: Sequence[str] | None = None) -> DataFrame:
    """First row per ``keys`` by ascending ``order`` (F1). Nulls in an order
    column sort first, as in Spark's struct ordering."""
    keys = list(keys)
    payload = list(keep) if keep is not None else [c for c in df.columns if c not in keys]
    order_fields = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    row = F.struct(*[F.col(c) for c in payload]) if payload else F.struct(F.lit(True).alias("_"))
    best = F.min(F.struct(*order_fields, row.alias("_row")))
    return (df.groupBy(*keys).agg(best.alias("_best"))
              .select(*keys, *[F.col(f"_best._row.{c}").alias(c) for c in payload]))


def order_key(columns: Sequence[tuple[Column | str, int]]) -> Column:
    """The values of non-negative whole-number columns as one number that sorts as they do, column by
    column: each has a number of bits, 126 in all at most.  A null sorts first; a value that doesn't
    fit its bits is an error, never a wrong order.

    Up to 63 bits make a long, more a decimal: both are of fixed width, so that a hash aggregate can
    keep the least of them in place, which it can't do with a struct or a text."""
    total = sum(bits for _, bits in columns)
    if total > 126:
        raise ValueError(f"{total} bits; a key has 126 at most")
    words: list[tuple[Column, int]] = []
    for c, bits in columns:
        c = F.col(c) if isinstance(c, str) else c
        whole = c.cast("long")
        fits = (whole >= 0) & (whole < (1 << bits) - 1)
        # one more than the value, so that 0 is left for null
        part = F.when(c.isNull(), F.lit(0).cast("long")).when(fits, whole + 1).otherwise(
            F.raise_error(F.concat(F.lit(f"a value of an order key doesn't fit {bits} bits: "), c.cast("string"))).cast("long"))
        if words and words[-1][1] + bits <= 63:
            words[-1] = (F.shiftleft(words[-1][0], bits).bitwiseOR(part), words[-1][1] + bits)
        else:
            words.append((part, bits))
    key, _ = words[0]
    for word, bits in words[1:]:
        key = (key.cast("decimal(38,0)") * F.lit(1 << bits).cast(f"decimal({len(str(1 << bits))},0)")).cast("decimal(38,0)") + word.cast("decimal(19,0)")
        key = key.cast("decimal(38,0)")
    return key


def first_by_key(df: DataFrame, keys: Sequence[str], key: Column, values: Sequence[str],
                 population: dict[str, Column | None] | None = None) -> DataFrame:
    """First row per ``keys`` by an ``order_key`` (F1): ``keys`` and ``values``, which have to be of
    fixed width (numbers, dates, booleans).  With ``population`` (label to filter, None for all),
    the first row of each: conditional minima of one hash aggregate, so that no row is copied for
    the populations it belongs to, and nothing is sorted."""
    wide = [c for c in values if not _fixed_width(df.schema[c].dataType.simpleString())]
    if wide:
        raise ValueError(f"columns of varying width: {wide}; use first_per")
    runs = population or {"": None}
    rows = df.withColumn("_key", key)
    aggs, entries = [], []
    for i, (label, cond) in enumerate(runs.items()):
        own = F.when(cond, F.col("_key")) if cond is not None else F.col("_key")
        aggs.append(F.min(own).alias(f"_k{i}"))
        aggs += [F.min_by(F.col(c), own).alias(f"_v{i}_{j}") for j, c in enumerate(values)]
        entries.append(F.struct(F.lit(label).alias("population"), F.col(f"_k{i}").alias("_k"), *[F.col(f"_v{i}_{j}").alias(c) for j, c in enumerate(values)]))
    best = rows.groupBy(*keys).agg(*aggs)
    if population is None:
        return best.select(*keys, *[F.col(f"_v0_{j}").alias(c) for j, c in enumerate(values)])
    return best.select(*keys, F.inline(F.array(*entries))).filter(F.col("_k").isNotNull()).drop("_k")


def _fixed_width(name: str) -> bool:
    return name in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or name.startswith("decimal")


def attach_household(persons: DataFrame, households: DataFrame, keys: Sequence[str],
                     how: str = "left", never_null: Sequence[str] = ()) -> DataFrame:
    """Person ⟕ household on the shared keys (D1).  A null key matches a null
    key, as in the reference (T11): a vintage's blank area column is read as
    null on both sides.  Keys named in ``never_null`` join by plain equality,
    which keeps a bucketed layout free of shuffles.  Non-key columns must not
    collide; prefix them before calling."""
    clash = (set(persons.columns) & set(households.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides besides the keys: {sorted(clash)}")
    right = households.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    pairs = [F.col(k) == F.col(f"_right_{k}") if k in never_null else F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return persons.join(right, pairs, how).drop(*[f"_right_{k}" for k in keys])


def in_universe(df: DataFrame, column: str) -> DataFrame:
    """Rows inside the estimation universe: non-null ratio."""
    return df.filter(F.col(column).isNotNull())


def in_area(df: DataFrame, columns: Sequence[str], code: str) -> DataFrame:
    """Substring match of an area code on one or more area columns, OR-ed."""
    return df.filter(contains_any(columns, code))


def threshold(column: str, cut: float, low: str, high: str) -> Column:
    """Two labels by ``column <= cut`` (C5).  A null stays null."""
    c = F.col(column)
    return F.when(c <= F.lit(cut), F.lit(low)).when(c > F.lit(cut), F.lit(high))


def eligible_households(persons: DataFrame, households: DataFrame, *, serial: str,
                        join_keys: Sequence[str], order: Sequence[str], universe: str,
                        weight: str, person_filter: Column | None = None,
                        population: dict[str, Column | None] | None = None,
                        keep: Sequence[str] | None = None, key: Column | None = None) -> DataFrame:
    """Households represented by their first eligible person.

    ``population`` maps a label to an extra person filter (``None`` = all
    persons).  All populations come out of one scan and one aggregate: each
    person row is tagged with every population it belongs to, and the first
    person is picked per (population, household).  The reference repeats the
    whole selection once per population.

    The reference joins households before picking the person; the join key
    is the household key and the weight test is a household property, so
    picking first and joining after gives the same rows with one row per
    household going into the join.  With a ``key`` (``order_key``) and kept columns of fixed
    width, the pick is a hash aggregate of conditional minima (``first_by_key``) in place of
    a sorted one over rows copied for each population.
    """
    p = persons.filter(F.col(universe).isNotNull())
    if person_filter is not None:
        p = p.filter(person_filter)
    keys = [serial]
    if key is not None and keep is not None:
        extra = [k for k in join_keys if k != serial]
        first = first_by_key(p, [serial, *extra], key, [c for c in keep if c not in join_keys], population)
        joined = attach_household(first, households, join_keys, "left", never_null=[serial])
        return joined.filter(F.col(weight).isNotNull())
    if population:
        tags = [F.when(cond, F.lit(label)) if cond is not None else F.lit(label)
                for label, cond in population.items()]
        p = p.withColumn("population", F.explode(F.array(*tags))).filter(F.col("population").isNotNull())
        keys = ["population", serial]
    extra = [k for k in join_keys if k not in keys]
    payload = None if keep is None else [c for c in keep if c not in keys + extra]
    first = first_per(p, keys + extra, order, keep=payload)
    joined = attach_household(first, households, join_keys, "left", never_null=[serial])
    return joined.filter(F.col(weight).isNotNull())
