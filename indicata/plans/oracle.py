"""DuckDB SQL for the correctness gate.

Each statement recomputes a registered query from the raw tables with the
same stand-in derivations as ``standins.py``.  Arithmetic is written in the
same order as the Spark expressions (left-to-right sums of squared
deviations, the same divisions), so doubles agree to the last bit.
"""

from __future__ import annotations

from indicata.operators import recode as RC
from indicata.operators.survey import ACS_SCALE, Z90
from indicata.plans import feed_queries as FQ
from indicata.plans import register_queries as RQ
from indicata.plans import report_queries as RP
from indicata.plans import spatial_queries as SP
from indicata.plans import standins as S
from indicata.plans import survey_queries as SQ

R = S.REPLICATES


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def person_cte(with_weights: bool = False) -> str:
    w = ""
    if with_weights:
        key = "(l_orderkey + l_linenumber)"
        w0 = f"({key} % {S.PERSON_WEIGHT_MOD} + 1)"
        w = ", " + f"{w0} AS PWGTP, " + ", ".join(
            f"{w0} + ({key} * {k}) % {S.PERSON_REP_MOD} - {S.PERSON_REP_SHIFT} AS PWGTP{k}"
            for k in range(1, R + 1))
    return f"""
  SELECT l_orderkey AS SERIALNO, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_shipdate,
         CAST(l_quantity AS INTEGER) AS AGEP,
         CASE WHEN l_tax <> 0 THEN l_extendedprice / l_quantity / 10 END AS POVPIP,
         CASE WHEN l_returnflag = 'N' THEN '01' WHEN l_returnflag = 'R' THEN '02' END AS HISP,
         CASE WHEN l_discount <> 0 THEN CAST(l_partkey % 9 + 1 AS VARCHAR) END AS RAC1P,
         CASE WHEN l_suppkey % 3 = 0 THEN '0' WHEN l_suppkey % 3 = 1 THEN '1' END AS RACAIAN,
         CASE WHEN l_partkey % 5 = 0 THEN '1' ELSE '0' END AS RACPI,
         CASE WHEN l_suppkey % 7 = 0 THEN '1' WHEN l_suppkey % 7 <> 1 THEN '0' END AS RACNH,
         CAST(l_partkey AS VARCHAR) AS ANC1P,
         CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS ANC2P{w}
  FROM lineitem"""


def household_cte() -> str:
    w0 = f"(o_orderkey % {S.HOUSEHOLD_WEIGHT_MOD} + 1)"
    ws = ", ".join(f"{w0} + (o_orderkey * {k}) % {S.HOUSEHOLD_REP_MOD} - {S.HOUSEHOLD_REP_SHIFT} AS WGTP{k}"
                   for k in range(1, R + 1))
    return (f"SELECT o_orderkey AS SERIALNO, o_custkey, CASE WHEN o_orderstatus <> '{S.VACANT_STATUS}' THEN {w0} END AS WGTP, "
            f"CAST(floor(o_totalprice / {S.RENT_DIVISOR}) AS INTEGER) AS GRPIP, {ws} FROM orders")


GEO_CTE = """
  SELECT c_custkey AS o_custkey, r_name AS geoid, n_name AS area, c_nationkey AS nationkey,
         c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

ORDER_SQL = ", ".join(S.PERSON_ORDER)

RECODE_SQL = f"""
  CASE WHEN coalesce(HISP = '01', false) THEN '{RC.NOT_LATINX}' ELSE '{RC.LATINX}' END AS latino,
  CASE WHEN coalesce(RACAIAN = '0', false) THEN '{RC.NOT_AIAN}' ELSE '{RC.AIAN}' END AS aian,
  CASE WHEN RACPI IS NOT DISTINCT FROM '1' OR RACNH IS NOT DISTINCT FROM '1'
       THEN '{RC.NHPI}' ELSE '{RC.NOT_NHPI}' END AS nhpi,
  CASE WHEN a1.ANC_Code IS NOT NULL OR a2.ANC_Code IS NOT NULL THEN '{RC.SWANA}' ELSE '{RC.NOT_SWANA}' END AS swana"""

RACE_SQL = f"""
  CASE WHEN RAC1P IS NULL THEN NULL
       WHEN RAC1P = '1' AND latino = '{RC.NOT_LATINX}' THEN '{RC.WHITE_NL}'
       WHEN RAC1P = '1' AND NOT (latino = '{RC.NOT_LATINX}') THEN '{RC.LATINX_PLACEHOLDER}'
       WHEN RAC1P = '2' AND latino = '{RC.NOT_LATINX}' THEN '{RC.BLACK_NL}'
       WHEN RAC1P IN ('3', '4', '5') THEN '{RC.AIAN_PLACEHOLDER}'
       WHEN RAC1P = '6' AND latino = '{RC.NOT_LATINX}' THEN '{RC.ASIAN_NL}'
       WHEN RAC1P = '7' THEN '{RC.NHPI_PLACEHOLDER}'
       WHEN RAC1P = '8' AND latino = '{RC.NOT_LATINX}' THEN '{RC.OTHER_NL}'
       WHEN RAC1P = '9' AND latino = '{RC.NOT_LATINX}' THEN '{RC.MULTI_NL}'
       ELSE '{RC.LATINX_PLACEHOLDER}' END AS race"""


def recoded_people_cte(kids: bool = False, with_weights: bool = False) -> str:
    descs = ", ".join(f"'{d}'" for d in S.CODE_LIST_DESCRIPTIONS)
    race = RACE_SQL.replace("WHEN RAC1P = '7' THEN", f"WHEN RAC1P = '7' AND latino = '{RC.NOT_LATINX}' THEN") \
        if kids else RACE_SQL
    return f"""
  SELECT r.*, {race} FROM (
    SELECT p.*, {RECODE_SQL}
    FROM ({person_cte(with_weights)}) p
    LEFT JOIN (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS ANC_Code FROM part
               WHERE p_type IN ({descs})) a1 ON p.ANC1P = a1.ANC_Code
    LEFT JOIN (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS ANC_Code FROM part
               WHERE p_type IN ({descs})) a2 ON p.ANC2P = a2.ANC_Code) r"""


# ---------------------------------------------------------------- estimators

def se_sql(est: str, reps: list[str]) -> str:
    """sqrt(scale * sum((rep - est)^2)), left to right, undefined terms 0."""
    c = f"CAST({est} AS DOUBLE)"
    terms = " + ".join(
        f"coalesce((CAST({r} AS DOUBLE) - {c}) * (CAST({r} AS DOUBLE) - {c}), {dbl(0.0)})" for r in reps)
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE sqrt({dbl(ACS_SCALE)} * ({terms})) END"


def ratio_sql(num: str, den: str) -> str:
    return (f"CASE WHEN CAST({den} AS DOUBLE) = 0 THEN NULL "
            f"ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END")


def totals_sql(weights: list[str]) -> str:
    return ", ".join(f"sum({w}) AS _t{i}" for i, w in enumerate(weights))


def hh_weights() -> list[str]:
    return ["WGTP"] + [f"WGTP{k}" for k in range(1, R + 1)]


def person_weights() -> list[str]:
    return ["PWGTP"] + [f"PWGTP{k}" for k in range(1, R + 1)]


def total_se_select(keys: list[str], name: str = "num") -> str:
    return (", ".join(keys) + f", CAST(_t0 AS DOUBLE) AS {name}, "
            + se_sql("_t0", [f"_t{i}" for i in range(1, R + 1)]) + f" AS {name}_se")


def rate_sql(cells: str, within: list[str], indicator: str) -> str:
    """Rate, SEs, MOE and CV from a cells relation with _t0.._tR."""
    part = ", ".join(within)
    pars = ", ".join(f"sum(_t{i}) OVER (PARTITION BY {part}) AS _p{i}" for i in range(R + 1))
    theta = [ratio_sql(f"_t{i}", f"_p{i}") for i in range(R + 1)]
    z, h = dbl(Z90), dbl(100.0)
    keys = ", ".join(within + [indicator])
    est = f"""
    SELECT {keys},
      CAST(_t0 AS DOUBLE) AS num,
      {se_sql('_t0', [f'_t{i}' for i in range(1, R + 1)])} AS num_se,
      {theta[0]} AS _rate,
      {se_sql(f'({theta[0]})', [f'({t})' for t in theta[1:]])} AS rate_se,
      CAST(_p0 AS DOUBLE) AS pop,
      {se_sql('_p0', [f'_p{i}' for i in range(1, R + 1)])} AS pop_se
    FROM (SELECT *, {pars} FROM ({cells}) c) w"""
    rate_moe = f"(rate_se * {z} * {h})"
    pct = f"(_rate * {h})"
    count_moe = f"(num_se * {z})"
    return f"""
  SELECT {keys}, num, num_se, {pct} AS rate, rate_se, pop, pop_se,
    {rate_moe} AS rate_moe,
    (CASE WHEN {pct} = 0 THEN NULL ELSE ({rate_moe} / {z}) / {pct} END) * {h} AS rate_cv,
    {count_moe} AS count_moe,
    (CASE WHEN num = 0 THEN NULL ELSE ({count_moe} / {z}) / num END) * {h} AS count_cv
  FROM ({est}) e"""


def eligible_sql(population: dict[str, str | None] | None = None, person_filter: str | None = None,
                 recoded: bool = False) -> str:
    """Households with their first eligible person, weights and area."""
    src = recoded_people_cte() if recoded else person_cte()
    where = "POVPIP IS NOT NULL" + (f" AND ({person_filter})" if person_filter else "")
    if population:
        parts = []
        for label, cond in population.items():
            extra = f" AND ({cond})" if cond else ""
            parts.append(f"SELECT '{label}' AS population, * FROM ({src}) p WHERE {where}{extra}")
        tagged = " UNION ALL ".join(parts)
        keys = "population, SERIALNO"
    else:
        tagged = f"SELECT * FROM ({src}) p WHERE {where}"
        keys = "SERIALNO"
    first = f"""
    SELECT * EXCLUDE (_rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ORDER_SQL}) AS _rn FROM ({tagged}) t
    ) x WHERE _rn = 1"""
    return f"""
  SELECT f.*, h.* EXCLUDE (SERIALNO), g.geoid
  FROM ({first}) f
  LEFT JOIN ({household_cte()}) h ON f.SERIALNO = h.SERIALNO
  LEFT JOIN ({GEO_CTE}) g ON h.o_custkey = g.o_custkey
  WHERE h.WGTP IS NOT NULL"""


def indicator_sql(cut: float) -> str:
    return (f"CASE WHEN POVPIP <= {dbl(cut)} THEN 'at or below poverty' "
            f"WHEN POVPIP > {dbl(cut)} THEN 'above poverty' END")


def q_eligible_households() -> str:
    return f"""
  SELECT SERIALNO, geoid, l_linenumber, AGEP, POVPIP, WGTP, WGTP80, {indicator_sql(100)} AS indicator
  FROM ({eligible_sql(person_filter='AGEP < 5')}) e"""


def q_poverty_by_area(cut: float = 100) -> str:
    el = eligible_sql(population={"under 5": "AGEP < 5", "all": None})
    cells = f"""
    SELECT population, geoid, indicator, {totals_sql(hh_weights())}
    FROM (SELECT *, {indicator_sql(cut)} AS indicator FROM ({el}) e) x
    GROUP BY population, geoid, indicator"""
    return f"""SELECT * FROM ({rate_sql(cells, ['population', 'geoid'], 'indicator')}) r
  WHERE indicator = 'at or below poverty' AND geoid IS NOT NULL"""


def q_survey_total() -> str:
    el = eligible_sql(person_filter="AGEP < 5")
    cells = f"""
    SELECT geoid, indicator, {totals_sql(hh_weights())}
    FROM (SELECT *, {indicator_sql(138)} AS indicator FROM ({el}) e) x
    GROUP BY geoid, indicator"""
    return f"SELECT {total_se_select(['geoid', 'indicator'])} FROM ({cells}) c"


def q_survey_rate() -> str:
    el = eligible_sql(person_filter="AGEP < 5")
    cells = f"""
    SELECT geoid, indicator, {totals_sql(hh_weights())}
    FROM (SELECT *, {indicator_sql(138)} AS indicator FROM ({el}) e) x
    GROUP BY geoid, indicator"""
    return rate_sql(cells, ["geoid"], "indicator")


def q_person_weighted_rate() -> str:
    cells = f"""
    SELECT geoid, age_group, {totals_sql(person_weights())}
    FROM (SELECT p.*, g.geoid,
            CASE WHEN AGEP < 5 THEN 'Under 5' WHEN AGEP >= 5 THEN 'Not under 5' END AS age_group
          FROM ({person_cte(True)}) p
          JOIN orders o ON p.SERIALNO = o.o_orderkey
          LEFT JOIN ({GEO_CTE}) g ON o.o_custkey = g.o_custkey) x
    GROUP BY geoid, age_group"""
    return rate_sql(cells, ["geoid"], "age_group")


RECODE_OUT = "latino, aian, nhpi, swana, race"


def q_exclusive_category() -> str:
    return f"SELECT race, latino, count(*) AS persons FROM ({recoded_people_cte()}) r GROUP BY race, latino"


def q_null_safe_flags() -> str:
    return f"SELECT latino, aian, nhpi, count(*) AS persons FROM ({recoded_people_cte()}) r GROUP BY latino, aian, nhpi"


def q_code_list_flag() -> str:
    cols = ORDER_SQL.replace("l_shipdate", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate")
    return f"SELECT SERIALNO, {cols}, ANC1P, ANC2P, swana FROM ({recoded_people_cte()}) r"


SUPPRESSED = RC.SUPPRESSED_SUBGROUPS


DIMS = ["latino", "aian", "nhpi", "swana", "race"]


def breakdown_sql(rows: str, indicator: str, weights: list[str], level: str) -> str:
    """Rates of one level of an indicator for the five dimensions and the Total, unsuppressed."""
    fine = f"SELECT geoid, {', '.join(DIMS)}, {indicator}, {totals_sql(weights)} FROM ({rows}) x GROUP BY geoid, {', '.join(DIMS)}, {indicator}"
    tsum = ", ".join(f"sum(_t{i}) AS _t{i}" for i in range(R + 1))
    unions = " UNION ALL ".join(
        [f"SELECT geoid, '{d}' AS dimension, CAST({d} AS VARCHAR) AS subgroup, {indicator}, {tsum} "
         f"FROM fine GROUP BY geoid, {d}, {indicator}" for d in DIMS]
        + [f"SELECT geoid, 'total' AS dimension, 'Total' AS subgroup, {indicator}, {tsum} FROM fine GROUP BY geoid, {indicator}"])
    return f"""
  WITH fine AS ({fine})
  SELECT * FROM ({rate_sql(unions, ['geoid', 'dimension', 'subgroup'], indicator)}) r WHERE {indicator} = '{level}'"""


def suppressed_sql() -> str:
    return ", ".join(f"'{s}'" for s in SUPPRESSED)


def q_survey_breakdown(cut: float = 100) -> str:
    el = eligible_sql(person_filter="AGEP < 5", recoded=True)
    rows = f"SELECT *, {indicator_sql(cut)} AS indicator FROM ({el}) e"
    return f"""
  SELECT * FROM ({breakdown_sql(rows, 'indicator', hh_weights(), SQ.AT_OR_BELOW)}) b
  WHERE subgroup IS NOT NULL AND subgroup NOT IN ({suppressed_sql()})"""


def q_rent_burden_breakdown() -> str:
    el = eligible_sql(person_filter="AGEP < 5", recoded=True)
    rows = (f"SELECT *, CASE WHEN GRPIP > {SQ.BURDEN_CUT} THEN '{SQ.BURDENED}' WHEN GRPIP <= {SQ.BURDEN_CUT} THEN '{SQ.NOT_BURDENED}' END AS indicator "
            f"FROM ({el}) e")
    return f"""
  SELECT * FROM ({breakdown_sql(rows, 'indicator', hh_weights(), SQ.BURDENED)}) b
  WHERE subgroup IS NOT NULL AND subgroup NOT IN ({suppressed_sql()})"""


# ------------------------------------------------------------- register

def register_sql() -> str:
    pri = ", ".join(f"'{p}'" for p in RQ.CENTER_PRIORITIES)
    return f"""
  SELECT CASE WHEN o_orderpriority IN ({pri}) THEN '{RQ.CENTER}' ELSE '{RQ.HOME}' END AS facility_type,
         g.geoid AS county_name,
         CASE WHEN o_totalprice >= {RQ.KNOWN_FROM} THEN CAST(floor(o_totalprice / 10000) AS INTEGER) END AS facility_capacity,
         CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'LICENSED'
              ELSE o_orderstatus END AS facility_status,
         CAST(o_orderdate AS DATE) AS closed_date,
         CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS open,
         CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS close,
         strftime(CAST(o_orderdate AS DATE), '%m') AS month,
         strftime(CAST(o_orderdate AS DATE), '%Y') AS year
  FROM orders o LEFT JOIN ({GEO_CTE}) g ON o.o_custkey = g.o_custkey"""


def strict_sql(c: str) -> str:
    return f"CAST(CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN NULL ELSE sum({c}) END AS BIGINT)"


def tagged_sql() -> str:
    return f"""
  SELECT *, '{RQ.WHOLE}' AS geography FROM ({register_sql()}) r
  UNION ALL SELECT *, '{RQ.FOCUS}' AS geography FROM ({register_sql()}) r WHERE county_name = '{RQ.FOCUS}'"""


def q_closures_by_month() -> str:
    yrs = ", ".join(f"'{y}'" for y in RQ.YEARS)
    return f"""
  SELECT facility_type, geography, year, month, {strict_sql('close')} AS closed,
         {strict_sql('facility_capacity')} AS seats
  FROM ({tagged_sql()}) t
  WHERE year IN ({yrs}) AND open = 0 AND closed_date IS NOT NULL
  GROUP BY facility_type, geography, year, month"""


def q_closures_by_day() -> str:
    return f"""
  SELECT facility_type, geography, strftime(closed_date, '%Y-%m-%d') AS day, {strict_sql('close')} AS closed,
         {strict_sql('facility_capacity')} AS seats
  FROM ({tagged_sql()}) t
  WHERE year = '{RQ.DAY_YEAR}' AND closed_date IS NOT NULL
  GROUP BY facility_type, geography, closed_date"""


def q_mean_of_sums() -> str:
    return f"""
  SELECT facility_type, geography, year, avg(closed) AS mean_closed
  FROM ({q_closures_by_month()}) m GROUP BY facility_type, geography, year"""


def q_closure_summary() -> str:
    yearly = f"""
    SELECT facility_type, geography, year, {strict_sql('closed')} AS closed,
           {strict_sql('seats')} AS seats
    FROM ({q_closures_by_month()}) m GROUP BY facility_type, geography, year"""
    long = f"""
    SELECT year, geography, facility_type || '{RQ.CLOSURES}' AS type, closed AS value FROM ({yearly}) y
    UNION ALL
    SELECT year, geography, facility_type || '{RQ.SEATS}' AS type, seats AS value FROM ({yearly}) y"""
    return f"""
  SELECT year, type,
         first(value) FILTER (WHERE geography = '{RQ.WHOLE}') AS "{RQ.WHOLE}",
         first(value) FILTER (WHERE geography = '{RQ.FOCUS}') AS "{RQ.FOCUS}"
  FROM ({long}) l GROUP BY year, type"""


def q_closure_table() -> str:
    cols = ", ".join(f"""format('{{:,}}', "{c}") AS "{c}\"""" for c in (RQ.WHOLE, RQ.FOCUS))
    return f"SELECT year, type, {cols} FROM ({q_closure_summary()}) s"


def q_compare_years() -> str:
    src = f"""
    SELECT * FROM ({register_sql()}) r WHERE county_name = '{RQ.FOCUS}' AND year = '{RQ.YEARS[1]}'
    UNION ALL
    SELECT * FROM ({register_sql()}) r WHERE county_name = '{RQ.FOCUS}' AND year = '{RQ.YEARS[0]}' AND open = 0"""
    monthly = f"""
    SELECT year, month, {strict_sql('close')} AS closed FROM ({src}) s
    WHERE closed_date IS NOT NULL GROUP BY year, month"""
    return f"""
  SELECT year, month, monthname(make_date(2000, CAST(month AS INTEGER), 1)) AS month_name, closed,
         avg(closed) OVER (PARTITION BY year) AS mean
  FROM ({monthly}) m"""


def q_capacity_on_spine() -> str:
    centers = """
    SELECT CAST(s_nationkey AS VARCHAR) AS facility_zip,
           CASE WHEN s_acctbal >= 0 THEN 'LICENSED' ELSE 'CLOSED' END AS facility_status,
           CASE WHEN s_suppkey % 10 = 3 THEN 'n/a'
                ELSE CAST(CAST(floor(abs(s_acctbal) / 100) AS BIGINT) AS VARCHAR) END AS facility_capacity
    FROM supplier"""
    homes = """
    SELECT CAST(c_nationkey AS VARCHAR) AS facility_zip,
           CASE WHEN c_acctbal >= 0 THEN 'LICENSED' ELSE 'CLOSED' END AS facility_status,
           CAST(CAST(floor(abs(c_acctbal) / 1000) AS BIGINT) AS VARCHAR) AS facility_capacity
    FROM customer"""
    spine = "SELECT CAST(n_nationkey AS VARCHAR) AS area FROM nation"

    def agg(src, n, s):
        return f"""
    SELECT facility_zip AS area, count(*) AS {n},
           CASE WHEN count(*) FILTER (WHERE cap IS NULL) > 0 THEN NULL ELSE sum(cap) END AS {s}
    FROM (SELECT *, TRY_CAST(trim(facility_capacity) AS DOUBLE) AS cap FROM ({src}) x
          WHERE facility_status = 'LICENSED' AND facility_zip IN ({spine})) y
    GROUP BY facility_zip"""
    pop = """
    SELECT CAST(c_nationkey AS VARCHAR) AS area, count(*) AS total_0_5,
           sqrt(CAST(count(*) AS DOUBLE)) * CAST(1.645 AS DOUBLE) AS moe_0_5
    FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY c_nationkey"""
    return f"""
  SELECT s.area, coalesce(c.total_centers, 0) AS total_centers,
         coalesce(c.capacity_centers, 0) AS capacity_centers,
         coalesce(h.total_family_homes, 0) AS total_family_homes,
         coalesce(h.capacity_family_homes, 0) AS capacity_family_homes,
         coalesce(p.total_0_5, 0) AS total_0_5, coalesce(p.moe_0_5, 0) AS moe_0_5
  FROM ({spine}) s
  LEFT JOIN ({agg(centers, 'total_centers', 'capacity_centers')}) c ON s.area = c.area
  LEFT JOIN ({agg(homes, 'total_family_homes', 'capacity_family_homes')}) h ON s.area = h.area
  LEFT JOIN ({pop}) p ON s.area = p.area"""


EVENT_ROWS = f"""
  SELECT event_type, CAST(ts AS DATE) AS day, CASE WHEN value >= {RQ.ESTIMATE_FROM} THEN CAST(floor(value) AS BIGINT) END AS estimate,
         CAST(ceil(value / 2) AS BIGINT) AS moe, value
  FROM events"""


def _daily_sql() -> str:
    return f"""
  SELECT event_type, day, CAST(sum(estimate) AS BIGINT) AS population,
         CASE WHEN count(*) FILTER (WHERE estimate IS NULL OR moe IS NULL) > 0 THEN NULL ELSE sqrt(sum(CASE WHEN estimate <> 0 THEN CAST(moe AS DOUBLE) * CAST(moe AS DOUBLE) ELSE 0.0 END)
              + coalesce(max(CASE WHEN estimate = 0 THEN CAST(moe AS DOUBLE) * CAST(moe AS DOUBLE) END), 0.0)) END AS moe
  FROM ({EVENT_ROWS}) e GROUP BY event_type, day"""


def q_moe_sum() -> str:
    return f"SELECT event_type, strftime(day, '%Y-%m-%d') AS day, population, moe FROM ({_daily_sql()}) d"


def q_impute_gap() -> str:
    s = f"""SELECT event_type, day, CAST(population AS DOUBLE) AS population, moe
            FROM ({_daily_sql()}) m WHERE day <> DATE '{RQ.MISSING_DAY}'"""
    return f"""
  WITH s AS ({s}),
  b AS (SELECT event_type, min(day) AS lo, max(day) AS hi FROM s GROUP BY event_type),
  spine AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
  f AS (SELECT sp.event_type, sp.day, s.population, s.moe, s.day IS NULL AS absent FROM spine sp
        LEFT JOIN s ON sp.event_type = s.event_type AND sp.day = s.day),
  m AS (SELECT *, CASE WHEN absent THEN
      (last_value(population IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
       + first_value(population IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day
         ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) / 2.0 END AS mean FROM f)
  SELECT event_type, strftime(day, '%Y-%m-%d') AS day, coalesce(mean, population) AS population,
    CASE WHEN mean IS NOT NULL THEN 0.0 ELSE moe END AS moe, mean IS NOT NULL AS imputed
  FROM m"""


COUNT_ROWS = """
  SELECT event_type, CAST(ts AS DATE) AS day, CASE WHEN value >= 1 THEN 1 END AS count FROM events"""


def q_sum_strict() -> str:
    return f"""
  SELECT event_type, strftime(day, '%Y-%m-%d') AS day,
         CAST(CASE WHEN count(*) FILTER (WHERE count IS NULL) > 0 THEN NULL ELSE sum(count) END AS DOUBLE) AS strict_total,
         CAST(sum(count) AS BIGINT) AS lenient_total
  FROM ({COUNT_ROWS}) e GROUP BY event_type, day"""


def q_rate_per_base() -> str:
    return f"""
  WITH e AS ({COUNT_ROWS}),
  d AS (SELECT day, CAST(CASE WHEN count(*) FILTER (WHERE count IS NULL) > 0 THEN NULL ELSE sum(count) END AS DOUBLE) AS deaths
        FROM e WHERE event_type = 'error' GROUP BY day),
  b AS (SELECT day, CAST(sum(count) AS DOUBLE) AS births FROM e WHERE event_type = 'view' GROUP BY day)
  SELECT strftime(d.day, '%Y-%m-%d') AS day, deaths, births,
         (CASE WHEN CAST(births AS DOUBLE) = 0 THEN NULL ELSE CAST(deaths AS DOUBLE) / CAST(births AS DOUBLE) END)
           * CAST(1000.0 AS DOUBLE) AS mortality
  FROM d LEFT JOIN b ON d.day = b.day"""


def q_paired_unpivot() -> str:
    parts = []
    for s in RQ.SEGMENTS:
        k = s.lower()
        parts.append(f"""
    SELECT c_nationkey AS county, '{k}' AS stem,
           CAST(count_if(c_mktsegment = '{s}' AND c_acctbal < 0) AS DOUBLE) AS num_value,
           CASE WHEN count_if(c_mktsegment = '{s}') >= 10 THEN
             CAST(count_if(c_mktsegment = '{s}' AND c_acctbal < 0) AS DOUBLE)
             / CAST(count_if(c_mktsegment = '{s}') AS DOUBLE) END AS pct
    FROM customer GROUP BY c_nationkey""")
    long = " UNION ALL ".join(parts)
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RQ.SEGMENT_LABELS.items())
    return f"""
  SELECT county, stem, CASE stem {labels} ELSE 'Machinery' END AS label,
         round_even(num_value, 1) AS num_value, round_even(pct_value, 1) AS pct_value
  FROM (SELECT county, stem, num_value,
               CASE WHEN stem = '{RQ.OVERRIDE_STEM}' THEN {dbl(RQ.OVERRIDE_VALUE)}
                    ELSE pct * CAST(100.0 AS DOUBLE) END AS pct_value
        FROM ({long}) l) x
  WHERE pct_value IS NOT NULL"""


# ------------------------------------------------------------- spatial

def _top_sql() -> str:
    return f"(SELECT (floor(max(c_custkey) / {SP.GRID}) + 1) * {dbl(SP.SIDE)} FROM customer)"


def _spatial_parts() -> str:
    a, t, n = SP.STRIP_X, _top_sql(), SP.NOTCH_Y
    rows = [(0, a[0], a[1], 0, None), (1, a[1], a[2], 0, None), (2, a[2], a[3], 0, None),
            (3, a[3], a[4], n, None), (4, a[4], a[5], 0, None), (4, a[3], a[4], 0, n)]
    sel = " UNION ALL ".join(
        f"SELECT {k} AS k, {dbl(x0)} AS x0, {dbl(x1)} AS x1, {dbl(y0)} AS y0, "
        f"{t if y1 is None else dbl(y1)} AS y1" for k, x0, x1, y0, y1 in rows)
    return f"SELECT * FROM ({sel}) v"


def _puma_rects(clipped: bool) -> str:
    left = f"greatest(x0, {dbl(SP.CLIP_X)})" if clipped else "x0"
    return f"""
    SELECT PUMA, NAMELSAD20, {left} AS x0, x0 + {dbl(SP.SIDE)} AS x1, y0, y0 + {dbl(SP.SIDE)} AS y1 FROM (
      SELECT CAST(c_custkey AS VARCHAR) AS PUMA, c_name AS NAMELSAD20,
             CAST(c_custkey % {SP.GRID} AS DOUBLE) * {dbl(SP.SIDE)} AS x0,
             CAST(floor(c_custkey / {SP.GRID}) AS DOUBLE) * {dbl(SP.SIDE)} AS y0
      FROM customer) n"""


def _spa_parts() -> str:
    return f"""
    SELECT CAST(r_regionkey AS VARCHAR) AS SPA, r_name AS SPA_NAME, x0, x1, y0, y1
    FROM region JOIN ({_spatial_parts()}) p ON r_regionkey = p.k"""


def _xwalk_sql() -> str:
    inter = ("greatest(0.0, least(p.x1, s.x1) - greatest(p.x0, s.x0)) "
             "* greatest(0.0, least(p.y1, s.y1) - greatest(p.y0, s.y0))")
    return f"""
  WITH p AS ({_puma_rects(True)}),
  s AS ({_spa_parts()}),
  sa AS (SELECT SPA, sum((x1 - x0) * (y1 - y0)) AS spa_area FROM s GROUP BY SPA),
  i AS (SELECT p.PUMA, p.NAMELSAD20, s.SPA, s.SPA_NAME, sum({inter}) AS ia,
               max((p.x1 - p.x0) * (p.y1 - p.y0)) AS puma_area
        FROM p JOIN s ON p.x0 < s.x1 AND s.x0 < p.x1 AND p.y0 < s.y1 AND s.y0 < p.y1
        GROUP BY p.PUMA, p.NAMELSAD20, s.SPA, s.SPA_NAME)
  SELECT i.PUMA, NAMELSAD20, i.SPA, SPA_NAME, ia / spa_area AS prc_spas_area, ia / puma_area AS prc_pumas_area
  FROM i JOIN sa ON i.SPA = sa.SPA
  WHERE ia > 0 AND ia / puma_area >= {dbl(SP.MIN_SHARE)}"""


def q_overlay_crosswalk() -> str:
    d = SP.DIGITS
    return f"""SELECT PUMA, NAMELSAD20, SPA, SPA_NAME, round(prc_spas_area, {d}) AS prc_spas_area,
                     round(prc_pumas_area, {d}) AS prc_pumas_area FROM ({_xwalk_sql()}) x"""


def _all_parts() -> str:
    a = SP.STRIP_X
    return f"""
    SELECT 'puma' AS layer, PUMA AS id, x0, x1, y0, y1 FROM ({_puma_rects(False)}) p
    UNION ALL SELECT 'spa', SPA, x0, x1, y0, y1 FROM ({_spa_parts()}) s
    UNION ALL SELECT 'state', 'state', {dbl(SP.CLIP_X)}, {dbl(a[-1])}, {dbl(0.0)}, {_top_sql()}"""


def q_ring_area() -> str:
    return f"""SELECT layer, id, round(sum((x1 - x0) * (y1 - y0)), {SP.DIGITS}) AS area
               FROM ({_all_parts()}) p GROUP BY layer, id"""


def q_ring_centroid() -> str:
    d = SP.DIGITS
    ar = "(x1 - x0) * (y1 - y0)"
    return f"""SELECT layer, id,
                 round(sum({ar} * (x0 + x1) / 2) / sum({ar}), {d}) AS cx,
                 round(sum({ar} * (y0 + y1) / 2) / sum({ar}), {d}) AS cy
               FROM ({_all_parts()}) p GROUP BY layer, id"""


def q_wkt_layers() -> str:
    d = SP.DIGITS
    x0, y0 = f"((c_custkey % {SP.GRID}) * {int(SP.SIDE)})", f"(c_custkey // {SP.GRID} * {int(SP.SIDE)})"
    boxes = [(1, 0, 0, 10, 10), (-1, *SP.HOLE), (1, *SP.ISLAND)]
    area = " + ".join(f"{s * w * h}" for s, _, _, w, h in boxes)
    cx = " + ".join(f"{s * w * h} * ({x0} + {dx} + {w / 2})" for s, dx, _, w, _h in boxes for h in (_h,))
    cy = " + ".join(f"{s * w * h} * ({y0} + {dy} + {h / 2})" for s, _, dy, w, h in boxes)
    return f"""
  SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN CAST({area} AS DOUBLE) ELSE 0.0::DOUBLE END AS area,
         CASE WHEN c_custkey % 7 <> 0 THEN round(({cx})::DOUBLE / ({area}), {d}) END AS cx,
         CASE WHEN c_custkey % 7 <> 0 THEN round(({cy})::DOUBLE / ({area}), {d}) END AS cy
  FROM customer"""


def q_survey_by_crosswalk(cut: float = 100) -> str:
    el = eligible_sql(person_filter="AGEP < 5")
    el = el.replace("g.geoid", "g.nationkey")
    cells = f"""
    SELECT geoid, indicator, {totals_sql(hh_weights())}
    FROM (SELECT e.*, x.SPA_NAME AS geoid, {indicator_sql(cut)} AS indicator
          FROM ({el}) e LEFT JOIN ({_xwalk_sql()}) x ON CAST(e.o_custkey AS VARCHAR) = x.PUMA) y
    GROUP BY geoid, indicator"""
    return f"""SELECT * FROM ({rate_sql(cells, ['geoid'], 'indicator')}) r
  WHERE indicator = 'at or below poverty' AND geoid IS NOT NULL"""


# ------------------------------------------------------------- reports

def _clean_sql(c: str) -> str:
    x = f"regexp_replace({c}, ' NL', '')"
    x = f"regexp_replace({x}, ' Alone or in Combination', '')"
    x = f"regexp_replace({x}, 'Two or More', 'Multiracial')"
    return f"regexp_replace({x}, '^nh_', '')"


def _frame_sql(rows: str, label: str) -> str:
    return f"""
  SELECT geoid, dimension, subgroup, population, total, pct, '{label}' AS "group" FROM (
    SELECT geoid, dimension, {_clean_sql('subgroup')} AS subgroup, num AS population,
           max(CASE WHEN dimension = 'total' THEN num END) OVER (PARTITION BY geoid) AS total
    FROM ({rows}) r) x
  CROSS JOIN LATERAL (SELECT CASE WHEN total = 0 THEN NULL ELSE population / total END * CAST(100.0 AS DOUBLE) AS pct) p
  WHERE dimension <> 'total'"""


def _rate_frame_sql(rows: str, label: str) -> str:
    return f"""
  SELECT geoid, dimension, subgroup, population, rate, total_rate, '{label}' AS "group" FROM (
    SELECT geoid, dimension, {_clean_sql('subgroup')} AS subgroup, num AS population, rate,
           max(CASE WHEN dimension = 'total' THEN rate END) OVER (PARTITION BY geoid) AS total_rate
    FROM ({rows}) r) x
  WHERE dimension <> 'total'"""


def q_indicator_frame() -> str:
    return _frame_sql(q_survey_breakdown(), RP.GROUP_LABEL)


def q_children_frame() -> str:
    return _frame_sql(q_children_by_race(), "Children under 5")


def q_poverty_frame() -> str:
    return _rate_frame_sql(q_survey_breakdown(), RP.POVERTY_GROUP)


def q_rent_burden_frame() -> str:
    return _rate_frame_sql(q_rent_burden_breakdown(), RP.RENT_GROUP)


def _top_of(frame: str, value: str) -> str:
    return f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY {value} DESC NULLS LAST, subgroup) AS rk
                   FROM ({frame}) f) x WHERE rk = 1"""


def q_top_subgroup() -> str:
    return f"SELECT geoid, subgroup, population, pct FROM ({_top_of(q_indicator_frame(), 'population')}) t"


def q_headline() -> str:
    return " UNION ALL ".join(
        f"SELECT geoid, subgroup || '{text}' || geoid AS title, '{frame}' AS frame FROM ({_top_of(rows, value)}) t"
        for rows, value, text, frame in (
            (q_children_frame(), "population", RP.LARGEST, "children"), (q_poverty_frame(), "rate", RP.POVERTY_TITLE, "poverty"),
            (q_rent_burden_frame(), "rate", RP.RENT_TITLE, "rent burden")))


def q_fallback_text() -> str:
    stable = f"coalesce(rate_cv < {dbl(RP.MAX_CV)}, false)"
    sub = f"""
    SELECT *, max(CASE WHEN dimension = 'total' THEN rate END) OVER (PARTITION BY geoid) AS total_rate
    FROM ({q_survey_breakdown()}) r"""
    gated = f"""
    SELECT *, sum(CASE WHEN {stable} THEN 1 ELSE 0 END) OVER (PARTITION BY geoid) AS n_subgroups,
           CASE WHEN {stable} THEN rate END AS stable_rate
    FROM ({sub}) s WHERE dimension <> 'total'"""
    (a, b, c), (d, e, f) = RP.TOTAL_SENTENCE, RP.ONLY_SENTENCE
    txt = f"'{a}' || geoid || '{b}' || CAST(round_even(total_rate, 1) AS VARCHAR) || '{c}'"
    only = f"'{d}' || subgroup || '{e}' || CAST(round_even(rate, 1) AS VARCHAR) || '{f}'"
    return f"""
  SELECT geoid, CAST(n_subgroups AS BIGINT) AS n_subgroups, n_subgroups >= 2 AS chartable,
         CASE WHEN n_subgroups = 0 THEN {txt} WHEN n_subgroups < 2 THEN {txt} || {only} END AS text
  FROM ({_top_of(gated, 'stable_rate')}) b"""


def q_weighted_population() -> str:
    return f"""
  SELECT g.geoid, p.AGEP < 5 AS under_5, CAST(sum(p.PWGTP) AS BIGINT) AS population, count(*) AS persons
  FROM ({person_cte(True)}) p JOIN orders o ON p.SERIALNO = o.o_orderkey
  LEFT JOIN ({GEO_CTE}) g ON o.o_custkey = g.o_custkey
  GROUP BY g.geoid, p.AGEP < 5"""


def q_poverty_runs() -> str:
    el = eligible_sql(population={"under 5": "AGEP < 5", "all": None})
    parts = []
    for c in SQ.CUTS:
        cells = f"""
    SELECT population, {dbl(c)} AS cut, geoid, indicator, {totals_sql(hh_weights())}
    FROM (SELECT *, {indicator_sql(c)} AS indicator FROM ({el}) e) x
    GROUP BY population, geoid, indicator"""
        parts.append(f"SELECT * FROM ({rate_sql(cells, ['population', 'cut', 'geoid'], 'indicator')}) r "
                     f"WHERE indicator = 'at or below poverty' AND geoid IS NOT NULL")
    return " UNION ALL ".join(parts)


def q_children_by_race() -> str:
    rows = f"""
    SELECT p.*, g.geoid, CASE WHEN AGEP < 5 THEN '{SQ.UNDER5}' WHEN AGEP >= 5 THEN '{SQ.NOT_UNDER5}' END AS age_group
    FROM ({recoded_people_cte(kids=True, with_weights=True)}) p
    JOIN orders o ON p.SERIALNO = o.o_orderkey
    LEFT JOIN ({GEO_CTE}) g ON o.o_custkey = g.o_custkey"""
    total = "max(CASE WHEN dimension = 'total' THEN num END) OVER (PARTITION BY geoid)"
    return f"""
  SELECT * FROM (
    SELECT *, (CASE WHEN {total} = 0 THEN NULL ELSE num / {total} END) * {dbl(100.0)} AS pct
    FROM ({breakdown_sql(rows, 'age_group', person_weights(), SQ.UNDER5)}) b) c
  WHERE dimension = 'total' OR subgroup NOT IN ({suppressed_sql()})"""


def _title_sql(c: str) -> str:
    """Spark's initcap: split on spaces, first letter upper, the rest lower."""
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def q_ece_frame() -> str:
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RP.ECE_LABELS.items())
    codes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RP.ECE_CODES.items())
    first = "regexp_replace(regexp_replace(lbl, ' NL', ''), ' Alone or in Combination', '')"
    return f"""
  SELECT geoid, subgroup, rate, population, '{RP.ECE_GROUP}' AS "group" FROM (
    SELECT geoid, {first} AS subgroup, rate, population FROM (
      SELECT geoid, rate, population, CASE code {labels} ELSE {_title_sql('code')} END AS lbl FROM (
        SELECT geoid, rate, (rate / {dbl(100.0)}) * pop AS population,
               regexp_replace(CASE subgroup {codes} ELSE subgroup END, 'nh_', '') AS code
        FROM ({q_survey_breakdown()}) b WHERE subgroup <> 'bipoc' AND dimension <> 'total') x) y) z"""


def q_select_variables() -> str:
    return f"""
  WITH cat AS (SELECT 'V' || CAST(p_partkey AS VARCHAR) AS name, p_type AS label, p_brand AS concept FROM part),
  names AS (SELECT name || 'E' AS variable FROM cat WHERE concept = '{RQ.CATALOG_CONCEPT}' AND label = '{RQ.CATALOG_LABEL}'
            UNION ALL
            SELECT name || 'M' FROM cat WHERE concept = '{RQ.CATALOG_CONCEPT}' AND label = '{RQ.CATALOG_LABEL}'),
  est AS (SELECT 'V' || CAST(l_partkey AS VARCHAR) || 'E' AS variable, l_quantity AS estimate FROM lineitem
          UNION ALL
          SELECT 'V' || CAST(l_partkey AS VARCHAR) || 'M', CAST(l_linenumber AS DOUBLE) FROM lineitem)
  SELECT variable, sum(estimate) AS value, count(*) AS rows
  FROM est WHERE variable IN (SELECT variable FROM names) GROUP BY variable"""


def q_microdata_text() -> str:
    rows = """
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS serial, lpad(CAST(l_suppkey % 100 + 3600 AS VARCHAR), 5, '0') AS puma,
           CAST(l_quantity AS INTEGER) AS age, CASE WHEN l_tax <> 0 THEN CAST(l_partkey AS DOUBLE) END AS ratio FROM lineitem"""
    return f"""
  SELECT puma, count(*) AS persons, min(serial) AS first_serial, CAST(sum(age) AS BIGINT) AS ages, count(ratio) AS with_ratio, sum(ratio) AS ratios
  FROM ({rows}) r WHERE contains(puma, '{RQ.AREA_CODE}') GROUP BY puma"""


def q_label_table() -> str:
    levels = " ".join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(RQ.LEVELS))
    return f"""
  SELECT n_name || ': ' || coalesce(seg, 'NA') AS label_text, seg AS market_segment, CAST(count(*) AS VARCHAR) AS no_of_accounts,
         CAST(CASE WHEN seg IS NULL THEN NULL ELSE CASE seg {levels} ELSE {len(RQ.LEVELS) + 1} END END AS VARCHAR) AS level
  FROM (SELECT n_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey) x
  GROUP BY n_name, seg"""


def q_indicator_frames() -> str:
    frames = [(q_survey_breakdown(), "poverty", RP.POVERTY_GROUP), (q_rent_burden_breakdown(), "rent burden", RP.RENT_GROUP)]
    return " UNION ALL ".join(f"SELECT *, '{measure}' AS measure FROM ({_rate_frame_sql(rows, group)}) f" for rows, measure, group in frames)


# ------------------------------------------------------------- text feeds

def _junk(n: int) -> str:
    return f"(o_orderkey % {n} = 0)"


REGISTER_FACTS = f"""
  SELECT o_orderkey, CAST(o_custkey % {FQ.ZIPS} + 90000 AS VARCHAR) AS zip, o_orderstatus, CAST(o_orderdate AS DATE) AS day,
         CAST(floor(o_totalprice / 1000) AS DOUBLE) AS seats,
         CASE WHEN {_junk(FQ.EMPTY)} THEN 'empty line' WHEN {_junk(FQ.OPEN_QUOTE)} THEN 'open quote' WHEN {_junk(FQ.CUT)} THEN 'too few fields'
              WHEN {_junk(FQ.SHIFTED)} THEN 'too many fields' END AS line_reason,
         CASE WHEN {_junk(FQ.NO_ZIP)} THEN 'missing' END AS zip_reason,
         CASE WHEN {_junk(FQ.NO_CAPACITY)} OR {_junk(FQ.SEATS_TEXT)} THEN 'not a number'
              WHEN {_junk(FQ.NEGATIVE)} AND floor(o_totalprice / 1000) > 0 THEN 'out of range'
              WHEN NOT {_junk(FQ.NEGATIVE)} AND floor(o_totalprice / 1000) > {FQ.MOST_SEATS} THEN 'out of range' END AS capacity_reason,
         CASE WHEN {_junk(FQ.BAD_STATUS)} THEN 'unknown value' END AS status_reason,
         CASE WHEN {_junk(FQ.BAD_DATE)} THEN 'not a date' END AS date_reason
  FROM orders"""


def q_register_text() -> str:
    return f"""
  WITH facts AS ({REGISTER_FACTS})
  SELECT zip AS facility_zip, count(*) AS total_centers,
         CASE WHEN count(capacity_reason) > 0 THEN NULL ELSE sum(seats) END AS capacity_centers,
         sum(CASE WHEN capacity_reason IS NULL THEN seats END) AS capacity_known, count(capacity_reason) AS capacity_rejected,
         strftime(min(CASE WHEN date_reason IS NULL THEN day END), '%Y-%m-%d') AS first_license
  FROM facts
  WHERE line_reason IS NULL AND zip_reason IS NULL AND status_reason IS NULL AND o_orderstatus = 'O'
    AND zip IN (SELECT CAST(c_custkey % {FQ.REQUESTED} + 90000 AS VARCHAR) FROM customer)
  GROUP BY zip"""


def q_register_rejects() -> str:
    fields = (("facility_zip", "zip_reason"), ("facility_capacity", "capacity_reason"), ("facility_status", "status_reason"), ("license_first_date", "date_reason"))
    fine = " AND ".join(["line_reason IS NULL", *[f"{c} IS NULL" for _, c in fields]])
    parts = ["SELECT '(all)' AS field, CAST(NULL AS VARCHAR) AS reason, count(*) AS lines FROM facts",
             f"SELECT '(typed)', NULL, count(*) FILTER (WHERE {fine}) FROM facts", f"SELECT '(rejected)', NULL, count(*) FILTER (WHERE NOT ({fine})) FROM facts",
             "SELECT '(line)', line_reason, count(*) FROM facts WHERE line_reason IS NOT NULL GROUP BY line_reason",
             *[f"SELECT '{name}', {c}, count(*) FROM facts WHERE line_reason IS NULL AND {c} IS NOT NULL GROUP BY {c}" for name, c in fields]]
    return f"WITH facts AS ({REGISTER_FACTS}) " + " UNION ALL ".join(parts)


def q_two_vintage_run() -> str:
    weight = f"(o_orderkey % {S.HOUSEHOLD_WEIGHT_MOD} + 1)"
    reps = ", ".join(f"{weight} + (o_orderkey * {k}) % {S.HOUSEHOLD_REP_MOD} - {S.HOUSEHOLD_REP_SHIFT} AS WGTP{k}" for k in range(1, R + 1))
    first = f"""
    SELECT * FROM (
      SELECT l_orderkey, CAST(l_partkey AS DOUBLE) AS POVPIP,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INTEGER), l_partkey) AS rn
      FROM lineitem WHERE l_tax <> 0 AND CAST(l_quantity AS INTEGER) < 5 AND lpad(CAST(l_orderkey % 100 + 3650 AS VARCHAR), 5, '0') LIKE '%{FQ.AREA}%') x
    WHERE rn = 1"""
    rows = f"""
    SELECT CASE WHEN o_orderkey % 2 = 0 THEN '{FQ.EARLY}' ELSE '{FQ.LATE}' END AS vintage,
           CASE WHEN POVPIP <= {dbl(FQ.TWO_VINTAGE_CUT)} THEN '{SQ.AT_OR_BELOW}' ELSE '{SQ.ABOVE}' END AS indicator, {weight} AS WGTP, {reps}
    FROM ({first}) f JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> '{S.VACANT_STATUS}'"""
    cells = f"SELECT vintage, indicator, {totals_sql(hh_weights())} FROM ({rows}) r GROUP BY vintage, indicator"
    return rate_sql(cells, ["vintage"], "indicator")


def q_row_ids() -> str:
    d = SP.DIGITS
    half = SP.SIDE / 2
    return f"""
  SELECT row_number() OVER (ORDER BY c_name, CAST(c_custkey AS VARCHAR)) AS id, c_name AS "NAMELSAD20", CAST(c_custkey AS VARCHAR) AS "PUMA",
         round((c_custkey % {SP.GRID}) * {SP.SIDE} + {half}, {d}) AS cx, round(floor(c_custkey / {SP.GRID}) * {SP.SIDE} + {half}, {d}) AS cy
  FROM customer"""


def q_indicator_sink() -> str:
    return f"SELECT *, count(*) OVER (PARTITION BY geography, year) AS partition_rows FROM ({q_closures_by_month()}) m"


def q_closures_extract() -> str:
    return f"""
  SELECT 'Facility ' || o_orderkey AS facility_name, g.geoid AS county_name,
         CASE WHEN o_totalprice >= {RQ.KNOWN_FROM} THEN CAST(floor(o_totalprice / 10000) AS INTEGER) END AS facility_capacity,
         strftime(CAST(o_orderdate AS DATE), '%-m/%-d/%Y') AS closed_date_text
  FROM orders o LEFT JOIN ({GEO_CTE}) g ON o.o_custkey = g.o_custkey
  WHERE o_orderstatus <> 'O' AND strftime(CAST(o_orderdate AS DATE), '%Y') = '{FQ.EXTRACT_YEAR}'"""


def q_stored_weights() -> str:
    el = eligible_sql(person_filter="AGEP < 5")
    cells = f"""
    SELECT geoid, indicator, {totals_sql(hh_weights())}
    FROM (SELECT *, {indicator_sql(100)} AS indicator FROM ({el}) e) x
    GROUP BY geoid, indicator"""
    return rate_sql(cells, ["geoid"], "indicator")


def q_decoded_codes() -> str:
    kind = " ".join(f"WHEN p_partkey % {FQ.ENCODINGS} = {k} THEN '{name}'" for k, name in enumerate(("utf-8", "utf-8 mark", "utf-16le", "utf-16be", "windows-1252")))
    return f"""
  SELECT encoding, malformed, count(*) AS lines, CAST(sum(CASE WHEN NOT malformed THEN p_partkey END) AS BIGINT) AS codes,
         min(CASE WHEN NOT malformed THEN p_type || ' é€ü' END) AS first_description, max(CASE WHEN NOT malformed THEN p_type || ' é€ü' END) AS last_description
  FROM (SELECT *, CASE WHEN p_partkey % {FQ.BAD_8} = 0 THEN 'utf-8 mark' WHEN p_partkey % {FQ.BAD_16} = 0 THEN 'utf-16le' {kind} END AS encoding,
               p_partkey % {FQ.BAD_8} = 0 OR p_partkey % {FQ.BAD_16} = 0 AS malformed FROM part) p
  GROUP BY encoding, malformed"""


PUMA_SQL = "lpad(CAST(SERIALNO % 100 + 3650 AS VARCHAR), 5, '0')"


def q_published_county_runs() -> str:
    el = eligible_sql(population={"under 5": "AGEP < 5", "all": None})
    parts = " UNION ALL ".join(
        f"""SELECT population, '{FQ.COUNTY}' AS geoid, {dbl(c)} AS cut, {indicator_sql(c)} AS indicator, * EXCLUDE (population, geoid)
            FROM ({el}) e WHERE {PUMA_SQL} LIKE '%{FQ.AREA}%'""" for c in FQ.COUNTY_CUTS)
    cells = f"SELECT population, geoid, cut, indicator, {totals_sql(hh_weights())} FROM ({parts}) x GROUP BY population, geoid, cut, indicator"
    return f"SELECT * FROM ({rate_sql(cells, ['population', 'geoid', 'cut'], 'indicator')}) r WHERE indicator = '{SQ.AT_OR_BELOW}'"


def q_published_area_run() -> str:
    number = "(SERIALNO % 100 + 3650)"
    rows = f"""
    SELECT *, {indicator_sql(100)} AS indicator, unnest(CASE WHEN {number} % 10 = 0 THEN [{number} % {FQ.PLANNING_AREAS}, ({number} + 1) % {FQ.PLANNING_AREAS}]
      ELSE [{number} % {FQ.PLANNING_AREAS}] END) AS spa
    FROM ({eligible_sql(person_filter="AGEP < 5")}) e WHERE {PUMA_SQL} LIKE '%{FQ.AREA}%'"""
    cells = f"SELECT CAST(spa AS VARCHAR) AS geoid, indicator, {totals_sql(hh_weights())} FROM ({rows}) x GROUP BY spa, indicator"
    return f"SELECT * FROM ({rate_sql(cells, ['geoid'], 'indicator')}) r WHERE indicator = '{SQ.AT_OR_BELOW}'"
