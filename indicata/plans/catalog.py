"""Registry of runnable queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from indicata.plans import feed_queries as FQ
from indicata.plans import oracle as O
from indicata.plans import register_queries as RQ
from indicata.plans import report_queries as RPQ
from indicata.plans import spatial_queries as SPQ
from indicata.plans import survey_queries as SQ

QueryFn = Callable[[SparkSession, str], DataFrame]

# name -> (spark query, SQL oracle builder or None when not SQL-expressible)
REGISTRY: dict[str, tuple[QueryFn, Callable[[], str] | None]] = {
    "eligible_households": (SQ.eligible_households, O.q_eligible_households),
    "poverty_by_area": (SQ.poverty_by_area, O.q_poverty_by_area),
    "poverty_runs": (SQ.poverty_runs, O.q_poverty_runs),
    "survey_total": (SQ.survey_total, O.q_survey_total),
    "survey_rate": (SQ.survey_rate, O.q_survey_rate),
    "person_weighted_rate": (SQ.person_weighted_rate, O.q_person_weighted_rate),
    "exclusive_category": (SQ.exclusive_category, O.q_exclusive_category),
    "null_safe_flags": (SQ.null_safe_flags, O.q_null_safe_flags),
    "code_list_flag": (SQ.code_list_flag, O.q_code_list_flag),
    "survey_breakdown": (SQ.survey_breakdown, O.q_survey_breakdown),
    "weighted_population": (SQ.weighted_population, O.q_weighted_population),
    "children_by_race": (SQ.children_by_race, O.q_children_by_race),
    "closures_by_month": (RQ.closures_by_month, O.q_closures_by_month),
    "closures_by_day": (RQ.closures_by_day, O.q_closures_by_day),
    "mean_of_sums": (RQ.mean_of_sums, O.q_mean_of_sums),
    "closure_summary": (RQ.closure_summary, O.q_closure_summary),
    "compare_years": (RQ.compare_years, O.q_compare_years),
    "capacity_on_spine": (RQ.capacity_on_spine, O.q_capacity_on_spine),
    "moe_sum": (RQ.moe_sum, O.q_moe_sum),
    "impute_gap": (RQ.impute_gap, O.q_impute_gap),
    "sum_strict": (RQ.sum_strict, O.q_sum_strict),
    "rate_per_base": (RQ.rate_per_base, O.q_rate_per_base),
    "paired_unpivot": (RQ.paired_unpivot, O.q_paired_unpivot),
    "microdata_text": (RQ.microdata_text, O.q_microdata_text),
    "label_table": (RQ.label_table, O.q_label_table),
    "select_variables": (RQ.select_variables, O.q_select_variables),
    "ring_area": (SPQ.ring_area, O.q_ring_area),
    "ring_centroid": (SPQ.ring_centroid, O.q_ring_centroid),
    "wkt_layers": (SPQ.wkt_layers, O.q_wkt_layers),
    "overlay_crosswalk": (SPQ.overlay_crosswalk, O.q_overlay_crosswalk),
    "survey_by_crosswalk": (SPQ.survey_by_crosswalk, O.q_survey_by_crosswalk),
    "closure_table": (RQ.closure_table, O.q_closure_table),
    "rent_burden_breakdown": (SQ.rent_burden_breakdown, O.q_rent_burden_breakdown),
    "indicator_frame": (RPQ.indicator_frame, O.q_indicator_frame),
    "children_frame": (RPQ.children_frame, O.q_children_frame),
    "poverty_frame": (RPQ.poverty_frame, O.q_poverty_frame),
    "rent_burden_frame": (RPQ.rent_burden_frame, O.q_rent_burden_frame),
    "top_subgroup": (RPQ.top_subgroup, O.q_top_subgroup),
    "headline": (RPQ.headline, O.q_headline),
    "fallback_text": (RPQ.fallback_text, O.q_fallback_text),
    "ece_frame": (RPQ.ece_frame, O.q_ece_frame),
    "indicator_frames": (RPQ.indicator_frames, O.q_indicator_frames),
    "register_text": (FQ.register_text, O.q_register_text),
    "register_rejects": (FQ.register_rejects, O.q_register_rejects),
    "two_vintage_run": (FQ.two_vintage_run, O.q_two_vintage_run),
    "published_county_runs": (FQ.published_county_runs, O.q_published_county_runs),
    "published_area_run": (FQ.published_area_run, O.q_published_area_run),
    "row_ids": (FQ.row_ids, O.q_row_ids),
    "decoded_codes": (FQ.decoded_codes, O.q_decoded_codes),
    "indicator_sink": (FQ.indicator_sink, O.q_indicator_sink),
    "closures_extract": (FQ.closures_extract, O.q_closures_extract),
    "stored_weights_packed": (SQ.stored_weights_packed, O.q_stored_weights),
    "stored_weights_wide": (SQ.stored_weights_wide, O.q_stored_weights),
}


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1]() for k, v in REGISTRY.items() if v[1] is not None}
