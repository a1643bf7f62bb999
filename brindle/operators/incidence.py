"""What a ticket's tags and a call's speakers say about each result, and summaries of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import IMPACTS, business_impact, customer_voice, first_suffix, internal_triage, roles_in_text, suffixes


def incidence(tags: Column) -> Column:
    """Nine fields of one ticket's lower-case tags."""
    return F.struct(
        internal_triage(tags).alias("is_internal_triage"),
        business_impact(tags).alias("business_impact"),
        F.array_contains(tags, "followup_ticket").alias("is_followup"),
        F.array_contains(tags, "feature_request").alias("is_feature_request"),
        suffixes(tags, "support_topic_").alias("support_topics"),
        suffixes(tags, "end_user_topic_").alias("end_user_topics"),
        first_suffix(tags, "support_resolution_").alias("support_resolution"),
        first_suffix(tags, "crm_topic_").alias("crm_topic"),
        first_suffix(tags, "customer_status_").alias("customer_status"),
    )


def incidence_summary(rows: DataFrame, exclude_triage: bool = False) -> DataFrame:
    """One row over results with an ``incidence`` struct; zero-filled, and 0.0 of no result."""
    kept = rows.where("NOT incidence.is_internal_triage") if exclude_triage else rows
    impact = F.col("incidence.business_impact")
    triage = F.count_if("incidence.is_internal_triage")
    return kept.agg(
        F.count("*").alias("results_returned"),
        triage.alias("internal_triage_count"),
        *[F.count_if(impact == p.upper()).alias(f"impact_{p}") for p in IMPACTS],
        F.count_if(impact.isNull()).alias("impact_none"),
        F.count_if("incidence.is_feature_request").alias("feature_request_count"),
        F.count_if("incidence.is_followup").alias("followup_count"),
        F.coalesce(F.round(triage / F.count("*"), 4), F.lit(0.0)).alias("internal_triage_pct"),
    )


def voices(records: DataFrame) -> DataFrame:
    """``(id, parent_id, roles, customer_voice)`` of each record's text."""
    roles = roles_in_text(F.col("text"))
    return records.select("id", "parent_id", roles.alias("roles"), customer_voice(roles).alias("customer_voice"))


def voice_summary(voiced: DataFrame) -> DataFrame:
    """Parents, and parents in which a customer speaks."""
    per = voiced.groupBy("parent_id").agg(F.bool_or("customer_voice").alias("v"))
    return per.agg(F.count("*").alias("parents"), F.count_if("v").alias("parents_with_customer_voice"))
