"""Change history: pairs of neighbouring observations, their assessment, validity and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import ordered


# Reasons against a change, in order of precedence, and those that only call for a review.
REASONS = ("base_zero", "extreme_change", "unknown_currency", "invalid_date_order", "semantic_mismatch", "entity_mismatch", "evidence_missing", "restricted", "outside_cutoff", "duplicate")
REVIEW = ("base_zero", "extreme_change")


def lag_change(df: DataFrame, more: tuple[str, ...] = ("currency", "evidence_state", "semantic")) -> DataFrame:
    """Each observation with the one before it of the same entity and field; percent only over a base that is not 0.

    Of the columns named in more, those that are there come with their values before. An entity may have any
    number of observations: they are ordered in ranges, and the last of each range is carried on.
    """
    more = [c for c in more if c in df.columns]
    flags = [c for c in ("resolved", "duplicate") if c in df.columns]
    own = df.select("event_id", "entity_id", "field", "ts", "value", *more, *flags)
    own = ordered.lagged(own, ["entity_id", "field"], ["ts", "event_id"], previous="value", previous_ts="ts", **{f"previous_{c}": c for c in more})
    delta = S.half_up(F.col("value") - F.col("previous"), 2)
    out = own.withColumn("delta", delta).withColumn("percent", S.half_up(S.ratio(F.col("delta") * 100, F.col("previous")), 2))
    return out.where(F.col("previous").isNotNull())


def assess(pairs: DataFrame, cutoff: str, extreme: float = 30, currency: str = "PEN", semantic: str = "price") -> DataFrame:
    """Reasons in order of precedence, status and direction of each pair; what a table doesn't tell speaks against nothing.

    Any reason but a base of 0 or an extreme change makes a pair insufficient; those two leave it reviewable.
    """
    at = F.to_timestamp_ntz(F.lit(cutoff), F.lit("yyyy-MM-dd HH:mm:ss"))
    there = lambda c, condition: condition if c in pairs.columns else F.lit(False)
    either = lambda c, test: there(c, test(F.col(c)) | test(F.col(f"previous_{c}")))
    restricted = either("evidence_state", lambda x: x == "restricted")
    why = S.reasons(
        base_zero=F.col("previous") == 0, extreme_change=F.abs("percent") > extreme, unknown_currency=either("currency", lambda x: ~x.eqNullSafe(F.lit(currency))), invalid_date_order=F.col("ts") <= F.col("previous_ts"),
        semantic_mismatch=either("semantic", lambda x: ~x.eqNullSafe(F.lit(semantic))), entity_mismatch=there("resolved", ~F.col("resolved")), evidence_missing=~restricted & either("evidence_state", lambda x: ~x.eqNullSafe(F.lit("authorized"))),
        restricted=restricted, outside_cutoff=F.col("ts").cast("timestamp_ntz") > at, duplicate=there("duplicate", F.col("duplicate")),
    )
    blocked = F.exists(why, lambda r: ~r.isin(*REVIEW))
    status = F.when(blocked, "insufficient").when(F.size(why) > 0, "reviewable").otherwise("certified")
    direction = F.when(F.col("delta") > 0, "increase").when(F.col("delta") < 0, "decrease").otherwise("unchanged")
    return pairs.select("event_id", "entity_id", "field", "delta", "percent", F.array_join(why, ",").alias("reasons"), status.alias("status"), direction.alias("direction"))


def age_days(ts: Column, cutoff: str) -> Column:
    at = F.unix_micros(F.to_timestamp_ntz(F.lit(cutoff), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp"))
    return (at - F.unix_micros(ts.cast("timestamp"))) / F.lit(86400e6)


def validity(df: DataFrame, cutoff: str, whole: bool) -> DataFrame:
    """current to 30 days, aging to 90, historical after; unknown after the cutoff. whole: days are rounded down first."""
    age = age_days(F.col("ts"), cutoff)
    age = F.floor(age).cast("double") if whole else age
    name = F.when(age.isNull() | (age < 0), "unknown").when(age <= 30, "current").when(age <= 90, "aging").otherwise("historical")
    return df.select("event_id", name.alias("validity"))


def coverage(assessed: DataFrame, by: str) -> DataFrame:
    """Counts of each group's pairs by status."""
    return assessed.groupBy(by).agg(F.count("*").alias("candidates"), F.count_if(F.col("status") != "insufficient").alias("materialized"), *(F.count_if(F.col("status") == s).alias(s) for s in ("certified", "reviewable", "insufficient")))


def reason_counts(assessed: DataFrame) -> DataFrame:
    return assessed.where(F.col("reasons") != "").select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def largest(assessed: DataFrame, n: int) -> DataFrame:
    return assessed.where(F.col("percent").isNotNull()).orderBy(F.desc(F.abs("percent")), "event_id").limit(n).select("event_id", "entity_id", "field", "percent")


def agenda(assessed: DataFrame, n: int = 3) -> DataFrame:
    """Each field's n largest certified changes, or its n largest reviewable ones where none is certified, or one row that asks for a wider scope."""
    every = assessed.select("field").distinct()
    own = assessed.where(F.col("status").isin("certified", "reviewable") & F.col("percent").isNotNull())
    best = own.groupBy("field").agg(F.min("status").alias("status"))  # certified sorts first
    own = own.join(best, ["field", "status"])
    w = W.partitionBy("field").orderBy(F.desc(F.abs("percent")), "event_id")
    own = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("field", "status", "event_id", "percent", "rank")
    return every.join(own, "field", "left").select("field", F.coalesce("status", F.lit("expand_or_review_scope")).alias("status"), F.concat(F.lit("agenda:"), F.coalesce(F.col("event_id").cast("string"), F.lit("history-expand-or-review-scope"))).alias("item_id"), "percent", F.coalesce("rank", F.lit(1)).alias("rank"))
