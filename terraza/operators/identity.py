"""Who is who: a registry of names, projects merged from two sources, and matches that must be exact on every side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import graphs as G
from terraza.sources.scratch import written


def registry(names: DataFrame, name: str, domain: str, allowed: DataFrame) -> DataFrame:
    """(source_name, normalized, domain, agency_id, resolution) of each name and domain.

    allowed: (a, b) pairs of normalized names that are one agency, chains of them included. Names with one normalized form are one agency, and
    so are names that allowed pairs connect; the id is made of the component's first name. A name one of whose domains is shared by names of
    several agencies goes to manual review, without an id. A name without letters or digits has no row; one without a domain is resolved.
    """
    own = written(names.select(F.col(name).alias("source_name"), S.words(name).alias("normalized"), F.nullif(F.col(domain), F.lit("")).alias("domain")).where("normalized <> ''").distinct(), "names")
    joined = G.components(allowed.select(S.words("a").alias("a"), S.words("b").alias("b")))
    agency = written(own.join(joined.withColumnRenamed("node", "normalized"), "normalized", "left").withColumn("agency", F.coalesce("component", "normalized")), "agencies")
    shared = agency.where("domain is not null").groupBy("domain").agg(F.countDistinct("agency").alias("agencies")).where("agencies > 1")
    review = agency.join(shared, "domain", "left_semi").select("normalized").distinct().withColumn("review", F.lit(True))
    out = agency.join(review, "normalized", "left")
    return out.select("source_name", "normalized", "domain", F.when(F.col("review").isNull(), F.concat(F.lit("agency:"), F.replace("agency", F.lit(" "), F.lit("-")))).alias("agency_id"), F.when(F.col("review"), "manual_review").otherwise("resolved").alias("resolution"))


def merged_projects(listed: DataFrame, controlled: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(project_id, agency_id, name, status, origin): listed projects and controlled ones, each id once.

    listed and controlled: project_id, agency_id, name, status; controlled also case_id. A listed project without an agency is unresolved
    and stays as such. A controlled one with a listed id gives its status to it if its case may (allowed), and is a collision
    otherwise; several controlled ones with one id are a collision too. collisions() raises on them.
    """
    one = controlled.groupBy("project_id").agg(F.count("*").alias("times"), *(F.min(c).alias(f"_{c}") for c in ("agency_id", "name", "status", "case_id")))
    both = listed.join(one, "project_id", "full")
    listed_too, may = F.col("name").isNotNull(), F.coalesce(F.col("_case_id").isin(*allowed), F.lit(False)) & (F.col("times") == 1)
    origin = F.when(F.col("times").isNull(), F.when(F.col("agency_id").isNull(), "unresolved").otherwise("listed")).when(F.col("times") > 1, "collision").when(~listed_too, "controlled").when(may, "merged").otherwise("collision")
    return both.select("project_id", F.coalesce("agency_id", "_agency_id").alias("agency_id"), F.coalesce("name", "_name").alias("name"), F.when(may, F.col("_status")).otherwise(F.coalesce("status", "_status")).alias("status"), origin.alias("origin"))


def raised(rows: DataFrame, what: str) -> None:
    """Raises if there are such rows, naming a few; rows has one column to name them by, its first."""
    few = [str(r[0]) for r in rows.limit(5).collect()]
    if few:
        raise ValueError(f"{rows.count()} {what}: {', '.join(sorted(few))}")


def exact_matches(matching: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Every proposed match with `reasons` against it, in order; an exact one has none.

    matching: match_id, agency_id, match_class, left_key, right_key, confirmed, review; left and right: key, agency_id. Both sides must hold the key
    exactly once, with the match's own agency. Keys are counted before they are joined, so no group meets a group. A null key or agency
    is a reason and matches nothing.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where("key is not null").groupBy(F.col("key").alias(f"{name}_key")).agg(F.count("*").alias(f"{name}_times"), F.min("agency_id").alias(f"{name}_agency"))

    own = matching.join(side(left, "left"), "left_key", "left").join(side(right, "right"), "right_key", "left")
    once = lambda n: F.coalesce(F.col(f"{n}_times"), F.lit(0)) == 1
    both = F.col("agency_id").isNotNull() & once("left") & once("right")
    differs = lambda n: both & ~F.col(f"{n}_agency").eqNullSafe(F.col("agency_id"))
    reasons = S.reasons(
        MATCH_AGENCY_UNRESOLVED=F.col("agency_id").isNull(), MATCHED_ON_AGENCY_NOT_TRUE=~F.coalesce("confirmed", F.lit(False)), LEFT_JOIN_COUNT=~once("left"), RIGHT_JOIN_COUNT=~once("right"),
        HIGH_REQUIRES_HUMAN_REVIEW=(F.col("match_class") == "match_high") & F.coalesce("review", F.lit(True)), LEFT_AGENCY_MISMATCH=differs("left"), RIGHT_AGENCY_MISMATCH=differs("right"),
    )
    return own.select(*matching.columns, reasons.alias("reasons"))


def kept_matches(judged: DataFrame) -> DataFrame:
    """The exact matches, one for each agency, class and pair of keys: the one with the smallest id."""
    return judged.where(F.size("reasons") == 0).groupBy("agency_id", "match_class", "left_key", "right_key").agg(F.min("match_id").alias("match_id"))


def contradictions(judged: DataFrame) -> DataFrame:
    """(match_id, reasons) of high matches that something speaks against; raised() stops a run on them."""
    return judged.where((F.col("match_class") == "match_high") & (F.size("reasons") > 0)).select("match_id", F.array_join("reasons", ",").alias("reasons"))
