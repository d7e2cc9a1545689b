"""Evidence and records: permissions, presentation, privacy, references, uniqueness and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns of personal data; the same text works in both dialects.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+[0-9][0-9 ]{7,}[0-9]",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "local_path": r"(/home/|/Users/|[A-Z]:\\)",
    "traversal": r"\.\./",
    "messaging_app": r"[Ww][Hh][Aa][Tt][Ss] ?[Aa][Pp][Pp]",
}


def privacy(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each rule that a text breaks."""
    codes = F.array_compact(F.array(*(F.when(F.rlike(F.col(text), F.lit(p)), F.lit(k)) for k, p in PATTERNS.items())))
    return df.select(key, F.explode(codes).alias("code"))


def public_text(df: DataFrame) -> DataFrame:
    """The text, null where it breaks a privacy rule or may not be published."""
    bad = F.lit(False)
    for p in PATTERNS.values():
        bad = bad | F.rlike(F.col("text"), F.lit(p))
    return df.select("doc_id", "permission", F.when((F.col("permission") == "authorized") & ~bad, F.sha2("text", 256)).alias("sha256"))


def presentation(df: DataFrame) -> DataFrame:
    """How evidence is shown, by precedence: restricted, pending, unavailable, then fragment or transcription by length."""
    how = F.when(F.col("permission") == "authorized", F.when(F.col("n_chars") <= 300, "fragment").otherwise("transcription")).otherwise(F.col("permission"))
    return df.select("doc_id", how.alias("presentation"))


def assessment(df: DataFrame, by: str = "source") -> DataFrame:
    """The worst standing of each group: restricted before unavailable before pending before available."""
    rank = F.when(F.col("permission") == "restricted", 0).when(F.col("permission") == "unavailable", 1).when(F.col("permission") == "pending", 2).otherwise(3)
    worst = F.min(rank)
    return df.groupBy(by).agg(F.element_at(F.array(*map(F.lit, ("restricted", "unavailable", "pending", "available"))), (worst + 1).cast("int")).alias("assessment"), F.count("*").alias("n"), F.every(F.col("permission") == "authorized").alias("public"))


def fingerprint(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """SHA-256 of each text with its line ends made plain."""
    return df.select(key, F.sha2(F.regexp_replace(F.col(text), "\r\n?", "\n"), 256).alias("sha256"))


def missing_references(left: DataFrame, key: str, right: DataFrame, target: str) -> DataFrame:
    """Keys of left that right lacks, once each with their number."""
    return left.where(F.col(key).isNotNull()).join(right.select(F.col(target).alias(key)).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def dedupe_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key, and how many there were."""
    w = W.partitionBy(*keys)
    return df.withColumn("copies", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(*order))).where("nth = 1").drop("nth")


def ledger(df: DataFrame, used: Column, missing: Column) -> DataFrame:
    """Every record in just one bucket: used, missing or excluded."""
    return df.select("listing_id", F.when(missing, "missing").when(used, "used").otherwise("excluded").alias("bucket"))


def values_differ(facts: DataFrame) -> DataFrame:
    """Listings whose facts of one kind disagree; no winner is picked."""
    own = facts.groupBy("listing_id", "semantic_type").agg(F.countDistinct("value").alias("values"), F.count("*").alias("n"))
    return own.where("values > 1")


def changed_order(df: DataFrame, key: str, position: str) -> DataFrame:
    """Rows whose key is smaller than that of the row before them; the rows are compared within key ranges, not in one task."""
    ranged = df.select(F.col(position).alias("at"), F.col(key).alias("key"))
    before = ranged.select((F.col("at") + 1).alias("at"), F.col("key").alias("before"))
    return ranged.join(before, "at").where(F.col("before") > F.col("key"))


def merge_supplement(base: DataFrame, more: DataFrame, key: str, value: str) -> DataFrame:
    """Base and supplement by id: same, conflict, base only or supplement only."""
    a, b = base.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")), more.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "supplement").when(F.col("in_b").isNull(), "base").when(F.equal_null("a", "b"), "same").otherwise("conflict")
    return a.join(b, key, "full").select(key, state.alias("state"))
