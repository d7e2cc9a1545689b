"""Cases and the records that they list: one ledger of members of all kinds, its violations, and each case's dossier.

A case has an array of ids for each kind; records are one table of (kind, ref, up, quality, exposed), where up are the records that
a record rests on, as an array of (kind, ref). All kinds go through one join and one aggregation, however many they are. A case's rows meet in one
task, where they are summed up one by one, so its dossier takes no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraza.operators import checks
from terraza.sources.scratch import apart

QUALITIES = ("certified", "reviewable", "conflict")  #: from best to worst
UP = "array<struct<kind:string,ref:bigint>>"
MEMBER = "case_id", "kind", "ref"
#: What a member of a ledger breaks, as SQL over its columns.
RULES = {
    "RECORD_MISSING": "times > 0 AND copies = 0", "RECORD_AMBIGUOUS": "copies > 1", "LISTED_TWICE": "times > 1", "OWNER_UNLISTED": "times = 0", "NOT_CITED": "times > 0 AND cited = 0 AND kind IN ('observation', 'source', 'document')",
    "EXPOSED": "exposed",
}
#: A case's decision, from its facts, violations and the worst quality among its members.
DECISION = "CASE WHEN conflicts > 0 THEN 'conflict' WHEN facts = 0 THEN 'insufficient' WHEN reviewable > 0 OR violations > 0 THEN 'reviewable' ELSE 'certified' END"


def records(kind: str, df: DataFrame, ref: str, up: dict[str, str] | None = None, quality: str = "NULL", exposed: str = "false") -> DataFrame:
    """Records of one kind; up maps a kind to the column with the id that a record rests on."""
    above = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("ref")) for k, c in (up or {}).items())).cast(UP)
    return df.select(F.lit(kind).alias("kind"), F.col(ref).cast("long").alias("ref"), above.alias("up"), F.expr(quality).cast("string").alias("quality"), F.expr(exposed).alias("exposed"))


def listed(rows: DataFrame, lists: dict[str, str], once: tuple[str, ...] = ()) -> DataFrame:
    """(case_id, kind, ref, times): what rows of cases add to their lists, by an SQL expression for each kind, null for nothing; no list is gathered.

    Kinds in once hold an id once however many rows add it. Rows that add nothing list nothing, and cases without others have no row.
    """
    own = rows.select("case_id", *(F.expr(e).cast("long").alias(f"_{k}") for k, e in lists.items())).repartition("case_id")
    each = own.select("case_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("ref")) for k in lists)))).where("ref is not null")
    return each.groupBy(*MEMBER).agg(F.when(F.col("kind").isin(*once), F.lit(1)).otherwise(F.count("*")).cast("long").alias("times"))


def ledger(cases: DataFrame, lists: dict[str, str], known: DataFrame) -> DataFrame:
    """(case_id, kind, ref, times, copies, cited, exposed, quality): a row for each record that a case lists or that a record it lists rests on.

    times is how often the case lists it (0: it doesn't), copies how many records have the id (0: none; looked up for listed ones
    only), cited how many of the case's listed records rest on it. A null id is a member without a record; a null or empty array
    lists nothing; a case given in several rows is one.
    """
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref"))
    each = [F.transform(F.coalesce(F.col(c).cast("array<bigint>"), F.array().cast("array<bigint>")), named(k)) for k, c in lists.items()]
    return ledger_of(cases.select("case_id", F.inline(F.concat(*each))).groupBy(*MEMBER).agg(F.count("*").alias("times")), known)


def ledger_of(members: DataFrame, known: DataFrame) -> DataFrame:
    """The ledger of (case_id, kind, ref, times) rows, each member once.

    Repeated records make rows and are never gathered, so an id of very many records or cases is one key of a join, which adaptive execution splits.
    """
    held = known.select("kind", "ref", "up", F.array_position(F.array(*map(F.lit, QUALITIES)), F.col("quality")).cast("int").alias("quality"), "exposed")
    # Ids differ more than kinds, so they come first in the join's order; members are exploded after the shuffle, not before.
    found = members.join(apart(held), ["ref", "kind"], "left").repartition("case_id")
    own = F.array(F.struct("kind", "ref")).cast(UP)
    each = found.select("case_id", "times", "quality", "exposed", F.col("up").isNotNull().alias("there"), F.posexplode(F.concat(own, F.coalesce("up", F.array().cast(UP)))).alias("nth", "member"))
    first, zero = F.col("nth") == 0, F.lit(0).cast("long")
    rows = each.select(
        "case_id", "member.kind", "member.ref", F.when(first, F.col("times")).otherwise(zero).alias("times"), F.when(first & F.col("there"), F.lit(1)).otherwise(0).cast("long").alias("copies"), F.when(first, F.lit(0)).otherwise(1).cast("long").alias("cited"),
        (first & F.coalesce("exposed", F.lit(False))).alias("exposed"), F.when(first, F.col("quality")).alias("quality"),
    )
    worst = F.get(F.array(*map(F.lit, QUALITIES)), F.nullif(F.max("quality"), F.lit(0)) - 1)
    return rows.groupBy(*MEMBER).agg(F.max("times").alias("times"), F.sum("copies").alias("copies"), F.sum("cited").alias("cited"), F.bool_or("exposed").alias("exposed"), worst.alias("quality"))


def violations(members: DataFrame) -> DataFrame:
    """(case_id, kind, ref, code) of every rule that a member breaks."""
    return checks.broken(members.withColumn("member", F.struct(*MEMBER)), "member", **RULES).select("member.*", "code")


def dossiers(members: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each case: the ids found of each kind in order, comma-joined, its violations and their codes, and the decision on it."""
    codes = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(code)) for code, rule in RULES.items())))
    found = (F.col("times") > 0) & (F.col("copies") > 0)
    ids = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(found & (F.col("kind") == k), F.col("ref")))), lambda x: x.cast("string")), ",").alias(f"{k}_ids") for k in kinds]
    own = members.withColumn("codes", codes).groupBy("case_id").agg(
        *ids, F.count_if(found & (F.col("kind") == "fact")).alias("facts"), F.sum(F.size("codes").cast("long")).alias("violations"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))), ",").alias("codes"),
        F.count_if(F.col("quality") == "conflict").alias("conflicts"), F.count_if(F.col("quality") == "reviewable").alias("reviewable"),
    )
    return own.select("case_id", *(f"{k}_ids" for k in kinds), "facts", "violations", "codes", F.expr(DECISION).alias("decision"))


def coverage(members: DataFrame) -> DataFrame:
    """A row for each kind: what cases list, what of it is found, missing, repeated or exposed, and what they lack; listed = found + missing."""
    listed, found = F.col("times") > 0, F.col("copies") > 0
    return members.groupBy("kind").agg(
        F.count_if(listed).alias("listed"), F.count_if(listed & found).alias("found"), F.count_if(listed & ~found).alias("missing"), F.count_if(F.col("times") > 1).alias("repeated"), F.count_if("exposed").alias("exposed"), F.count_if(~listed).alias("unlisted"),
    )
