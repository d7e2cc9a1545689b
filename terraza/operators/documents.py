"""JSON documents of any depth: every value with its path, and what in them must not be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraza.operators.evidence import PATTERNS
from terraza.sources.scratch import written

# Words that a key may not hold, as a whole or between underscores, and policy keys that may if they are false.
FORBIDDEN_WORDS = ("contact", "contacto", "email", "e_mail", "phone", "telefono", "teléfono", "whatsapp", "payload", "raw_payload", "rawpayload")
POLICY_KEYS = ("contains_contact_pii", "raw_payloads_included")
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}  #: of variants; all others are numbers


def walk(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, name, kind, value) of every value of each document, the document itself at path $.

    name is the key that the value stands under, null for the document and for an element of an array; value is the text of a string, number
    or boolean and null otherwise. Variants are exploded level by level, each written, until nothing nests, so depth has no limit. A text
    that is no JSON, a null one among them, is one row of kind invalid. Rows with one key are walked one by one. A key of an object
    is put into the path as it is.
    """
    documents = df.select(F.col(key).alias("_key"), F.try_parse_json(json).alias("v"))
    level = documents.select("_key", F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), "v")
    levels = []
    while True:
        shape = F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1)
        kind = F.when(F.col("v").isNull(), "invalid")
        for shown, name in KINDS.items():
            kind = kind.when(shape == shown, name)
        level = written(level.withColumn("kind", kind.otherwise("number")), "level")
        levels.append(level)
        nested = level.where(F.col("kind").isin("object", "array"))
        if nested.isEmpty():
            break
        inner = nested.lateralJoin(nested.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = inner.select("_key", F.concat("path", step).alias("path"), F.col("key").alias("name"), F.col("value").alias("v"))
    out = None
    for level in levels:
        value = F.when(F.col("kind").isin("string", "number", "boolean"), F.try_variant_get("v", "$", "string"))
        own = level.select(F.col("_key").alias(key), "path", "name", "kind", value.alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


def forbidden(name: Column, kind: Column, value: Column) -> Column:
    """Whether a key is one for personal data or raw content; a policy key is not, where it says false."""
    between = F.concat(F.lit("_"), F.lower(name), F.lit("_"))
    held = F.lit(False)
    for word in FORBIDDEN_WORDS:
        held = held | F.contains(between, F.lit(f"_{word}_"))
    return F.coalesce(held & ~(name.isin(*POLICY_KEYS) & (kind == "boolean") & (value == "false")), F.lit(False))


def private(walked: DataFrame, key: str) -> DataFrame:
    """(key, path, code) for each rule that a value of a walked document breaks: forbidden keys, and patterns of personal data in strings."""
    rules = {"forbidden_key": forbidden(F.col("name"), F.col("kind"), F.col("value"))}
    rules |= {k: (F.col("kind") == "string") & F.rlike("value", F.lit(p)) for k, p in PATTERNS.items()}
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return walked.select(key, "path", F.explode(codes).alias("code"))
