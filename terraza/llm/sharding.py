"""Shards of near equal size by sampled splitters.

Rows have a total order: the hash of their group (equal texts), their id, and a salt that is written once. Splitters are drawn from a
sample of keys in which a row's chance is its weight; they cut the order into ranges of near equal weight, and ranges that turn
out overfull are sampled again and cut further, down to single rows. Each range is then sorted and summed in a task of its own,
and what earlier ranges hold is added, so every row knows its place in the whole order, and the shard follows from it exactly: a
sample that misleads makes ranges uneven, never shards.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

SHARDS = 16
RANGE = 1 << 20  #: rows of a range, about, where there are many
LEAST = 8  #: ranges of a shard at least, so that groups up to an eighth of a shard lie in one range
DRAWN = 24  #: keys that are sampled for each range
OVERFULL = 2.5  #: times the mean weight from which on a range is cut again
WHOLE, MOST_WHOLE = 1 / 64, 1 / 16  #: shares of a shard up to which a group is not cut: any group, and one no larger than the largest row

KEY = ("_group", "_id", "_salt")


def _codes(*parts: np.ndarray) -> np.ndarray:
    """Byte strings that are in the order of the triples of integers."""
    out = np.empty((len(parts[0]), len(parts)), ">u8")
    for k, p in enumerate(parts):
        out[:, k] = p.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(parts)}").ravel()


def _range(splitters: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted splitters are not above a row's key."""
    cuts = _codes(*(np.array([s[k] for s in splitters], np.int64) for k in range(3)))

    def place(group: pa.Array, own: pa.Array, salt: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, _codes(*(x.to_numpy(zero_copy_only=False) for x in (group, own, salt))), "right").astype(np.int32))

    return F.arrow_udf(place, "int")(*KEY) if splitters else F.lit(0)


def _cuts(keys: list[tuple[int, int, int]], parts: int, held: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Quantiles of sampled keys; a group that only one of them falls in is not cut, its start is the splitter, unless it is one already."""
    keys, low = sorted(keys), -(1 << 63)
    picked = {keys[len(keys) * k // parts] for k in range(1, parts)} if keys else set()
    times = Counter(k[0] for k in picked)
    return {k if times[k[0]] > 1 or (k[0], low, low) in held else (k[0], low, low) for k in picked}


def ranged(rows: DataFrame, weight: Column, shards: int = SHARDS, per_range: int = RANGE) -> tuple[DataFrame, dict[int, tuple[int, int]], int, int]:
    """rows with `_range`, the (rows, weight) of each range, and the weight of all rows and of the largest; rows have KEY and lie in a written table.

    The weight that ranges share out has the mean weight added to each row's, so that they have no more rows than twice their share.
    """
    n, total, largest = rows.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    mean = total / max(1, n)
    heavy, parts = weight + F.lit(mean), max(LEAST * shards, -(-n // per_range))
    splitters: set[tuple[int, int, int]] = set()
    draws, inside, want = {None: 2 * total}, None, parts
    for turn in range(64):
        # The chance of a row: its share of the weight of what is cut, times how many keys are wanted.
        whole = sum(draws.values())
        chance = heavy * F.lit(DRAWN * want / max(1e-9, whole))
        drawn = rows.withColumn("_range", _range(sorted(splitters))) if inside is not None else rows
        drawn = drawn.where(F.col("_range").isin(inside)) if inside is not None else drawn
        lot = F.pmod(F.xxhash64(*KEY, F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        keys = [tuple(r) for r in drawn.where(lot < chance).select(*KEY).collect()]
        old = sorted(splitters)
        if inside is None:
            splitters |= _cuts(keys, want, splitters)
        else:
            held: dict[int, list] = {}
            for k in keys:
                held.setdefault(bisect_right(old, k), []).append(k)
            for r, own in held.items():
                splitters |= _cuts(own, math.ceil(draws[r] / (2 * total / parts)) + 1, splitters)
        out = rows.withColumn("_range", _range(sorted(splitters)))
        sums = {r["_range"]: (r["n"], r["w"], r["h"]) for r in out.groupBy("_range").agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(heavy).alias("h")).collect()}
        over = {r: h for r, (m, _, h) in sums.items() if m > 1 and h > OVERFULL * 2 * total / parts}
        if not over or (turn and len(splitters) == len(old)):
            break
        draws, inside = over, sorted(over)
        want = sum(math.ceil(h / (2 * total / parts)) for h in over.values())
    return out, {r: (m, int(w)) for r, (m, w, _) in sums.items()}, int(total), int(largest)


def assign(rows: DataFrame, group: Column, own: Column, size: Column, shards: int = SHARDS, law: str = "bytes", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, size, shard, slot) of every row: its shard, and its place there, gapless from 0.

    law "bytes": shards have near equal sums of size: a row lies where the middle of its stretch of the running sum falls, so a
    boundary is off by half a row at most, or by half a group that is not cut. law "rows": counts differ by one at most. group and own are
    64-bit keys; rows with one group stay together where they take up to WHOLE of a shard, or up to
    MOST_WHOLE and no more than the largest row (law "bytes"), or where no boundary falls among them. Rows without a group or an id count as the smallest; equal rows get different slots. size is 0 or more. An empty table
    gives no rows, and fewer rows than shards leave shards empty. A row larger than a shard leaves others smaller. Other columns
    than keep are left out; keep may hold any but size, shard and slot.
    """
    low = F.lit(-(1 << 63))
    keyed = rows.select(*keep, size.cast("long").alias("size"), F.coalesce(group, low).alias("_group"), F.coalesce(own.cast("long"), low).alias("_id"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    keyed = written(keyed, "keys")
    weight = F.col("size") if law == "bytes" else F.lit(1)
    placed, sums, total, largest = ranged(keyed, weight, shards)
    starts, at = [], [0, 0]
    for r in sorted(sums):
        starts.append((r, *at))
        at = [at[0] + sums[r][0], at[1] + sums[r][1]]
    starts = rows.sparkSession.createDataFrame(starts, "_range int, _rows long, _before long")
    order = W.partitionBy("_range").orderBy(*KEY).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.repartition(max(len(sums), 1) if len(sums) < 4096 else 4096, "_range").join(F.broadcast(starts), "_range")
    placed = placed.withColumns({"_nth": F.col("_rows") + F.count("*").over(order) - 1, "_end": F.col("_before") + F.sum(weight).over(order), "_own": weight.cast("long")})
    if law == "bytes":
        together = W.partitionBy("_range", "_group")
        placed = placed.withColumns({"_last": F.max("_end").over(together), "_sum": F.sum("_own").over(together)})
        whole = F.col("_sum") <= F.lit(int(max(total / shards * WHOLE, min(largest, total / shards * MOST_WHOLE))))
        middle = F.when(whole, 2 * F.col("_last") - F.col("_sum")).otherwise(2 * F.col("_end") - F.col("_own"))
        shard = F.when(F.lit(total) == 0, F.lit(0)).otherwise(F.floor(middle / F.lit(2.0 * max(1, total)) * shards))
    else:
        shard = F.floor(F.col("_nth") / F.lit(float(max(1, total))) * shards) if total >= 1 << 48 else F.expr(f"_nth * {shards} div {max(1, total)}")
    table = written(placed.withColumn("shard", F.least(F.lit(shards - 1), shard.cast("int"))).select(*keep, "size", "shard", "_nth"), "shards")
    first = table.groupBy("shard").agg(F.min("_nth").alias("_first"))
    return table.join(F.broadcast(first), "shard").select(*keep, "size", "shard", (F.col("_nth") - F.col("_first")).alias("slot"))


def op13(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, by the law "bytes".

    A null text has the bytes of none: size 1, crc 0. Equal texts are a group. Texts are measured and hashed whole. See assign for
    repeated rows, ties and empty tables; extra columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    out = assign(rows, F.col("hash"), F.col("doc_id"), F.col("bytes"), keep=("doc_id", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
