"""Compact encodings: bit masks, dictionaries, canonical JSON, job manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bitmasks(rows: DataFrame) -> DataFrame:
    """(group, mask) of (group, id, bit): bytes in hexadecimal, the first id in the lowest bit of the first byte."""
    numbered = rows.withColumn("i", F.row_number().over(W.partitionBy("group").orderBy("id")) - 1)
    bit = F.when(F.col("bit"), F.call_function("shiftleft", F.lit(1), (F.col("i") % 8).cast("int"))).otherwise(0)
    bytes_ = numbered.groupBy("group", F.floor(F.col("i") / 8).alias("byte")).agg(F.sum(bit).alias("v"))
    joined = bytes_.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("byte", "v"))).alias("b"))
    return joined.select("group", F.array_join(F.transform("b", lambda x: F.format_string("%02x", x["v"])), "").alias("mask"))


def has_bit(mask: Column, i: Column) -> Column:
    """Bit i of a mask; beyond a mask's end (one cut short, say) it reads as absent."""
    byte = F.conv(F.substring(mask, (F.floor(i / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (i % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def numbered(rows: DataFrame, bucket: Column, *order: str, name: str = "k") -> DataFrame:
    """rows numbered from 1 in one order over all, without gathering them in one task.

    `bucket` must not fall as the order rises and take a bounded number of
    values: rows are numbered within their bucket, and buckets' counts, of which there
    are few, are summed up before them.
    """
    dealt = rows.withColumn("_bucket", bucket)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_inside", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)))
    return inside.join(F.broadcast(before), "_bucket").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_before", "_inside")


def dictionary(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """(id, value, code): values numbered by the least id that carries them, by ranges of ids."""
    first = rows.groupBy("value").agg(F.min("id").alias("first"))
    bounds = rows.agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    ranged = first.join(F.broadcast(bounds), F.col("first").between(F.col("_lo"), F.col("_hi")))
    width = F.floor((F.col("first") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo") + 1) / buckets)).cast("long")
    codes = numbered(ranged, width, "first", name="code").select("value", (F.col("code") - 1).alias("code"))
    return rows.join(codes, "value").select("id", "value", "code")


def canonical(values: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def manifest(geometries: DataFrame, parts: DataFrame, views: list[str]) -> DataFrame:
    """Every geometry (platform) with every part key (slot, family) in every view, and a digest as job_id."""
    keys = geometries.agg(F.collect_set("platform").alias("_all"))  # a platform a case model: some dozens, whatever the catalog's size
    spread = parts.join(F.broadcast(keys), F.size("_all") > 0).select("slot", "family", F.explode("_all").alias("platform"))
    all_ = spread.select("platform", "slot", "family", F.explode(F.array(*map(F.lit, views))).alias("view"))
    return all_.withColumn("job_id", F.sha2(F.concat_ws("/", "platform", "slot", "family", "view"), 256))


def missing_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without an output yet."""
    return jobs.join(done, "job_id", "left_anti")
