"""Builds as query strings, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.plans.mapping import SLOTS


def encode(slots: DataFrame) -> DataFrame:
    """(build_id, link): slot=part pairs in the order of slots' names; a build has ten slots at most."""
    pair = F.struct("slot", F.concat_ws("=", F.url_encode("slot"), F.url_encode(F.col("part_id").cast("string"))).alias("text"))
    return slots.groupBy("build_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["text"]), "&").alias("link"))


def decode(built: DataFrame, catalog: DataFrame) -> DataFrame:
    """(build_id, slot, part_id, verdict): unknown slot, malformed, unknown part, wrong slot or ok, the first that holds."""
    pairs = built.select("build_id", F.explode(F.split("link", "&")).alias("pair"))
    name, value = F.try_url_decode(F.split_part("pair", F.lit("="), F.lit(1))), F.try_url_decode(F.split_part("pair", F.lit("="), F.lit(2)))
    rows = pairs.select("build_id", name.alias("slot"), F.when(name.isin(*SLOTS) & value.rlike("^[0-9]{1,18}$"), value.cast("long")).alias("part_id"))
    known = catalog.select("part_id", F.col("slot").alias("own"))
    verdict = F.when(~F.col("slot").isin(*SLOTS), "unknown slot").when(F.col("part_id").isNull(), "malformed").when(F.col("own").isNull(), "unknown part").when(F.col("own") != F.col("slot"), "wrong slot").otherwise("ok")
    return rows.join(known, "part_id", "left").select("build_id", "slot", "part_id", verdict.alias("verdict"))
