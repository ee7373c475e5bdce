"""Bounded, deterministic samples of labelled rows, and splits by document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def sample_labels(labels: DataFrame, label: str, bound: int, classes: int | None = None) -> tuple[DataFrame, dict]:
    """(doc_id, label) of about `bound` rows of each class at most, and each class's count.

    Which rows are taken depends on a hash of the id alone.  A document labelled
    more than once counts once, by its largest label.
    """
    once = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    counts = {r[label]: r["count"] for r in once.groupBy(label).count().collect()}
    chance = F.lit(0.0)
    for value, n in counts.items():
        chance = F.when(F.col(label) == value, F.lit(min(1.0, bound / n))).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return once.where(draw < chance), counts
