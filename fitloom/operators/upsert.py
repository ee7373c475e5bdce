"""Writers as set operations: upserts, inserts if absent, guarded updates, merges.

Each gives the new state of a table as a DataFrame; `replace_table` swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the one of the greatest `order`; combines map-side, without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str], update: list[str]) -> DataFrame:
    """table after changes: a known key takes the `update` columns of its latest change, a new key is inserted whole."""
    new = latest(changes, keys, order)
    flag = new.select(*keys, F.struct(*[c for c in table.columns if c not in keys]).alias("_new"))
    both = table.withColumn("_old", F.struct(*[c for c in table.columns if c not in keys])).select(*keys, "_old").join(flag, keys, "full_outer")
    rest = [c for c in table.columns if c not in keys]
    pick = lambda c: F.when(F.col("_old").isNull(), F.col("_new")[c]).when(F.col("_new").isNull() | F.lit(c not in update), F.col("_old")[c]).otherwise(F.col("_new")[c])
    return both.select(*keys, *[pick(c).alias(c) for c in rest]).select(table.columns)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows whose key it lacks; of rows that share a new key the least one."""
    fresh = rows.join(table.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in table.columns if c not in keys]
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    return table.unionByName(one.select(table.columns))


def update_where(table: DataFrame, changes: DataFrame, keys: list[str], guard: Column, columns: list[str]) -> DataFrame:
    """Columns of rows that meet the guard, replaced by the change of their key; of several changes of a key the least one."""
    new = changes.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_new"))
    joined = table.join(new, keys, "left")
    hit = guard & F.col("_new").isNotNull()
    return joined.select(*[F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def apply_merges(parts: DataFrame, listings: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, listings, audit) after merges (merged_id, canonical_id).

    Listings move to the canonical part, but where it has the vendor already its own stays;
    merged parts go, and each leaves an audit row with what it was.
    """
    kept = parts.join(merges.select(F.col("merged_id").alias("part_id")), "part_id", "left_anti")
    audit = parts.join(merges.withColumnRenamed("merged_id", "part_id"), "part_id").withColumnRenamed("part_id", "merged_id")
    moved = listings.join(merges.withColumnRenamed("merged_id", "part_id"), "part_id", "left")
    target = moved.withColumn("_own", F.col("canonical_id").isNull()).withColumn("_from", F.col("part_id")).withColumn("part_id", F.coalesce("canonical_id", "part_id")).drop("canonical_id")
    rest = [c for c in listings.columns if c not in ("part_id", "vendor_id")]
    one = target.groupBy("part_id", "vendor_id").agg(F.min_by(F.struct(*rest), F.struct(~F.col("_own"), "_from")).alias("_row"))
    return kept, one.select("part_id", "vendor_id", *[F.col("_row")[c].alias(c) for c in rest]).select(listings.columns), audit


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the old version, set the old one aside, and only then swap.

    A crash leaves the old version at path or beside it as path.old, never neither;
    the next call puts it back first.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".next", ".old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(at):
        fs.rename(old, at)
    df.write.mode("overwrite").parquet(f"{path}.next")
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"could not set {at} aside")
    if not fs.rename(new, at):
        raise OSError(f"could not move {new} to {at}; the old version is at {old}")
    fs.delete(old, True)
