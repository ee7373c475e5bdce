"""File sources: vendor feeds, their latest snapshot, tagged rows with per-row validation, fixtures and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a feed's product, variant and image.
FEED = (
    "id bigint, title string, handle string, body_html string, product_type string, tags array<string>, "
    "variants array<struct<id: bigint, title: string, price: string, available: boolean>>, images array<struct<src: string>>"
)
TAGGED = "sourceUrl string, category string, family string, name string, specSource string, confidence string, evidence string, styleTags array<string>"
CATEGORIES = ("movement", "case", "dial", "hands", "bezel_insert", "crystal", "chapter_ring", "crown", "bezel", "strap")
SPEC_SOURCES, CONFIDENCE = ("vendor-stated", "family-inferred", "manual"), ("high", "medium", "low")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Products of a feed (JSON lines); a row of another shape stops the read, as a changed feed must not pass unseen."""
    return spark.read.schema(FEED).option("mode", "FAILFAST").json(path)


def listings_of(products: DataFrame) -> DataFrame:
    """(handle, variant, price_minor, in_stock): prices are strings with two decimals, never read through a float; any other spelling is null."""
    v = products.select("handle", F.posexplode("variants").alias("turn", "v"))
    price = F.when(F.col("v.price").rlike(r"^\d+\.\d{2}$"), F.regexp_replace("v.price", r"\.", "").cast("long"))
    return v.select("handle", "turn", F.col("v.id").alias("variant"), price.alias("price_minor"), F.coalesce("v.available", F.lit(False)).alias("in_stock"))


def latest_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(vendor, path) of each vendor's last file named vendor-<ISO time>.json under folder; the listing alone is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select("path", F.regexp_extract(name, r"^(.+?)-(\d{4}-\d{2}-\d{2}.*)\.json$", 1).alias("vendor"), F.regexp_extract(name, r"^(.+?)-(\d{4}-\d{2}-\d{2}.*)\.json$", 2).alias("day"))
    return parts.where("vendor <> ''").groupBy("vendor").agg(F.max_by("path", F.struct("day", "path")).alias("path"))


def tagged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, refused rows with `problem`) of tagged files (JSON lines); no row is lost."""
    rows = spark.read.schema(TAGGED + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    problem = (
        F.when(F.col("_bad").isNotNull(), "not JSON of this shape").when(F.col("sourceUrl").isNull() | F.col("name").isNull(), "a field is missing").when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "unknown category")
        .when(~F.coalesce(F.col("specSource").isin(*SPEC_SOURCES), F.lit(False)), "unknown source").when(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)), "unknown confidence")
    )
    judged = rows.withColumn("problem", problem)
    return judged.where("problem is null").drop("problem", "_bad"), judged.where("problem is not null")


def fixtures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of several lines, such as rates or reference builds."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, pixels) of the images that the JVM decodes, rows of bytes in the order blue, green, red; others are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(folder)
    return rows.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
