"""Small values and texts as column expressions: JSON, masks, callers, images, reasons, build titles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions import text

# What pictures' attributes mean as tags, and kinds of cases in words.
OF_TEXTURE = {"sunburst": "sunburst", "matte": "matte", "textured": "textured", "lacquer": "enamel"}
OF_INDEX = {"arabic": "arabic-numerals", "roman": "roman-numerals"}
OF_HANDS = {"sword": "sword-hands", "mercedes": "three-lobe-hands", "snowflake": "faceted-hands", "dauphine": "dauphine-hands", "plongeur": "sword-hands"}
OF_BEZEL = {"dive": "dive-bezel", "gmt": "gmt-bezel", "fixed": "plain-bezel"}
PLATFORM_WORDS = {"skx007": "42.5mm diver", "skx013": "37mm diver", "srp-turtle": "cushion-case diver", "srpe": "modern diver", "ssk-gmt": "GMT diver", "lucius-ultra-thin": "slim diver", "alpinist-style": "field-style build"}
# First bytes of images in hexadecimal with their place, and the most bytes of an upload.
MAGIC, MOST_BYTES = (("image/jpeg", 0, "FFD8FF"), ("image/png", 0, "89504E47"), ("image/webp", 8, "57454250")), 10 << 20


def patch_json(attributes: Column, changes: Column) -> Column:
    """A flat JSON object with the changes (a map) written over it, keys in order; a change to null removes its key."""
    old = F.coalesce(F.from_json(attributes, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(changes), k))
    both = F.map_concat(kept, F.map_filter(changes, lambda k, v: v.isNotNull()))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both))))


def part_reason(matched: Column) -> Column:
    return F.when(F.size(matched) > 0, F.concat(F.lit("chosen for "), text.english_list(matched))).otherwise("cheapest that fits the rest")


def json_object(reply: Column) -> Column:
    """From the first brace to the last of a reply, or of its fenced part; null without one."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(reply.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(reply)
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


def intent_of_json(raw: Column) -> Column:
    """A wish from JSON that meets the schema: a positive budget of at most 10,000.00, a currency of three letters, a range within 20 to 60; else an empty one."""
    p = F.from_json(raw, "budgetMinor bigint, currency string, styleTags array<string>, lo double, hi double", {"mode": "PERMISSIVE"})

    def read(w: Column) -> Column:
        good = w["styleTags"].isNotNull() & (F.length(w["currency"]) == 3) & F.coalesce((w["budgetMinor"] > 0) & (w["budgetMinor"] <= 1_000_000), F.lit(True))
        good, none = F.coalesce(good, F.lit(False)), F.array().cast("array<string>")
        size = good & (w["lo"] > 20) & (w["hi"] <= 60) & (w["lo"] <= w["hi"])
        return F.struct(
            F.when(good, w["budgetMinor"]).alias("budget_minor"), F.when(good, F.upper(w["currency"])).otherwise("GBP").alias("currency"), F.when(good, text.known_tags(w["styleTags"])).otherwise(none).alias("tags"),
            F.when(good, text.dropped_tags(w["styleTags"])).otherwise(none).alias("dropped"), F.when(size, w["lo"]).alias("size_from"), F.when(size, w["hi"]).alias("size_to"),
        )

    return text.once(p, read)


def caller(forwarded: Column, real: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(forwarded, ","), 1)), F.lit("")), real, F.lit("unknown"))


def image_kind(data: Column) -> Column:
    """(mime, problem) of an upload by its first bytes."""
    size = F.octet_length(data)
    mime = F.coalesce(*[F.when(F.hex(F.substring(data, at + 1, len(b) // 2)) == b, F.lit(m)) for m, at, b in MAGIC])
    problem = F.when(size == 0, "empty").when(size > MOST_BYTES, "too large").when(mime.isNull(), "not an image")
    return F.struct(F.when(problem.isNull(), mime).alias("mime"), problem.alias("problem"))


def tag_mask(tags: Column) -> Column:
    """One bit for each tag of the vocabulary, in its order; 44 of them fit a long."""
    places = F.create_map(*[F.lit(x) for i, (t, _, _) in enumerate(text.STYLE_TAGS) for x in (t, 1 << i)])
    return F.aggregate(tags, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(F.coalesce(places[t], F.lit(0)).cast("long")))


def tags_of_attributes(said: Column, low: Column) -> Column:
    """Tags of a picture's attributes (colour, texture, index, hands, bezel) that are not named in `low`."""
    usable = lambda name: ~F.coalesce(F.array_contains(low, name), F.lit(False))
    colours = [F.when(usable("colour") & said["colour"].rlike(f"(?i){p}"), F.lit(t)) for t, p, _ in text.STYLE_TAGS[:13]]
    of = lambda name, table: F.when(usable(name), F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[said[name]])
    return F.array_distinct(F.array_compact(F.array(*colours, of("texture", OF_TEXTURE), of("index", OF_INDEX), of("hands", OF_HANDS), of("bezel", OF_BEZEL))))


def build_titles(builds: DataFrame, held: DataFrame) -> DataFrame:
    """(build_id, title): the dial's words, without codes, brackets and reserved terms, before the kind of case; held has (build_id, slot, family, name)."""
    of = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    rows = builds.join(held.groupBy("build_id").agg(of("case", "family").alias("family"), of("dial", "name").alias("dial")), "build_id", "left")
    base = F.coalesce(*[F.when(F.col("family").startswith(p), F.lit(w)) for p, w in PLATFORM_WORDS.items()], F.lit("Seiko mod build"))
    reserved = r"(?i)\b(?:" + "|".join(re.escape(t) for t in text.RESERVED) + r")\b"
    words = F.col("dial")
    for pattern in (r"^[A-Z]{1,3}\d{3,5}\s*", r"(?i)\b(watch\s+)?dial\b:?", r"\(.*?\)", reserved):
        words = F.regexp_replace(words, pattern, "")
    words = F.trim(F.regexp_replace(F.regexp_replace(words, r"\s{2,}", " "), r"^[-–—:/\s]+|[-–—:/\s]+$", ""))
    title = F.when(F.coalesce(words, F.lit("")) == "", F.concat(F.upper(F.substring(base, 1, 1)), F.substring(base, 2, 100))).otherwise(F.concat(words, F.lit(" "), base))
    return rows.select("build_id", title.alias("title"))
