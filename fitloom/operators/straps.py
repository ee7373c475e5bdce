"""One strap for each build of an ordered list: greedy, with penalties for parts and kinds that the list has used.

The state that passes from build to build is small: which straps are taken, and how often each
kind.  Straps of a class pass or fail a build's rules alike, and those of equal looks score alike, so
builds that pass with the same straps share a queue of straps for each looks.  A build
of a list of n takes one of the first n of a kind by score and key, since at most n - 1 are taken:
these, and no pairs of builds and straps, are what is dealt to the lists.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fitloom.operators import evaluate
from fitloom.operators.rules import INFO, RULES
from fitloom.plans.mapping import SLOTS

# Kinds of strap that each look calls for, best first, and the material of its bands.
KINDS = {
    "dress": ["strap-band", "strap-jubilee", "strap-oyster"], "field": ["strap-nato", "strap-band", "strap-oyster"], "gmt": ["strap-jubilee", "strap-oyster", "strap-band"], "utility": ["strap-band", "strap-nato", "strap-oyster"],
    "skin": ["strap-band", "strap-oyster", "strap-nato"], "vintage": ["strap-band", "strap-nato", "strap-oyster"], "dive": ["strap-oyster", "strap-jubilee", "strap-bracelet", "strap-band"],
}
MATERIAL = {"dress": "leather", "field": "either", "gmt": "either", "utility": "rubber", "skin": "rubber", "vintage": "rubber", "dive": "rubber"}
# Words of a build's name for each look, words of materials, colours that a strap may echo, and platforms that names state.
NAMED = [("dress", "dress"), ("field", "field"), ("gmt", "gmt|traveller"), ("utility", "utility"), ("skin", "skin"), ("vintage", "vintage")]
LEATHER, RUBBER, TROPIC = r"(?i)\b(leather|cordovan|suede|calf|pebbled|shell)\b", r"(?i)\b(rubber|fkm|silicone|tropic|waffle)\b", r"(?i)\btropic\b"
COLOURS = ["green", "blue", "brown", "orange", "red", "cream", "grey"]
PLATFORMS = [("SKX013", "(?i)SKX013"), ("Turtle", "(?i)Turtle|SRP")]
DARK = "(?i)black|pvd|dlc"
# Scores of a kind's rank, of materials, colours and platform, and the penalties of what is used.
RANK, USED_PART, USED_KIND = 100, 250, 22
#: Rules whose warnings every build of the catalog carries.
CATALOG_WIDE = ("unverified-part", "date-window-alignment", "day-window-presence", "hand-stack-clearance", "strap-fit")
#: Rules that read the strap.
STRAP_RULES = ("strap-fit", "bracelet-vendor-scope", "family-exception")


def look(slug: Column, tags: Column) -> Column:
    """What kind of object a build is: by its name, else by its parts' tags."""
    has = lambda t: F.array_contains(tags, t)
    named = F.when(F.lit(False), "")
    for name, words in NAMED:
        named = named.when(slug.rlike(words), name)
    return named.when(has("dressy") & ~has("tool-watch"), "dress").when(has("pilot"), "field").otherwise("dive")


def classes(straps: DataFrame, longest: int) -> DataFrame:
    """(kind, fit_class, looks, ids): straps alike in every score and rule, and the first `longest` of each class.

    straps: part_id, name, kind, tags, fit_class.  Ranks are cut before rows are shuffled.
    """
    name, tags = F.col("name"), F.col("tags")
    has = lambda t: F.array_contains(tags, t)
    looks = F.struct(
        name.rlike(LEATHER).alias("leather"), name.rlike(RUBBER).alias("rubber"), name.rlike(TROPIC).alias("tropic"), F.array_sort(F.array_intersect(tags, F.array(*map(F.lit, COLOURS)))).alias("colours"), has("black").alias("black"),
        has("brown").alias("brown"), (has("silver-tone") | (F.size(tags) == 0)).alias("steel"), *[name.rlike(f"(?i){p}").alias(p) for p in ("SKX007", "SKX013", "Turtle")],
    )
    turn = F.row_number().over(W.partitionBy("kind", "fit_class", "looks").orderBy("part_id"))
    first = straps.select("part_id", "kind", "fit_class", looks.alias("looks")).withColumn("turn", turn).where(F.col("turn") <= longest)
    return first.groupBy("kind", "fit_class", "looks").agg(F.array_sort(F.collect_list("part_id")).alias("ids"))


def score(rank: Column, s: Column) -> Column:
    """Score of a strap of looks s for a build (columns look, colours, dark, platform) before penalties; rank counts from 0 at the best kind."""
    size, material = F.lit(0), F.lit("either")
    for name, kinds in KINDS.items():
        size = F.when(F.col("look") == name, len(kinds)).otherwise(size)
        material = F.when(F.col("look") == name, MATERIAL[name]).otherwise(material)
    band = (
        F.when(material == "leather", F.when(s["leather"], 120).when(s["rubber"], -40).otherwise(0)).when(material == "rubber", F.when(s["rubber"], 120).when(s["leather"], 30).otherwise(0))
        .otherwise(F.when(s["leather"] | s["rubber"], 60).otherwise(0)) + F.when((F.col("look") == "vintage") & s["tropic"], 60).otherwise(0)
    )
    yes = lambda c, n: F.when(c, n).otherwise(0)
    dark, metal = F.col("dark"), ~F.col("kind").isin("strap-band", "strap-nato")
    colour = F.when(F.arrays_overlap("colours", s["colours"]), 30).when(s["black"] | s["brown"], 14).otherwise(0) + yes(dark & s["black"], 10)
    steel = yes(dark & s["black"], 8) + yes(~dark & s["steel"], 14) - yes(~dark & s["black"], 30)
    own = F.coalesce(*[F.when((F.col("platform") == p) & s[p], 18) for p in ("SKX007", "SKX013", "Turtle")], F.lit(0))
    return (size - rank) * RANK + yes(F.col("kind") == "strap-band", band) + colour + yes(metal, steel) + own


def refusing() -> tuple:
    """Rules that can refuse a build: with findings that are more than notes."""
    return tuple(r for r in RULES if r.key == "family-exception" or any(not isinstance(f.severity, str) or f.severity != INFO for f in r.findings()))


def passing(builds: DataFrame) -> DataFrame:
    """Wide rows that pass before they have a strap: rules that read none are judged once a build."""
    return _passing(builds, tuple(r for r in refusing() if r.key not in STRAP_RULES or r.key == "family-exception"))


def fitting(builds: DataFrame, straps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those (build_id, fit_class) of pairs whose build passes with such a strap: no error, and no warning but catalog-wide ones.

    builds: wide rows that pass without a strap; straps: (fit_class, p_strap), one row each.
    The strap's rules read the strap and the case alone; the other parts' exceptions have been judged.
    """
    case = builds.select("build_id", "p_case", *[F.lit(None).cast(builds.schema[f"p_{s}"].dataType).alias(f"p_{s}") for s in SLOTS if s not in ("case", "strap")])
    tried = pairs.join(case, "build_id").join(straps, "fit_class")
    return _passing(tried, tuple(r for r in RULES if r.key in STRAP_RULES)).select("build_id", "fit_class")


def _passing(wide: DataFrame, rules: tuple) -> DataFrame:
    """Rows without an error by rules and without a warning by those that are not catalog-wide; counted in place, nothing is shuffled.

    A generator of one row keeps the long counts from being copied into the filters that read them.
    """
    once = lambda df: df.select(F.inline(F.array(F.struct("*"))))
    strict, lenient = (tuple(r for r in rules if (r.key in CATALOG_WIDE) == wide_) for wide_ in (False, True))
    if strict:
        wide = once(evaluate.counted(wide, strict)).where("n_error = 0 AND n_warning = 0").drop("n_error", "n_warning", "n_info")
    if lenient:
        wide = once(evaluate.counted(wide, lenient)).where("n_error = 0").drop("n_error", "n_warning", "n_info")
    return wide


def _fold(batches):
    """Lists arrive one after the other, each in order, a row for each kind that a build asks for; only the state of the current list is held."""
    names = ["collection", "position", "build_id", "look", "part_id", "kind", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)
    now, taken, kinds, out = object(), set(), Counter(), []
    rows = (r for batch in batches for r in batch.to_pylist())
    for (collection, position, build, look), asked in groupby(rows, lambda r: (r["collection"], r["position"], r["build_id"], r["look"])):
        if collection != now:
            now, taken, kinds = collection, set(), Counter()
        found = [(c["cost"] + USED_PART * (c["part_id"] in taken) + USED_KIND * kinds[r["kind"]], c["part_id"], r["kind"]) for r in asked for c in r["best"] or []]
        cost, part, kind = min(found, default=(None, None, None))
        if part is not None:
            taken.add(part)
            kinds[kind] += 1
        out.append((collection, position, build, look, part, kind, None if part is None else -cost))
        if len(out) == 4096:
            yield made(out)
            out = []
    yield made(out)


def pick_straps(builds: DataFrame, straps: DataFrame, fits) -> DataFrame:
    """(collection, position, build_id, look, part_id, kind, score) of every build; no part where none passes.

    builds: collection, position, build_id, slug, tags, case_name, a list's builds at distinct positions, and if given fits_like,
    equal for builds that pass with the same straps and null for those that pass with none; straps:
    part_id, name, kind, tags, fit_class; fits(pairs): those (build_id, fit_class) of pairs that pass,
    asked for one build of each fits_like.  Lists are dealt to tasks by their key
    and read in order as a stream, since each pick rests on those before it.
    Cases: a build without tags, name or case gets the fallbacks; ties go to the smaller
    part_id; a list longer than all its straps takes used ones again at their penalty;
    empty tables give no row, and builds without straps no part.
    """
    case = F.coalesce("case_name", F.lit(""))
    platform = F.when(F.lit(False), "")
    for name, words in PLATFORMS:
        platform = platform.when(case.rlike(words), name)
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    told = builds.select(
        F.col("collection").cast("long").alias("collection"), F.col("position").cast("long").alias("position"), F.col("build_id").cast("long").alias("build_id"), look(F.coalesce("slug", F.lit("")), tags).alias("look"),
        F.array_intersect(tags, F.array(*map(F.lit, COLOURS))).alias("colours"), case.rlike(DARK).alias("dark"), platform.otherwise("SKX007").alias("platform"), F.col("fits_like" if "fits_like" in builds.columns else "build_id").alias("alike"),
    )
    longest = told.groupBy("collection").count().agg(F.max("count")).first()[0] or 0
    ranked = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = told.withColumn("n", F.count("*").over(W.partitionBy("collection"))).select("*", F.posexplode(ranked[F.col("look")]).alias("rank", "kind"))
    known = classes(straps.select("part_id", F.coalesce("name", F.lit("")).alias("name"), "kind", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "fit_class"), longest)
    tried = told.where("alike IS NOT NULL").groupBy("alike").agg(F.min("build_id").alias("build_id")).join(known.select("fit_class").distinct())
    passed = tried.join(fits(tried.select("build_id", "fit_class")), ["build_id", "fit_class"], "left_semi")
    queues = passed.join(known, "fit_class").groupBy("alike", "kind", "looks").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, longest).alias("ids"))
    shelf = queues.groupBy("alike", "kind").agg(F.collect_list(F.struct("looks", "ids")).alias("queues"))
    # Of the queues by score and first strap no more than n can hold one of the first n straps.
    scored = F.transform("queues", lambda q: F.struct((-score(F.col("rank"), q["looks"])).cast("long").alias("cost"), q["ids"].alias("ids")))
    first = F.slice(F.sort_array(scored), F.lit(1), F.col("n").cast("int"))
    best = F.slice(F.sort_array(F.flatten(F.transform(first, lambda q: F.transform(q["ids"], lambda i: F.struct(q["cost"].alias("cost"), i.alias("part_id")))))), F.lit(1), F.col("n").cast("int"))
    offered = asked.join(shelf, ["alike", "kind"], "left").select("collection", "position", "build_id", "look", "kind", best.alias("best"))
    ordered = offered.repartition("collection").sortWithinPartitions("collection", "position", "build_id")
    return ordered.mapInArrow(_fold, "collection long, position long, build_id long, look string, part_id long, kind string, score long")
