"""Probable duplicates across vendors, by words and by perceptual hash; the pair matrix."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.functions.text import jaccard
from fitloom.operators import evaluate
from fitloom.operators.offers import part_offers
from fitloom.operators.rules import RULES
from fitloom.plans.mapping import PART_FIELDS, SLOTS

#: Bits of 256 that may differ for images to count as close, and the least overlap of names.
CLOSE, OVERLAP = 40, 0.28


def overlapping_names(parts: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(category, a, b, overlap, n_a, n_b): pairs of different word sets of one category that share enough words.

    parts: (id, category, words).  Parts of the same words are one class and
    are counted, not paired; classes meet through an index on the words that they share, so
    no category is crossed with itself.  a and b are the words, a first in order.
    """
    kinds = parts.where(F.size("words") > 0).groupBy("category", F.array_join(F.array_sort("words"), " ").alias("kind")).agg(F.count("*").alias("n"))
    index = kinds.select("category", "kind", "n", F.explode(F.split("kind", " ")).alias("word"))
    other = index.select("category", "word", F.col("kind").alias("b"), F.col("n").alias("n_b"))
    shared = index.join(other, ["category", "word"]).where("kind < b").groupBy("category", F.col("kind").alias("a"), "b").agg(F.count("*").alias("i"), F.max("n").alias("n_a"), F.max("n_b").alias("n_b"))
    words = lambda c: F.size(F.split(c, " "))
    return shared.withColumn("overlap", F.col("i") / (words("a") + words("b") - F.col("i"))).where(F.col("overlap") >= least).select("category", "a", "b", "overlap", "n_a", "n_b")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes kept as arrays of four longs; null where either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)


def hash_words(hex_: Column) -> Column:
    """A hash of 64 hexadecimal digits as four longs; null for any other text."""
    return F.when(hex_.rlike("^[0-9a-fA-F]{64}$"), F.array(*[F.conv(F.substring(hex_, 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)]))


def colour_agreement(a: Column, b: Column) -> Column:
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), "unknown").when(F.array_sort(a) == F.array_sort(b), "agree").otherwise("differ")


def suggestions(pairs: DataFrame, limit: int = 8) -> DataFrame:
    """Best candidates of each seed from (seed, part, overlap, distance): close images first, by distance, then overlap."""
    near = F.coalesce(F.col("distance") <= CLOSE, F.lit(False))
    order = W.partitionBy("seed").orderBy(F.desc(near), F.when(near, F.col("distance")), F.desc("overlap"), "part")
    return pairs.where(near | (F.col("overlap") >= OVERLAP)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _shared(words: pa.ListArray, other: pa.ListArray) -> np.ndarray:
    """Overlap of each word set with each other one; 0 where either is empty."""
    n, m = (np.diff(w.offsets.to_numpy()) for w in (words, other))
    codes = pa.concat_arrays([words.flatten(), other.flatten()]).dictionary_encode()
    held = np.zeros((len(n) + len(m), max(1, len(codes.dictionary))), np.float32)
    held[np.repeat(np.arange(len(held)), np.concatenate([n, m])), codes.indices.to_numpy(zero_copy_only=False)] = 1
    both = (held[: len(n)] @ held[len(n) :].T).astype(float)
    return both / np.maximum(n[:, None] + m[None, :] - both, 1)


def _best_of_blocks(limit: int, most: int, named: bool):
    def run(table: pa.Table) -> pa.Table:
        sides = []
        for side in ("left", "right"):
            ids, vendors, words, bits = table.column(side).combine_chunks()[0].values.flatten()
            order = pa.array(np.argsort(ids.to_numpy(), kind="stable"))
            sides.append((ids.take(order).to_numpy(), vendors.take(order), words.take(order), np.stack(bits.take(order).to_numpy(zero_copy_only=False)).view(np.uint64)))
        (a, va, wa, x), (b, vb, wb, y) = sides
        far = sum(np.bitwise_count(x[:, k, None] ^ y[None, :, k]).astype(np.int64) for k in range(x.shape[1]))
        sellers = pa.concat_arrays([va, vb]).dictionary_encode().indices.fill_null(-1).to_numpy()
        same = (sellers[: len(a), None] == sellers[None, len(a) :]) & (sellers[: len(a), None] >= 0)
        overlap = _shared(wa, wb) if named else np.zeros(far.shape)
        levels, level = np.unique(-overlap, return_inverse=True)
        # Ids are in order, so a place stands for the smaller id.
        key = (far * len(levels) + level.reshape(far.shape)) * len(b) + np.arange(len(b))
        none = np.iinfo(np.int64).max
        key[(far > most) | same | (a[:, None] == b[None, :])] = none
        k = min(limit, len(b))
        at = np.argpartition(key, k - 1, axis=1)[:, :k]
        i, j = np.nonzero(np.take_along_axis(key, at, 1) < none)
        j = at[i, j]
        return pa.table({"seed": a[i], "part": b[j], "distance": far[i, j], "overlap": overlap[i, j]})

    return run


def closest(items: DataFrame, limit: int, most: int, block: int = 512, named: bool = True) -> DataFrame:
    """(seed, part, distance, overlap): for every item its `limit` closest of the same category and another vendor; exact.

    items: (id, category, vendor, words, bits), bits a hash as an array of longs.  Order is by distance, then
    overlap, then the smaller id; distances above `most` don't count and neither do items without a hash.  Blocks of a
    category's items meet in pairs, and only the best of each item leave a pair of blocks, so a group of like
    items makes `limit` rows an item.
    """
    rows = items.where("category is not null and id is not null and bits is not null")
    size = rows.groupBy("category").agg(F.ceil(F.count("*") / block).alias("blocks"))
    item = F.struct("id", "vendor", F.coalesce("words", F.array().cast("array<string>")).alias("words"), "bits")
    blocks = rows.join(size, "category").groupBy("category", F.pmod(F.xxhash64("id"), "blocks").alias("x")).agg(F.collect_list(item).alias("left"))
    other = blocks.select("category", F.col("x").alias("y"), F.col("left").alias("right"))
    met = blocks.join(other, "category").groupBy("category", "x", "y").applyInArrow(_best_of_blocks(limit, most, named), "seed long, part long, distance long, overlap double")
    order = W.partitionBy("seed").orderBy("distance", F.desc("overlap"), "part")
    return met.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= limit).drop("turn")


def nearest(left: DataFrame, right: DataFrame, limit: int, most: int = 64, block: int = 256) -> DataFrame:
    """(a, b, distance): for each left row (a, category, h) the `limit` nearest of right (b, category, h), h a long; exact, ties to the smaller b.

    Each left row meets blocks of the category's right rows, and `limit` rows at most leave a block: pairs are
    neither shuffled nor sorted.  Distances above `most` and a row's own id don't count.
    """
    rows = right.where("category is not null and h is not null")
    size = rows.groupBy("category").agg(F.ceil(F.count("*") / block).alias("blocks"))
    held = rows.join(size, "category").groupBy("category", F.pmod(F.xxhash64("b"), "blocks").alias("x")).agg(F.collect_list(F.struct("b", F.col("h").alias("g"))).alias("held"))
    asked = left.join(size, "category").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    far = F.transform("held", lambda r: F.struct(F.bit_count(r["g"].bitwiseXOR(F.col("h"))).alias("distance"), r["b"].alias("b")))
    close = F.filter(far, lambda r: (r["distance"] <= most) & (r["b"] != F.col("a")))
    best = F.array_compact(F.array(F.array_min(close))) if limit == 1 else F.slice(F.array_sort(close), 1, limit)
    met = asked.join(held, ["category", "x"]).select("a", F.inline(best)).select("a", "b", "distance")
    return met.withColumn("turn", F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))).where(F.col("turn") <= limit).drop("turn")


def alike(parts: DataFrame, limit: int = 8) -> DataFrame:
    """(seed, part): for every part the `limit` of another vendor whose names overlap most, then of the smaller id; exact.

    Word sets meet and not parts.  At most `limit` parts of a vendor and twice as many
    of all vendors can matter to a word set, whichever vendor its seed has.
    """
    known = parts.where(F.size("words") > 0).withColumn("kind", F.array_join(F.array_sort("words"), " "))

    def cut(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
        for by, n in (([*keys, "vendor"], limit), (keys, 2 * limit)):
            rows = rows.withColumn("turn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("turn") <= n).drop("turn")
        return rows

    pairs = overlapping_names(parts).select("category", "a", "b", "overlap")
    own = known.select("category", F.col("kind").alias("a"), F.col("kind").alias("b"), F.lit(1.0).alias("overlap")).distinct()
    both = pairs.unionByName(pairs.select("category", F.col("b").alias("a"), F.col("a").alias("b"), "overlap")).unionByName(own)
    first = cut(known.select("category", F.col("kind").alias("b"), "vendor", F.col("id").alias("part")), ["category", "b"], ["part"])
    ranked = cut(both.join(first, ["category", "b"]).select("category", F.col("a").alias("kind"), "overlap", "vendor", "part"), ["category", "kind"], [F.desc("overlap"), "part"])
    return known.select("category", "kind", F.col("id").alias("seed"), F.col("vendor").alias("own")).join(ranked, ["category", "kind"]).where(F.coalesce(F.col("vendor") != F.col("own"), F.lit(True)) & (F.col("part") != F.col("seed"))).select("seed", "part")


def candidates(parts: DataFrame, limit: int = 8) -> DataFrame:
    """(seed, part, overlap, distance) of every part: its best by image and its best by name, for `suggestions`."""
    found = closest(parts, limit, CLOSE).select("seed", "part").join(alike(parts, limit), ["seed", "part"], "full_outer")
    a, b = parts.select(F.col("id").alias("seed"), F.col("words").alias("w"), F.col("bits").alias("h")), parts.select(F.col("id").alias("part"), "words", "bits")
    return found.join(a, "seed").join(b, "part").select("seed", "part", jaccard(F.col("w"), F.col("words")).alias("overlap"), hamming(F.col("h"), F.col("bits")).alias("distance"))


def mutual(items: DataFrame) -> DataFrame:
    """(a, b, score), a < b: pairs in which each item is the other's best of all items of the category."""
    best = closest(items, 1, 64, block=2048, named=False).select(F.col("seed").alias("a"), F.col("part").alias("b"), (64 - F.col("distance")).alias("score"))
    # Both directions, so that each side's best of all is among its pairs.
    return mutual_best(best.unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).distinct()).where("a < b")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, score) in which each side is the other's best; ties go to the smaller id."""
    best = lambda x, y: pairs.groupBy(x).agg(F.min_by(y, F.struct(-F.col("score"), y)).alias(y))
    return pairs.join(best("a", "b"), ["a", "b"], "left_semi").join(best("b", "a"), ["a", "b"], "left_semi")


def pair_outcomes(catalog: DataFrame, anchor: str, slots: list[str]) -> DataFrame:
    """(slot, outcome, pairs) of the anchor's parts with those of each slot, by platform.

    The sides are collapsed to platforms with counts before they meet, so what is
    joined has a row for each slot and platform, however large the catalog.
    """
    keys = catalog.where(F.col("slot").isin(anchor, *slots)).groupBy("slot", F.nullif("platform", F.lit("")).alias("p")).agg(F.count("*").alias("n"))
    a = keys.where(F.col("slot") == anchor).select(F.lit(1).alias("k"), F.col("p").alias("pa"), F.col("n").alias("na"))
    b = keys.where(F.col("slot") != anchor).select(F.lit(1).alias("k"), "slot", "p", "n")
    outcome = F.when(F.col("p").isNull() | F.col("pa").isNull(), "unconfirmed").when(F.col("p") == F.col("pa"), "ok").otherwise("blocked")
    return a.join(b, "k").groupBy("slot", outcome.alias("outcome")).agg(F.sum(F.col("na") * F.col("n")).alias("pairs"))


#: Slots that a rule applies to besides those its findings name, and texts of warnings that confirm nothing.
ALSO = {"movement-case-fit": ("case",), "chapter-ring-fit": ("dial",), "hand-stack-clearance": ("dial",)}
UNSURE = "not stated|not known|can't be (read|confirmed)"


def rule_pairs() -> dict[tuple[str, str], list]:
    """Slot pairs, each with the rules of fewer than ten slots that apply to both."""
    found: dict[tuple[str, str], list] = {}
    for rule in RULES:
        slots = {s for f in rule.findings() for s in f.slots} | set(ALSO.get(rule.key, ()))
        if len(slots) < len(SLOTS):
            for pair in combinations(sorted(slots), 2):
                found.setdefault(pair, []).append(rule)
    return dict(sorted(found.items()))


def judged_pairs(catalog: DataFrame, listings: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(slot_a, slot_b, rule_key, outcome, raw_error, pairs): every part of one slot with every part of another under their rules.

    rule_key is null for all rules of the pair together.  An outcome is error, warning,
    cant-confirm (only warnings that confirm nothing) or ok, after the evidence is weighed; raw_error tells
    of errors before that.  Each side is cut to the columns that the pair's rules read, with counts, so equal keys meet once.
    """
    out = []
    for (a, b), rules in rule_pairs().items():
        if pairs is not None and (a, b) not in pairs:
            continue
        said = " ".join(str(x) for r in rules for f in r.findings() for x in (f.when, f.severity, f.text))
        sides = []
        for slot, n in ((a, "na"), (b, "nb")):
            read = sorted({"spec_source"} | set(re.findall(rf"p_{slot}\['(\w+)'\]", said)))
            parts = catalog.where(F.col("slot") == slot)
            if "vendors" in read:
                parts = parts.join(part_offers(listings).select("part_id", "vendors"), "part_id", "left")
            sides.append(parts.groupBy(*read).agg(F.count("*").alias(n)).select(n, F.struct(*read).alias(f"p_{slot}")))
        kind = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in catalog.schema if f.name in PART_FIELDS) + ",n_offers:bigint,vendors:array<bigint>>"
        met = sides[0].crossJoin(sides[1]).select("*", *[F.lit(None).cast(kind).alias(f"p_{s}") for s in SLOTS if s not in (a, b)])
        def seen(found: Column) -> Column:
            """The worst finding: 3 error, 2 warning, 1 can't confirm; and whether any was an error at first."""
            one = lambda f: F.when(f["severity"] == "error", 3).when(f["severity"] == "warning", F.when(f["message"].rlike(UNSURE), 1).otherwise(2)).otherwise(0)
            start = F.struct(F.lit(0).alias("rank"), F.lit(False).alias("raw"))
            return F.aggregate(found, start, lambda t, f: F.struct(F.greatest(t["rank"], one(f)).alias("rank"), (t["raw"] | (f["raw_severity"] == "error")).alias("raw")))

        # Equal outcomes of all rules are counted together before they are listed by rule.
        kinds = met.groupBy(F.array(*[seen(evaluate.findings_of(r)) for r in rules]).alias("each")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
        whole = F.struct(F.lit(None).cast("string").alias("rule_key"), F.array_max("each.rank").alias("rank"), F.exists("each.raw", lambda r: r).alias("raw_error"))
        of = [F.struct(F.lit(r.key).alias("rule_key"), F.col("each")[k]["rank"].alias("rank"), F.col("each")[k]["raw"].alias("raw_error")) for k, r in enumerate(rules)]
        name = F.element_at(F.array(*map(F.lit, ("ok", "cant-confirm", "warning", "error"))), F.col("o.rank") + 1)
        rows = kinds.select("n", F.explode(F.array(whole, *of)).alias("o")).groupBy("o").agg(F.sum("n").alias("pairs"))
        # A pair has some dozens of outcomes; one plan of all pairs would take the driver much more than they do.
        out += map(tuple, rows.select(F.lit(a).alias("slot_a"), F.lit(b).alias("slot_b"), "o.rule_key", name.alias("outcome"), "o.raw_error", "pairs").collect())
    return catalog.sparkSession.createDataFrame(out, "slot_a string, slot_b string, rule_key string, outcome string, raw_error boolean, pairs long")
