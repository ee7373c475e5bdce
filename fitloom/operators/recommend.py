"""Recommendation: ranked pools, parallel walks through them, greedy first builds, assembly plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fitloom.operators import evaluate
from fitloom.operators.rules import has, is_, part, platform
from fitloom.plans.mapping import PART_FIELDS, SLOTS

CORE = ("movement", "case", "dial", "hands", "bezelInsert")
#: Places of the ranked pools that a walk looks at, and suggestions for each wish.
DEPTH, WANTED = 14, 3
#: The steps of a first build, in order; the insert falls away on a case whose bezel is fixed.
STEPS = ("case", "bezelInsert", "dial", "movement", "hands", "strap")


def pools(catalog: DataFrame, prices: DataFrame, wishes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(wish_id, slot, place, part_id, price_minor, matched): the best parts of each core slot for each wish.

    Parts that carry the wished brand come first, then the cheaper, then the
    smaller key.  For each wish and slot the window keeps `depth` rows; the parts that miss the
    wish are ranked once for all wishes.
    """
    priced = catalog.where(F.col("slot").isin(*CORE)).join(prices, "part_id").select("slot", "part_id", "brand", "price_minor")
    cut = lambda df, keys: df.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("price_minor", "part_id"))).where(F.col("r") <= depth).drop("r")
    hit = cut(priced.join(wishes, "brand"), ["wish_id", "slot"]).select("wish_id", "slot", "part_id", "price_minor", F.lit(1).alias("matched"))
    # A wish has `depth` of its own at most among the first, so that many others of each brand reach.
    rest = cut(priced, ["slot", "brand"]).join(wishes.select("wish_id", F.col("brand").alias("own")), F.col("brand") != F.col("own")).select("wish_id", "slot", "part_id", "price_minor", F.lit(0).alias("matched"))
    order = W.partitionBy("wish_id", "slot").orderBy(F.desc("matched"), "price_minor", "part_id")
    return hit.unionByName(rest).withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < depth)


def walk(ranked: DataFrame, wishes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(wish_id, depth, slot, part_id, price_minor, matched): the n-th best of each slot together, for each n.

    A pool that has run out gives its last part; of equal tuples only the shallowest stays, and
    those above the wish's budget go.
    """
    size = ranked.groupBy("wish_id", "slot").agg(F.max("place").alias("last"))
    steps = size.select("wish_id", "slot", "last", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("depth")).withColumn("place", F.least("depth", "last"))
    chosen = steps.join(ranked, ["wish_id", "slot", "place"]).select("wish_id", "depth", "slot", "part_id", "price_minor", "matched")
    tuples = chosen.groupBy("wish_id", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "part_id"))), lambda s: s["part_id"].cast("string")), "|").alias("key"), F.sum("price_minor").alias("total"), F.count("*").alias("n"))
    first = tuples.where("n >= 3").groupBy("wish_id", "key").agg(F.min("depth").alias("depth"), F.max("total").alias("total"))
    good = first.join(wishes.select("wish_id", "budget_minor"), "wish_id").where("budget_minor is null or total <= budget_minor").select("wish_id", "depth", "total")
    return chosen.join(good, ["wish_id", "depth"])


def picker(candidates: DataFrame, keep: Column, limit: int = 6) -> DataFrame:
    """First `limit` candidates of each build that meet `keep`: by score, fewest warnings, price, then key."""
    order = W.partitionBy("build_id").orderBy(F.desc("score"), "n_warning", "price_minor", "part_id")
    return candidates.where(keep).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def greedy_first_build(catalog: DataFrame, prices: DataFrame, styles: DataFrame, steps: tuple[str, ...] = ("movement", "case", "dial", "hands", "bezelInsert")) -> DataFrame:
    """(style_id, step, slot, part_id, price_minor): one part after another, each fitting those before it.

    After the case is chosen, parts tied to a case platform must be of its own.  A style stops at
    the first step that has no part.  All styles take a step in one job.
    """
    state = styles.select("style_id", "brand", F.lit(None).cast("string").alias("platform"), F.lit(True).alias("going"))
    out = None
    priced = catalog.join(prices, "part_id").select("slot", "part_id", F.col("brand").alias("part_brand"), F.col("platform").alias("part_platform"), "price_minor")
    for n, slot in enumerate(steps, 1):
        # For a step only the cheapest part of each brand and platform can win.
        pool = priced.where((F.col("slot") == slot) & ((slot != "case") | (F.col("part_platform") != ""))).groupBy("part_brand", "part_platform").agg(F.min(F.struct("price_minor", "part_id")).alias("p"))
        fits = F.lit(True) if slot not in ("bezelInsert", "crystal", "bezel", "crown") else F.col("part_platform") == F.col("platform")
        met = state.where("going").withColumn("one", F.lit(1)).join(pool.withColumn("one", F.lit(1)), "one").where(fits)
        best = met.groupBy("style_id").agg(F.min(F.struct((F.col("part_brand") != F.col("brand")).alias("other"), F.col("p.price_minor").alias("price_minor"), F.col("p.part_id").alias("part_id"), "part_platform")).alias("b"))
        took = best.select("style_id", F.lit(n).alias("step"), F.lit(slot).alias("slot"), "b.part_id", "b.price_minor")
        out = took if out is None else out.unionByName(took)
        state = state.join(best, "style_id", "left").select("style_id", "brand", F.coalesce("platform", F.when(F.lit(slot == "case"), F.col("b.part_platform"))).alias("platform"), (F.col("going") & F.col("b").isNotNull()).alias("going"))
    return out


def eligible(slot: str) -> Column:
    """Whether a part, the struct p_<slot>, is one that a first build may be offered."""
    name = part(slot, "name")
    other = is_(part(slot, "gmt"), True) | is_(part(slot, "has_subdials"), True) | name.rlike(r"(?i)\bgmt\b|\bnh34\b|\bchrono|\bvk\d*\b")
    if slot == "case":
        component = name.rlike("(?i)caseback|case back|gasket|tube|bezel|insert|ring|spacer") & ~F.regexp_replace(name, r"(?i)\(with case ?back\)", "").rlike(r"(?i)\bcase\b(?!\s*back)")
        return ~component & ~is_(part(slot, "requires_ring"), True)
    if slot == "hands":
        return ~(name.rlike(r"(?i)\bcap\b") | (name.rlike(r"(?i)\b(seconds?|gmt) hand\b(?!s)") & ~name.contains("+"))) & ~other
    if slot == "dial":
        return ~other
    if slot == "movement":
        return part(slot, "caliber").isin("NH35", "NH36") & part(slot, "crown_position").isNull()
    return F.lit(True)


def first_build_options(catalog: DataFrame, listings: DataFrame, exceptions: DataFrame, styles: DataFrame, limit: int = 6) -> DataFrame:
    """(style_id, step, slot, rank, part_id, n_warning, price_minor): options of each step, of which rank 1 is taken.

    Every eligible part in stock is tried with the build so far under all rules, and those
    with an error drop out.  Options are ordered by score (10 for a bracelet of the case's
    platform, 1 for the style's brand), warnings, lowest price in stock and key.  A style stops at the
    first step without an option.  Parts that no rule and no score tells apart are cut to the `limit`
    cheapest before they are tried.  The driver holds the options of the styles, and no more.
    """
    spark = catalog.sparkSession
    stock = listings.where("in_stock").groupBy("part_id").agg(F.min("price_minor").alias("price_minor"))
    alone = catalog.where(F.col("slot").isin(*STEPS)).select(F.col("part_id").alias("build_id"), "slot", "part_id")
    single = evaluate.wide_builds(alone, catalog, listings, exceptions).withColumnRenamed("build_id", "part_id")
    # Six steps read it; kept until the last, it makes their plans small as well.
    priced = single.join(stock, "part_id").join(catalog.select("part_id", F.col("brand").alias("part_brand")), "part_id").persist()
    fields = [f for f in PART_FIELDS if f not in ("part_id", "name")] + ["own_exceptions"]
    kind = single.schema["p_case"].dataType.simpleString()
    schema = "style_id int, brand string, " + ", ".join(f"p_{s} {kind}" for s in SLOTS)
    builds = {r.style_id: (r.brand, {}) for r in styles.select("style_id", "brand").collect()}
    going, out = set(builds), []
    for step, slot in enumerate(STEPS, 1):
        open_ = [i for i in sorted(going) if slot != "bezelInsert" or builds[i][1]["case"].integrated_bezel is not True]
        if not open_:
            continue
        state = spark.createDataFrame([(i, builds[i][0], *[builds[i][1].get(s) for s in SLOTS]) for i in open_], schema).drop(f"p_{slot}")
        # Only the sellers of the case count for a rule that warns or blocks.
        told = [part(slot, f) for f in fields + ["vendors"] * (slot == "case")]
        cheap = W.partitionBy("part_brand", *told).orderBy("price_minor", "part_id")
        pool = priced.where(has(slot) & F.coalesce(eligible(slot), F.lit(False))).select(f"p_{slot}", "part_id", "part_brand", "price_minor")
        pool = pool.withColumn("turn", F.row_number().over(cheap)).where(F.col("turn") <= limit).drop("turn")
        tried = evaluate.counted(pool.crossJoin(F.broadcast(state))).where("n_error = 0")
        score = F.when(F.col("part_brand") == F.col("brand"), 1).otherwise(0)
        if slot == "strap":
            score = score + F.when((part("strap", "family") != "generic-strap") & (platform(part("strap", "family")) == platform(part("case", "family"))), 10).otherwise(0)
        best = picker(tried.select(F.col("style_id").alias("build_id"), "part_id", score.alias("score"), "n_warning", "price_minor", f"p_{slot}"), F.lit(True), limit).collect()
        going = (going - set(open_)) | {r.build_id for r in best}
        for r in best:
            out.append((r.build_id, step, slot, r["rank"], r.part_id, r.n_warning, r.price_minor))
            if r["rank"] == 1:
                builds[r.build_id][1][slot] = r[f"p_{slot}"]
    priced.unpersist()
    return spark.createDataFrame(out, "style_id int, step int, slot string, rank int, part_id long, n_warning long, price_minor long")


def assembly_plan(wide: DataFrame) -> DataFrame:
    """(build_id, n_steps, steps, difficulty): what to do in order; each hard step adds to the difficulty, up to 5."""
    step = lambda cond, name, hard: F.when(cond, F.struct(F.lit(name).alias("name"), F.lit(hard).alias("hard")))
    steps = F.array_compact(F.array(
        step(F.lit(True), "prepare", 0), step(has("crystal"), "press-crystal", 1), step(has("bezelInsert"), "seat-insert", 0), step(has("dial", "movement"), "fit-dial", 0), step(has("dial") & is_(part("dial", "has_feet"), False), "stick-dial", 1),
        step(has("hands"), "press-hands", 1), step(has("movement", "case"), "case-movement", 0), step(has("crown"), "cut-stem", 1), step(has("strap"), "fit-strap", 0), step(F.lit(True), "test", 0),
    ))
    return wide.select("build_id", steps.alias("s")).select("build_id", F.size("s").cast("long").alias("n_steps"), F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("steps"), F.least(F.lit(5), 1 + F.aggregate("s", F.lit(0), lambda acc, x: acc + x["hard"])).cast("long").alias("difficulty"))
