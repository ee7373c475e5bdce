"""Evaluation of builds: wide rows, findings, evidence tiers, status, additions and tools."""

from __future__ import annotations

import operator
import re
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom.operators.offers import part_offers
from fitloom.operators.rules import RULES, VERIFIED, Rule, has, is_, part, platform
from fitloom.plans.mapping import PART_FIELDS, SLOTS

CHECKED = " (A warning only: no real mismatch has confirmed this check yet.)"
UNCONFIRMED = " (A warning only: it rests on figures that the vendor did not publish for this part.)"

# Tools, and the lowest and highest price of each in whole pounds.
TOOLS = {
    "blower": (3, 10), "gloves": (3, 8), "dust-cover": (5, 15), "dial-feet-cutter": (8, 20), "dial-dots": (3, 8), "hand-press": (10, 30),
    "hand-removal-levers": (5, 15), "case-back-opener": (8, 25), "movement-holder": (5, 15), "spring-bar-tool": (3, 10), "bezel-insert-tool": (5, 12), "crystal-press": (15, 40),
}


#: What offers add to a part.
OFFER_FIELDS = ("n_offers", "cheapest_vendor", "cheapest_in_stock", "any_in_stock", "vendors")


def fields_read(rules: tuple[Rule, ...] = RULES) -> dict[str, tuple[str, ...]]:
    """The fields of each slot that the rules read, and where a finding names the slot the source of its figures."""
    found: dict[str, set[str]] = {}
    for rule in rules:
        for f in rule.findings():
            for s, name in re.findall(r"\bp_([A-Za-z]+)(?:\['?(\w+)'?\])?", " ".join(map(str, (f.when, f.severity, f.text)))):
                found.setdefault(s, set()).update({name} if name else ())
            for s in f.slots:
                found.setdefault(s, set())
        if rule.key == "family-exception":
            for s in SLOTS:
                found.setdefault(s, set()).add("own_exceptions")
    return {s: tuple(sorted(found[s] | {"spec_source"})) for s in SLOTS if s in found}


def wide_builds(slots: DataFrame, catalog: DataFrame, listings: DataFrame, exceptions: DataFrame | None = None, read: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row a build: a struct p_<slot> for each slot with the part, its offers and exceptions.

    Parts meet their offers once, before they meet the builds; the builds'
    rows are then gathered by one aggregate on build_id.  A part that the catalog
    does not know leaves its slot empty, and so does a part of another slot.
    read: the fields of each slot that are wanted (all, if not given); a row carries its own
    slot's alone through the shuffle, other slots are null, builds with none of them left out, and offers worked out only if wanted;
    of a part's vendors those that some part of the catalog keeps to (vendor_scope) are named, and the least one.
    """
    named = None
    if read and "vendors" in {f for fields in read.values() for f in fields}:
        listings = listings.withColumn("named", F.array_contains(catalog.agg(F.collect_set("vendor_scope")).scalar(), F.col("vendor_id")))
        named = F.col("named")
    read = read or {s: (*PART_FIELDS, *OFFER_FIELDS, "own_exceptions") for s in SLOTS}
    wanted = {f for fields in read.values() for f in fields}
    some = (lambda df: df) if len(read) == len(SLOTS) else (lambda df: df.where(F.col("slot").isin(*read)))
    parts = some(catalog.select("slot", *[f for f in PART_FIELDS if f in wanted | {"part_id"}]))
    if wanted & set(OFFER_FIELDS):
        offers = part_offers(listings, named).select("part_id", "n_offers", F.col("cheapest.vendor_id").alias("cheapest_vendor"), F.col("cheapest.in_stock").alias("cheapest_in_stock"), "any_in_stock", "vendors")
        parts = parts.join(offers.select("part_id", *[f for f in OFFER_FIELDS if f in wanted]), "part_id", "left")
    if "own_exceptions" in wanted and exceptions is not None:
        own = exceptions.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct("rule_key", "severity"))).alias("own_exceptions"))
        parts = parts.join(own, "part_id", "left")
    elif "own_exceptions" in wanted:
        parts = parts.withColumn("own_exceptions", F.lit(None).cast("array<struct<rule_key:string,severity:string>>"))
    own_fields = [F.when(F.col("slot") == s, F.struct(*fields)).alias(f"p_{s}") for s, fields in read.items()]
    joined = some(slots).join(parts.select("part_id", "slot", *own_fields), ["part_id", "slot"], "left")
    if all(isinstance(parts.schema[f].dataType, (T.LongType, T.BooleanType, T.DoubleType)) for f in wanted):
        # Fields of fixed width, one part a slot: builds are gathered by hash, and nothing is sorted.
        flat = joined.select("build_id", *[F.col(f"p_{s}").isNotNull().alias(f"is_{s}") for s in read], *[F.col(f"p_{s}")[f].alias(f"{s}_{f}") for s, fields in read.items() for f in fields])
        wide = flat.repartition("build_id").groupBy("build_id").agg(*[F.max(c).alias(c) for c in flat.columns[1:]])
        wide = wide.select("build_id", *[F.when(F.col(f"is_{s}"), F.struct(*[F.col(f"{s}_{f}").alias(f) for f in fields])).alias(f"p_{s}") for s, fields in read.items()])
    else:
        # Dealt by build first: rows of structs can't be hashed, so a partial aggregate would only sort them once more.
        wide = joined.select("build_id", *[f"p_{s}" for s in read]).repartition("build_id").groupBy("build_id").agg(*[F.any_value(f"p_{s}", F.lit(True)).alias(f"p_{s}") for s in read])
    return wide.select("build_id", *[F.col(f"p_{s}") if s in read else F.lit(None).cast("struct<spec_source:string>").alias(f"p_{s}") for s in SLOTS])


def _source_is_weak(rule: Rule, slot: str) -> str:
    """SQL text: it is one call for Spark's parser and not a dozen columns."""
    sources = ["marketplace-stated", "user-entered", *(["family-inferred"] if slot in rule.family_decides else [])]
    return f"p_{slot}.spec_source in ({', '.join(repr(x) for x in sources)})"


def _tiered(rule: Rule, findings: Column) -> Column:
    """Findings with rule key, tier and the severity that the evidence allows."""

    weak = F.expr("array_compact(array(" + ", ".join(f"case when {_source_is_weak(rule, s)} then '{s}' end" for s in SLOTS) + "))")

    def one(f):
        outside = F.arrays_overlap(f["slots"], weak)
        tier = F.when(outside, "unconfirmed").otherwise("verified" if rule.key in VERIFIED else "checked")
        lowered = (f["severity"] == "error") & (tier != "verified")
        note = F.when(tier == "unconfirmed", UNCONFIRMED).otherwise(CHECKED)
        return F.struct(
            F.coalesce(f["own_key"], F.lit(rule.key)).alias("rule_key"), F.when(lowered, "warning").otherwise(f["severity"]).alias("severity"), f["severity"].alias("raw_severity"), tier.alias("tier"),
            f["slots"].alias("slots"), F.when(lowered, F.concat(f["message"], note)).otherwise(f["message"]).alias("message"), f["fix"].alias("fix"),
        )

    return F.transform(findings, one)


def _exceptions_of(slot: str) -> Column:
    own = F.coalesce(part(slot, "own_exceptions"), F.array().cast("array<struct<rule_key:string,severity:string>>"))

    def one(e):
        return F.struct(e["rule_key"].alias("own_key"), e["severity"].alias("severity"), F.array(F.lit(slot)).alias("slots"), F.concat(F.lit("Noted for this part: "), e["rule_key"]).alias("message"), F.lit(None).cast("string").alias("fix"))

    return F.transform(own, one)


def findings_of(rule: Rule) -> Column:
    raw = F.flatten(F.array(*map(_exceptions_of, SLOTS))) if rule.key == "family-exception" else F.array_compact(F.array(*[f.row() for f in rule.findings()]))
    return _tiered(rule, raw)


def findings(wide: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(build_id, rule_key, severity, raw_severity, tier, slots, message, fix): a row for each finding."""
    return wide.select("build_id", F.explode(_all_findings(rules, wide.sparkSession)).alias("f")).select("build_id", "f.*")


def status(found: DataFrame, wide: DataFrame) -> DataFrame:
    """(build_id, status, n_error, n_warning, n_info) of every build: blocked, warnings or ok."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    counts = found.groupBy("build_id").agg(count("error"), count("warning"), count("info"))
    out = wide.select("build_id").join(counts, "build_id", "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("n_error") > 0, "blocked").when(F.col("n_warning") > 0, "warnings").otherwise("ok"))


def _weak(rule: Rule, slots: list[str]) -> Column:
    """Whether a finding over these slots rests on figures that no vendor published."""
    return F.expr(" or ".join(f"coalesce({_source_is_weak(rule, s)}, false)" for s in slots) or "false")


def _kept(build):
    """build(rules), kept as long as its session lives: columns are objects of that session's JVM."""
    held: WeakKeyDictionary = WeakKeyDictionary()

    def get(rules: tuple[Rule, ...], session: SparkSession):
        own = held.setdefault(session, {})
        if rules not in own:
            own[rules] = build(rules)
        return own[rules]

    return get


@_kept
def _count_columns(rules: tuple[Rule, ...]) -> tuple[Column, ...]:
    """Counts of errors, warnings and notes; kept, since building them takes some thousand calls to the JVM."""
    counts = {"error": [], "warning": [], "info": []}
    yes = lambda c: F.when(c, 1).otherwise(0)
    for rule in rules:
        for f in rule.findings():
            firm = ~_weak(rule, f.slots) if rule.key in VERIFIED else F.lit(False)
            level = F.lit(f.severity) if isinstance(f.severity, str) else f.severity
            counts["error"].append(yes(f.when & (level == "error") & firm))
            counts["warning"].append(yes(f.when & ((level == "warning") | ((level == "error") & ~firm))))
            counts["info"].append(yes(f.when & (level == "info")))
        if rule.key == "family-exception":
            for s in SLOTS:
                of = lambda level, s=s: F.greatest(F.coalesce(F.size(F.filter(part(s, "own_exceptions"), lambda e: e["severity"] == level)), F.lit(0)), F.lit(0))
                firm = ~_weak(rule, [s])
                counts["error"].append(F.when(firm, of("error")).otherwise(0))
                counts["warning"].append(of("warning") + F.when(firm, 0).otherwise(of("error")))
                counts["info"].append(of("info"))
    return tuple(reduce(operator.add, terms).cast("long").alias(f"n_{level}") for level, terms in counts.items())


@_kept
def _all_findings(rules: tuple[Rule, ...]) -> Column:
    return F.flatten(F.array(*[findings_of(r) for r in rules]))


def evaluate(wide: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """As `status`, but in one pass over the wide rows: findings are counted by scalar expressions and nothing is shuffled."""
    out = wide.select("build_id", *_count_columns(rules, wide.sparkSession))
    return out.withColumn("status", F.when(F.col("n_error") > 0, "blocked").when(F.col("n_warning") > 0, "warnings").otherwise("ok"))


def counted(wide: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """wide with n_error, n_warning and n_info of each row."""
    return wide.select("*", *_count_columns(rules, wide.sparkSession))


def required_additions(wide: DataFrame) -> DataFrame:
    """(build_id, slot, family) that a build lacks, in one pass over the wide rows; a lowered severity does not cancel them."""
    need = reduce(operator.or_, [f.when for r in RULES if r.key == "requires-chapter-ring" for f in r.findings()])
    family = F.concat(platform(part("case", "family")), F.lit("-chapter-ring"))
    return wide.where(need).select("build_id", F.lit("chapterRing").alias("slot"), family.alias("family"))


def tools() -> Column:
    """The tools that a build asks for."""
    when = lambda cond, *names: [F.when(cond, F.lit(n)) for n in names]
    return F.array_compact(F.array(
        F.lit("blower"), F.lit("gloves"), F.lit("dust-cover"), *when(has("movement", "case"), "case-back-opener", "movement-holder"), *when(has("hands"), "hand-press", "hand-removal-levers"),
        *when(has("dial") & is_(part("dial", "has_feet"), False), "dial-dots"), *when(has("bezelInsert"), "bezel-insert-tool"), *when(has("strap"), "spring-bar-tool"), *when(has("crystal"), "crystal-press"),
    ))


def tool_costs(wide: DataFrame) -> DataFrame:
    """(build_id, n_tools, tools, low_minor, high_minor)."""
    price = lambda k: F.create_map(*[v for t, p in TOOLS.items() for v in (F.lit(t), F.lit(p[k] * 100))])
    total = lambda k: F.aggregate("_tools", F.lit(0).cast("long"), lambda acc, t: acc + price(k)[t])
    return wide.select("build_id", tools().alias("_tools")).select("build_id", F.size("_tools").cast("long").alias("n_tools"), F.array_join("_tools", ",").alias("tools"), total(0).alias("low_minor"), total(1).alias("high_minor"))
