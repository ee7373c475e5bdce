"""Vendors' product feeds sorted into slots and families by a table of rules.

A rule is a row: vendor, branch, step, what must hold, and the outcome.  A vendor's
rules are tried in order; the first that holds decides, so a row is explained by
one rule.  Rules read lower-case type, title and tags (pt, ti, tg), the case
model that all three name (model), and why they are out of scope (brand: goods of other makes;
shaped: also other case models).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions import listing

SURE, LIKELY, STATED, GUESS, WEAK = ("high", "vendor-stated"), ("medium", "family-inferred"), ("medium", "vendor-stated"), ("low", "manual"), ("low", "family-inferred")


def tag(when: str, category: str, family: str, trust: tuple[str, str], attributes: str | None = None) -> tuple:
    return when, "tagged", category, family, *trust, attributes


def refuse(reason: str, when: str = "true") -> tuple:
    return when, "rejected", None, reason, None, None, None


def out(kind: str) -> tuple:
    """Rejected for what the scope words say."""
    return f"{kind} IS NOT NULL", "rejected", None, f"{{{kind}}}", None, None, None


LEAVE, DROP = ("true", "unmatched", None, None, None, None, None), ("true", None, None, None, None, None, None)


def by_model(category: str, suffix: str) -> list[tuple]:
    """Parts shaped to a case: of the model they name, else out of scope, else refused."""
    return [tag("model IS NOT NULL", category, f"{{model}}-{suffix}", SURE), out("shaped"), refuse("no case model")]


def has(field: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({field}, '{w}')" for w in words) + ")"


# Branches of each vendor in order, each with its steps in order.
BRANCHES: dict[str, list[tuple[str, list[tuple]]]] = {
    "namoki": [
        ("pt IN ('tools', 'gift cards')", [refuse("not a part")]),
        ("pt = 'modded watches'", [refuse("whole product")]),
        ("pt = 'skx007 cases'", [tag("true", "case", "skx007-case", SURE)]),
        ("pt = 'skx013 cases'", [tag("true", "case", "skx013-case", SURE)]),
        ("pt = 'srpe cases'", [tag("true", "case", "srpe-case", SURE)]),
        ("pt = 'vk cases'", [tag("true", "case", "vk6x-case", SURE)]),
        ("pt = 'nmk cases' AND contains(ti, 'n4 tool case')", [tag("true", "case", "nmk-n4-case", SURE)]),
        ("pt = 'srp turtle cases' OR (contains(ti, 'srp turtle') AND contains(ti, 'case'))", [tag("true", "case", "srp-turtle-case", SURE)]),
        ("pt = 'casebacks'", [tag(has("ti", "skx013"), "case", "skx013-case", LIKELY), tag("true", "case", "skx007-case", LIKELY)]),
        ("pt = 'seiko dials' OR (pt = '' AND startswith(ti, 'watch dial:'))", [tag(has("ti", "spork", "556 white"), "dial", "nh3x-dial-standard", SURE, "hasFeet"), tag("true", "dial", "nh3x-dial-standard", LIKELY)]),
        ("pt = 'seiko vk dials'", [tag("true", "dial", "vk6x-dial", SURE)]),
        ("pt = 'seiko hands'", [tag("true", "hands", "nh3x-hands-standard", LIKELY)]),
        ("pt = 'seiko vk hands'", [tag("true", "hands", "vk6x-hands", SURE)]),
        ("pt IN ('bezel inserts', 'skx013 bezel inserts')", [tag(has("ti", "skx013"), "bezel_insert", "skx013-insert", SURE), tag(has("ti", "skx007", "srpd"), "bezel_insert", "skx007-insert", SURE), DROP]),
        ("pt = 'srp turtle bezel inserts'", [tag("true", "bezel_insert", "srp-turtle-insert", SURE)]),
        ("contains(pt, 'chapter ring')", by_model("chapter_ring", "chapter-ring")),
        ("contains(pt, 'sapphire crystal')", [out("shaped"), tag("model IS NOT NULL", "crystal", "{model}-crystal", SURE), tag("pt = 'sapphire crystals'", "crystal", "skx007-crystal", LIKELY), refuse("no case model")]),
        ("pt IN ('movement spare parts', 'rotors', 'bridges', 'seiko movements', 'movement accessories')", [
            tag(has("ti", "vk6", "mecaquartz"), "movement", "vk6x-movement", SURE), tag("spare AND (contains(ti, 'nh') OR contains(pt, 'movement'))", "movement", "nh3x-movement-accessory", SURE),
            tag(has("ti", "nh35", "nh36", "nh34", "nh38", "nh "), "movement", "nh3x-movement", SURE), out("brand"), refuse("no caliber"),
        ]),
        ("endswith(pt, 'bezels')", by_model("bezel", "bezel")),
        ("endswith(pt, 'crowns')", by_model("crown", "crown")),
        ("endswith(pt, 'bracelets')", by_model("strap", "bracelet")),
        (has("pt", "strap", "nato"), [tag("true", "strap", "generic-strap", LIKELY)]),
        ("true", [out("brand"), LEAVE]),
    ],
    "lucius": [
        ("pt IN ('watch tools', 'gift card', 'service')", [refuse("not a part")]),
        ("pt = 'watches'", [refuse("whole product")]),
        ("pt = 'cases'", [tag("thin", "case", "lucius-ultra-thin-case", SURE), tag(has("tg", "fits-skx013"), "case", "skx013-case", LIKELY), out("shaped"), LEAVE]),
        ("pt = 'casebacks'", [tag("true", "case", "skx007-case", LIKELY)]),
        ("pt = 'dials'", [tag(has("tg", "gmt - nh34"), "dial", "nh34-gmt-dial", SURE), tag(has("tg", "fits-skx013", "skx007"), "dial", "nh3x-dial-standard", LIKELY), out("brand"), LEAVE]),
        ("pt = 'hands'", [tag("contains(tg, 'gmt') AND contains(tg, 'nh34')", "hands", "nh3x-hands-standard", SURE, "gmt"), tag(has("tg", "fits-nh34", "fits-nh35", "fits-nh36"), "hands", "nh3x-hands-standard", SURE), out("brand"), LEAVE]),
        ("pt = 'bezel inserts'", [tag("thin", "bezel_insert", "skx013-insert", GUESS), tag(has("tg", "fits-skx013"), "bezel_insert", "skx013-insert", SURE), tag(has("tg", "skx007"), "bezel_insert", "skx007-insert", SURE), out("shaped"), LEAVE]),
        ("pt = 'crystals'", [tag("contains(tg, 'fits-skx013') AND NOT thin", "crystal", "skx013-crystal", SURE), tag(has("tg", "skx007"), "crystal", "skx007-crystal", SURE), out("shaped"), LEAVE]),
        ("pt = 'chapter rings'", [
            tag("thin", "chapter_ring", "lucius-ultra-thin-chapter-ring", LIKELY), tag(has("tg", "fits-skx013"), "chapter_ring", "skx013-chapter-ring", SURE), tag(has("tg", "skx007"), "chapter_ring", "skx007-chapter-ring", SURE), out("shaped"), LEAVE,
        ]),
        ("pt = 'movements'", [tag("true", "movement", "nh3x-movement", SURE)]),
        ("pt IN ('rotors', 'bridges')", [tag(has("tg", "fits-nh34", "fits-nh35", "fits-nh36"), "movement", "nh3x-movement-accessory", SURE), out("brand"), DROP]),
        ("pt = 'bezels'", [tag("thin", "bezel", "skx013-bezel", GUESS), tag(has("tg", "fits-skx013"), "bezel", "skx013-bezel", SURE), tag("model IS NOT NULL", "bezel", "{model}-bezel", SURE), out("shaped"), LEAVE]),
        ("pt = 'crowns'", [tag(has("tg", "fits-skx013"), "crown", "skx013-crown", SURE), tag("model IS NOT NULL", "crown", "{model}-crown", SURE), out("shaped"), LEAVE]),
        ("pt = 'bracelets'", [
            refuse("other maker's case", "thin"), tag(has("tg", "fits-skx013"), "strap", "skx013-bracelet", SURE), tag("model IS NOT NULL", "strap", "{model}-bracelet", SURE),
            tag(r"ti RLIKE r'^(oyster|settimo|president|jubilee|gs|super engineer|beads of rice|milanese) bracelet \d+/\d+mm'", "strap", "skx013-bracelet", STATED), out("shaped"), LEAVE,
        ]),
        ("pt = 'straps'", [tag("true", "strap", "generic-strap", LIKELY)]),
        ("true", [out("brand"), LEAVE]),
    ],
    "dlw": [
        ("pt = 'watch tools'", [refuse("not a part")]),
        ("pt = 'cases'", [tag(has("tg", "srpe"), "case", "srpe-case", SURE), tag(has("tg", "skx007", "srpd"), "case", "skx007-case", SURE), out("shaped"), LEAVE]),
        ("contains(ti, 'movement') AND " + has("ti", "nh34", "nh35", "nh36"), [tag("true", "movement", "nh3x-movement", SURE)]),
        ("pt = 'dials'", [out("brand"), tag("true", "dial", "nh3x-dial-standard", LIKELY)]),
        ("pt = 'hands'", [out("brand"), tag("true", "hands", "nh3x-hands-standard", LIKELY)]),
        ("pt = 'ceramic bezel inserts' OR startswith(ti, 'ceramic insert') OR startswith(ti, 'sapphire insert') OR startswith(ti, 'steel insert')", [
            tag("contains(tg, 'srp turtle') OR contains(ti, 'turtle')", "bezel_insert", "srp-turtle-insert", SURE), tag(has("tg", "skx007", "srpd"), "bezel_insert", "skx007-insert", SURE), out("shaped"), LEAVE,
        ]),
        ("pt = 'crystals'", [
            tag(has("tg", "srpe"), "crystal", "srpe-crystal", SURE), tag("contains(tg, 'srp turtle') OR contains(ti, 'turtle')", "crystal", "srp-turtle-crystal", SURE), tag(has("tg", "skx013"), "crystal", "skx013-crystal", SURE),
            tag(has("tg", "skx007", "srpd"), "crystal", "skx007-crystal", SURE), out("shaped"), refuse("no case model"),
        ]),
        ("pt = 'chapter rings'", [
            tag(has("tg", "srpe"), "chapter_ring", "srpe-chapter-ring", SURE), tag(has("ti", "turtle"), "chapter_ring", "srp-turtle-chapter-ring", SURE), tag(has("tg", "skx007", "srpd"), "chapter_ring", "skx007-chapter-ring", SURE),
            tag(has("tg", "skx013"), "chapter_ring", "skx013-chapter-ring", SURE), out("shaped"), refuse("no case model"),
        ]),
        ("pt = 'bezels'", by_model("bezel", "bezel")),
        ("pt = 'crowns'", by_model("crown", "crown")),
        ("pt = 'straps'", [tag("model IS NOT NULL", "strap", "{model}-bracelet", LIKELY), tag("true", "strap", "generic-strap", LIKELY)]),
        ("startswith(ti, 'yard sale')", [refuse("design left open")]),
        ("ti = 'springbar tool'", [refuse("not a part")]),
        ("startswith(ti, '7s26 movement')", [refuse("other movement line")]),
        ("startswith(ti, 'dial - handcrafted series')", [out("brand"), tag("true", "dial", "nh3x-dial-standard", LIKELY)]),
        ("startswith(ti, 'hands - handcrafted series')", [out("brand"), tag("true", "hands", "nh3x-hands-standard", LIKELY)]),
        ("startswith(ti, 'chapter ring') AND contains(ti, 'handcrafted series')", [tag(has("ti", "skx007", "srpd"), "chapter_ring", "skx007-chapter-ring", SURE), out("shaped"), refuse("no case model")]),
        ("true", [out("brand"), LEAVE]),
    ],
    "watchandstyle": [
        (has("ti", "snxs", "ssk023") + " AND shaped IS NOT NULL", [out("shaped")]),
        ("pt = 'case back'", [refuse("a service", has("ti", "service", "engraving")), tag(has("ti", "skx007"), "case", "skx007-case", SURE), out("shaped"), refuse("no case model")]),
        ("pt = 'tools'", [refuse("not a part")]),
        ("contains(ti, 'alpinist') AND contains(pt, 'case')", [tag("true", "case", "alpinist-style-case", SURE)]),
        ("contains(pt, 'skx007/srpd') AND contains(pt, 'case')", [tag("true", "case", "skx007-case", SURE)]),
        ("contains(ti, 'skx013') AND contains(pt, 'case')", [tag("true", "case", "skx013-case", SURE)]),
        ("contains(pt, 'srpe') AND contains(pt, 'case')", [tag("true", "case", "srpe-case", SURE)]),
        ("contains(pt, 'replacement case')", [out("shaped"), refuse("no case model")]),
        ("pt = 'dial'", [out("brand"), tag("true", "dial", "nh3x-dial-standard", WEAK)]),
        ("pt = 'hands'", [out("brand"), tag("true", "hands", "nh3x-hands-standard", WEAK)]),
        ("contains(pt, 'insert') AND NOT contains(pt, 'gasket')", by_model("bezel_insert", "insert")),
        ("contains(pt, 'snzf') AND contains(pt, 'chapter ring')", [out("shaped"), DROP]),
        ("contains(pt, 'skx013') AND contains(pt, 'chapter ring')", [tag("true", "chapter_ring", "skx013-chapter-ring", SURE)]),
        ("contains(pt, 'skx007/srpd') AND contains(pt, 'chapter ring')", [tag(has("ti", "ssk"), "chapter_ring", "ssk-gmt-chapter-ring", LIKELY), tag("true", "chapter_ring", "skx007-chapter-ring", SURE)]),
        ("contains(pt, 'srpe') AND contains(pt, 'chapter ring')", [tag("true", "chapter_ring", "srpe-chapter-ring", SURE)]),
        ("contains(pt, 'sapphire crystal') OR contains(ti, 'srp turtle')", [
            tag("contains(ti, 'srp turtle') OR (contains(ti, 'turtle') AND contains(pt, 'sapphire'))", "crystal", "srp-turtle-crystal", SURE), tag("model IS NOT NULL", "crystal", "{model}-crystal", SURE), out("shaped"), refuse("no case model"),
        ]),
        ("contains(pt, 'nh movement') OR pt = 'daywheel'", [out("brand"), tag("spare OR pt = 'daywheel'", "movement", "nh3x-movement-accessory", SURE), tag("true", "movement", "nh3x-movement", SURE)]),
        ("contains(pt, 'bezel') AND NOT contains(pt, 'insert') AND NOT contains(pt, 'gasket')", by_model("bezel", "bezel")),
        ("contains(pt, 'crown')", by_model("crown", "crown")),
        ("contains(pt, 'bracelet')", by_model("strap", "bracelet")),
        (has("pt", "strap", "nato", "rubber"), [tag("true", "strap", "generic-strap", LIKELY)]),
        ("true", [out("brand"), LEAVE]),
    ],
}
#: A tagged case that is a case's back fills no slot.
BACK = "caseback"
COLUMNS = "rule string, vendor string, priority int, holds string, outcome string, category string, says string, confidence string, spec_source string, attributes string"


def rules() -> list[tuple]:
    """The table's rows: a rule is named by its vendor, branch and step; priority is its place among the vendor's."""
    rows = []
    for vendor, branches in BRANCHES.items():
        steps = [(f"{vendor}-{b}.{s}", f"({branch}) AND ({when})", *rest) for b, (branch, inner) in enumerate(branches, 1) for s, (when, *rest) in enumerate(inner, 1)]
        rows += [(name, vendor, place, holds, *rest) for place, (name, holds, *rest) in enumerate(steps, 1)]
    return rows


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), COLUMNS)


def classify(products: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """products (vendor, title, product_type, tags and others) with rule, outcome, category, family, confidence, spec_source, reason and attributes.

    table: rules as of rules_table, a vendor's own among them; the driver reads it (some hundred rows,
    whatever the feed) and makes one expression of each vendor's predicates, so that a row is decided
    where it is read: no product is shuffled or multiplied by rules.  outcome is null
    where a branch takes a row and says nothing of it; a vendor without rules
    is unmatched with no rule; nulls count as empty texts.
    """
    spark = products.sparkSession
    table = rules_table(spark) if table is None else table
    known = table.orderBy("vendor", "priority").collect()
    empty = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    facts = products.select("*", F.struct(empty("product_type").alias("pt"), empty("title").alias("ti"), empty("tags").alias("tg")).alias("_low")).select("*", "_low.*").drop("_low")
    words = F.concat_ws(" ", "ti", "pt", "tg")
    facts = facts.select(
        "*", listing.case_model(words).alias("model"), listing.out_of_scope(words, F.lit("dial")).alias("brand"), listing.out_of_scope(words, F.lit("case")).alias("shaped"),
        listing.is_spare(F.col("ti")).alias("spare"), (F.contains("tg", F.lit("ultra-thin")) | F.contains("ti", F.lit("ultra thin"))).alias("thin"),
    )
    of = {v: [r for r in known if r.vendor == v] for v in {r.vendor for r in known}}
    first = F.lit(None).cast("string")
    for vendor, mine in sorted(of.items()):
        first = F.when(F.col("vendor") == vendor, F.coalesce(*[F.when(F.expr(r.holds), F.lit(r.rule)) for r in mine])).otherwise(first)
    told = facts.withColumn("rule", first).join(F.broadcast(table.drop("vendor", "priority", "holds")), "rule", "left")
    said = F.col("says")
    for name in ("model", "brand", "shaped"):
        said = F.replace(said, F.lit(f"{{{name}}}"), F.coalesce(name, F.lit("")))
    tagged, back = F.col("outcome") == "tagged", (F.col("outcome") == "tagged") & (F.col("category") == "case") & listing.is_caseback(F.coalesce("title", F.lit("")))
    only = lambda c: F.when(tagged & ~back, c)
    return told.select(
        *[F.col(c) for c in products.columns], "rule", F.when(back, "rejected").when(F.col("rule").isNull(), "unmatched").otherwise(F.col("outcome")).alias("outcome"), only(F.col("category")).alias("category"), only(said).alias("family"),
        only(F.col("confidence")).alias("confidence"), only(F.col("spec_source")).alias("spec_source"), F.when(back, BACK).when(F.col("outcome") == "rejected", said).alias("reason"), only(F.col("attributes")).alias("attributes"),
    )
