"""Rule vectors: what each rule says of small builds, with true, false and unknown."""

import pytest
from pyspark.sql import functions as F

from fitloom.operators import evaluate
from fitloom.operators.rules import RULES
from fitloom.plans.mapping import PART_FIELDS

KIND = {"part_id": "long", "name": "string", "family": "string", "spec_source": "string", "diameter_mm": "double", "aperture_mm": "double", "caliber": "string", "date_cuts": "string", "date_position": "string", "crown_position": "string", "length_set_mm": "double", "lug_width_mm": "double", "profile": "string", "excluded_cases": "string", "vendor_scope": "long"}
NH35 = {"slot": "movement", "family": "nh3x-movement", "caliber": "NH35", "has_day": False, "has_date": True}
NH36, NH34 = NH35 | {"caliber": "NH36", "has_day": True}, NH35 | {"caliber": "NH34"}
VK = NH35 | {"family": "vk6x-movement", "caliber": None}
DIAL = {"slot": "dial", "family": "nh3x-dial", "has_feet": True, "diameter_mm": 28.5, "has_date_window": True, "has_day_window": False, "has_subdials": False}
CASE = {"slot": "case", "family": "skx007-case", "lug_width_mm": 22.0, "aperture_mm": 28.5, "crown_position": "3.8"}
STRAP, HANDS, RING = {"slot": "strap", "family": "generic-strap", "lug_width_mm": 20.0}, {"slot": "hands", "family": "nh3x-hands"}, {"slot": "chapterRing", "family": "skx007-chapter-ring"}
INSERT, CRYSTAL, CROWN, BEZEL = ({"slot": s, "family": f"skx007-{f}"} for s, f in (("bezelInsert", "insert"), ("crystal", "crystal"), ("crown", "crown"), ("bezel", "bezel")))


def dated(cuts, position, crown="3.8", sold=None):
    return [DIAL | {"date_cuts": cuts}, NH35 | {"date_position": position, "crown_position": sold}, CASE | {"crown_position": crown}]


VECTORS = [
    ("movement-case-fit", [NH35 | {"family": "nh3x-movement-accessory"}, CASE], ["error"]), ("movement-case-fit", [VK, CASE], []),
    ("dial-movement-feet", [DIAL | {"has_subdials": True}, NH35], ["error"]), ("dial-movement-feet", [DIAL, VK], ["warning"]), ("dial-movement-feet", [DIAL | {"has_feet": False}, NH35], ["warning"]), ("dial-movement-feet", [DIAL | {"has_feet": None, "has_subdials": None}, NH35], ["warning", "warning"]),
    ("dial-case-diameter", [DIAL | {"diameter_mm": 31.0}, CASE], ["error"]), ("dial-case-diameter", [DIAL, CASE], []), ("dial-case-diameter", [DIAL | {"diameter_mm": None}, CASE], ["warning"]), ("dial-case-diameter", [DIAL | {"diameter_mm": 26.0}, CASE], ["warning"]),
    ("nh34-hand-stack", [NH34, HANDS | {"gmt": True}, CRYSTAL | {"name": "Flat Double Dome Sapphire"}], []), ("nh34-hand-stack", [NH35 | {"caliber": None}, HANDS], ["warning"]), ("nh34-hand-stack", [NH34, HANDS], ["warning", "warning"]),
    ("date-window-alignment", dated("3", "6"), ["error"]), ("date-window-alignment", dated("3.8", "3"), []), ("date-window-alignment", dated("3", "3"), ["error"]), ("date-window-alignment", dated("3", "3", sold="3.8"), []),
    ("date-window-alignment", dated("12:30", "11:42"), []), ("date-window-alignment", dated("tilted", "3"), ["warning"]), ("date-window-alignment", dated("", "3"), ["error"]), ("date-window-alignment", [DIAL | {"has_date_window": False}, NH35], ["warning"]),
    ("day-window-presence", [DIAL | {"has_day_window": True}, NH35], ["error"]), ("day-window-presence", [DIAL, NH36], ["warning"]), ("day-window-presence", [DIAL | {"has_day_window": None}, NH36], ["warning"]),
    ("dial-movement-size", [DIAL, NH35 | {"caliber": "NH72"}], ["warning"]), ("dial-movement-size", [DIAL, NH35 | {"caliber": None}], ["warning"]), ("dial-movement-size", [DIAL, VK], []),
    *[(r, [p | {"family": p["family"].replace("skx007", "skx013")}, CASE], [s]) for r, p, s in (("insert-case-fit", INSERT, "error"), ("crystal-case-fit", CRYSTAL, "error"), ("chapter-ring-fit", RING, "warning"), ("crown-case-fit", CROWN, "error"), ("bezel-case-fit", BEZEL, "error"))],
    ("insert-case-fit", [INSERT | {"family": "unknown"}, CASE], ["warning"]), ("insert-case-fit", [INSERT, CASE], []),
    ("strap-fit", [STRAP | {"family": "skx013-bracelet"}, CASE], ["error"]), ("strap-fit", [STRAP, CASE], ["warning"]), ("strap-fit", [STRAP | {"lug_width_mm": 22.0}, CASE], []), ("strap-fit", [STRAP | {"lug_width_mm": None}, CASE], ["warning"]),
    ("insert-crystal-profile-fit", [INSERT | {"profile": "flat"}, CRYSTAL | {"profile": "domed"}], ["error"]), ("insert-crystal-profile-fit", [INSERT | {"profile": "slope"}, CRYSTAL | {"profile": "flat"}], ["error"]), ("insert-crystal-profile-fit", [INSERT, CRYSTAL | {"profile": "flat"}], ["warning"]),
    ("integrated-chapter-ring", [CASE | {"integrated_ring": True, "ring_excluded": True}, RING], ["error"]), ("integrated-chapter-ring", [CASE | {"integrated_ring": True}, RING], ["warning"]),
    ("integrated-bezel", [CASE | {"integrated_bezel": True}, INSERT, BEZEL], ["error", "error"]), ("requires-chapter-ring", [CASE | {"requires_ring": True}, DIAL], ["error"]), ("requires-chapter-ring", [CASE | {"requires_ring": True}, DIAL, RING], []),
    ("chapter-ring-unstated", [CASE], ["warning"]), ("chapter-ring-unstated", [CASE | {"requires_ring": True}], []), ("hand-stack-clearance", [HANDS, RING], ["warning"]), ("crown-stem-length", [CROWN, CASE], ["info"]),
    ("dial-case-model-exclusion", [DIAL | {"excluded_cases": "srpe-case,skx007-case"}, CASE], ["error"]), ("bracelet-vendor-scope", [STRAP | {"vendor_scope": 9}, CASE], ["error"]), ("bracelet-vendor-scope", [STRAP | {"vendor_scope": 1}, CASE], []),
    ("lume-mismatch", [HANDS | {"lumed": True}, DIAL | {"lumed": False}], ["info"]), ("lume-mismatch", [HANDS, DIAL], ["info"]), ("unverified-part", [CASE | {"spec_source": "family-inferred"}, DIAL | {"spec_source": "manual"}], ["warning"]),
    ("multi-vendor-shipping", [CASE, DIAL], []), ("stock-availability", [CASE], []), ("family-exception", [CASE], []),
]


@pytest.fixture(scope="module")
def judged(spark):
    parts, slots = [], []
    for b, (_, build, _) in enumerate(VECTORS):
        for k, p in enumerate(build):
            full = {"spec_source": "vendor-stated", "name": "part", **p, "part_id": b * 100 + k}
            parts.append((p["slot"], *[full.get(f) for f in PART_FIELDS]))
            slots.append((b, p["slot"], b * 100 + k))
    catalog = spark.createDataFrame(parts, "slot string, " + ", ".join(f"{f} {KIND.get(f, 'boolean')}" for f in PART_FIELDS))
    listings = catalog.select("part_id", F.lit(1).cast("long").alias("vendor_id"), F.lit(1000).cast("long").alias("price_minor"), F.lit(True).alias("in_stock"))
    wide = evaluate.wide_builds(spark.createDataFrame(slots, "build_id long, slot string, part_id long"), catalog, listings)
    return wide, evaluate.findings(wide).collect()


def test_vectors(judged):
    for b, (rule, _, want) in enumerate(VECTORS):
        assert sorted(r.raw_severity for r in judged[1] if r.build_id == b and r.rule_key == rule) == want, (b, rule)


def test_every_rule_is_covered():
    assert {v[0] for v in VECTORS} == {r.key for r in RULES} and len(RULES) == 27


def test_only_verified_errors_block(judged):
    wide, found = judged
    assert all(r.tier == "verified" for r in found if r.severity == "error")
    assert all(r.severity == "warning" for r in found if r.rule_key == "date-window-alignment")
    fast = {r.build_id: tuple(r) for r in evaluate.evaluate(wide).select("build_id", "n_error", "n_warning", "n_info", "status").collect()}
    for b in fast:
        n = [sum(r.severity == s for r in found if r.build_id == b) for s in ("error", "warning", "info")]
        assert fast[b][1:] == (*n, "blocked" if n[0] else "warnings" if n[1] else "ok")


def test_fields_that_are_read_are_enough(spark):
    """Rows with only the fields that a rule reads give its findings; before, a row of every part took all 34 fields of any slot through the shuffle."""
    parts, slots = [], []
    for b, (_, build, _) in enumerate(VECTORS):
        for k, p in enumerate(build):
            full = {"spec_source": ("vendor-stated", "family-inferred", "user-entered")[b % 3], "name": "part", **p, "part_id": b * 100 + k}
            parts.append((p["slot"], *[full.get(f) for f in PART_FIELDS]))
            slots.append((b, p["slot"], b * 100 + k))
    catalog = spark.createDataFrame(parts, "slot string, " + ", ".join(f"{f} {KIND.get(f, 'boolean')}" for f in PART_FIELDS))
    listings = catalog.where("part_id % 3 > 0").select("part_id", (F.col("part_id") % 7).alias("vendor_id"), F.lit(1000).cast("long").alias("price_minor"), (F.col("part_id") % 2 == 0).alias("in_stock"))
    noted = catalog.where("part_id % 5 = 0").select("part_id", F.lit("noted").alias("rule_key"), F.lit("error").alias("severity"))
    frame = spark.createDataFrame([*slots, (998, "crown", -1), (999, "bezel", 0)], "build_id long, slot string, part_id long")
    full = evaluate.wide_builds(frame, catalog, listings, noted).persist()
    all_read = evaluate.wide_builds(frame, catalog, listings, noted, evaluate.fields_read())
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(evaluate.findings(full)) == rows(evaluate.findings(all_read)) and rows(evaluate.evaluate(full)) == rows(evaluate.evaluate(all_read))
    for rule in RULES[3:25:3]:
        some = evaluate.wide_builds(frame, catalog, listings, noted, evaluate.fields_read((rule,)))
        assert rows(evaluate.findings(full, (rule,))) == rows(evaluate.findings(some, (rule,))), rule.key
    narrow = evaluate.wide_builds(frame, catalog, listings, noted, evaluate.fields_read(tuple(r for r in RULES if r.key == "bezel-case-fit")))
    assert narrow.schema["p_case"].dataType.names == ["family", "spec_source"] and "price_minor" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    full.unpersist()


def test_only_vendors_that_straps_keep_to_travel(spark):
    """Of forty vendors of a case its rows carry the least and those of some strap's scope; before, all forty went through the builds' shuffle."""
    part = lambda i, **known: (known["slot"], *[({"spec_source": "vendor-stated", "name": "part", "part_id": i} | known).get(f) for f in PART_FIELDS])
    parts = [part(1, **CASE), part(2, **CASE), *[part(10 + k, **STRAP, vendor_scope=v) for k, v in enumerate((7, 50, None))]]
    catalog = spark.createDataFrame(parts, "slot string, " + ", ".join(f"{f} {KIND.get(f, 'boolean')}" for f in PART_FIELDS))
    listings = spark.range(2, 42).select(F.lit(1).cast("long").alias("part_id"), F.col("id").alias("vendor_id"), F.lit(1000).cast("long").alias("price_minor"), F.lit(True).alias("in_stock"))
    slots = spark.createDataFrame([(c * 10 + k, s, p) for c in (1, 2) for k in range(3) for s, p in (("case", c), ("strap", 10 + k))], "build_id long, slot string, part_id long")
    scope = tuple(r for r in RULES if r.key == "bracelet-vendor-scope")
    some = evaluate.wide_builds(slots, catalog, listings, None, evaluate.fields_read(scope))
    assert {r.build_id: r.p_case.vendors for r in some.collect()} == {10: [2, 7], 11: [2, 7], 12: [2, 7], 20: None, 21: None, 22: None}
    full = evaluate.wide_builds(slots, catalog, listings)
    found = [sorted((r.build_id, r.raw_severity) for r in evaluate.findings(w, scope).collect()) for w in (full, some)]
    assert found[0] == found[1] == [(11, "error"), (20, "warning"), (21, "warning")]


def test_builds_of_some_slots(spark):
    """A build is shuffled as one row of the slots that are read, and the least part of each stands; before, each of its parts was a row."""
    from fitloom.plans import mapping

    where = "/root/testdata/sf0.001"
    want = sorted(map(tuple, mapping.view(spark, where, mapping.BUILD_SLOT_SQL).select("build_id", "slot", "part_id").collect()))
    rows = lambda df: sorted(map(tuple, df.select("build_id", "slot", "part_id").collect()))
    assert rows(mapping.build_slots(spark, where)) == want
    assert rows(mapping.build_slots(spark, where, ("case", "bezel"))) == [r for r in want if r[1] in ("case", "bezel")]


def test_builds_of_plain_fields_are_not_sorted(spark):
    """Fields of fixed width are gathered by hash, with unknown parts and empty slots as ever; before, a task sorted all rows of its builds."""
    parts = [(p, s, f) for p, s, f in ((1, "dial", True), (2, "dial", None), (3, "case", None))]
    catalog = spark.createDataFrame([(s, *[{"part_id": p, "has_feet": h}.get(f) for f in PART_FIELDS]) for p, s, h in parts], "slot string, " + ", ".join(f"{f} {KIND.get(f, 'boolean')}" for f in PART_FIELDS))
    slots = spark.createDataFrame([(1, "dial", 1), (1, "case", 3), (2, "dial", 2), (3, "dial", 3), (3, "case", 9), (4, "case", 3)], "build_id long, slot string, part_id long")
    wide = evaluate.wide_builds(slots, catalog, None, None, {"dial": ("part_id", "has_feet"), "case": ("part_id",)})
    got = {r.build_id: (r.p_dial and tuple(r.p_dial), r.p_case and tuple(r.p_case)) for r in wide.collect()}
    assert got == {1: ((1, True), (3,)), 2: ((2, None), None), 3: (None, None), 4: (None, (3,))}
    assert "SortAggregate" not in wide._jdf.queryExecution().executedPlan().toString()
