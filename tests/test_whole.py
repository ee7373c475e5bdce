"""Queries that run over whole tables: every row of the input counts in the result."""

import os
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from fitloom import queries
from fitloom.operators import evaluate, matching
from fitloom.plans import mapping, oracle

DATA, FIRST = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_every_line_is_applied(spark):
    lines = [(r.l_orderkey, r.l_linenumber, r.l_suppkey, r.l_partkey) for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect()]
    old = {("supplier", r.s_suppkey): (r.s_name, r.s_nationkey) for r in spark.read.parquet(f"{DATA}/supplier.parquet").collect()}
    last, least = {}, {}
    for order, number, supplier, part in lines:
        for key in (("supplier", supplier), ("part", part)):
            last[key] = max(last.get(key, (-1, "")), (order, f"v{number}"))
            least[key] = min(least.get(key, ("w", 0)), (f"v{number}", order))
    want = {k: (old[k][0] if k in old else last[k][1], last[k][0] if k in last else old[k][1]) for k in old.keys() | last.keys()}
    assert {(r.kind, r.k): (r.name, r.n) for r in queries.QUERIES["upsert_all_changes"](spark, DATA).collect()} == want
    assert {(r.kind, r.k): (r.name, r.n) for r in queries.QUERIES["insert_all_absent"](spark, DATA).collect()} == least | old


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_every_part_is_a_seed(spark):
    """Against all pairs: names alone are enough, a brand's own parts don't count, close images come first."""
    from fitloom.functions import text

    words = {r.id: set(r.w) for r in spark.read.parquet(f"{DATA}/part.parquet").select(F.col("p_partkey").alias("id"), text.keywords(F.col("p_name")).alias("w")).collect()}
    image = {r.id: int(r.phash, 16) for r in queries.QUERIES["phash"](spark, DATA).collect()}
    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    want = set()
    for s in parts:
        found = []
        for p in parts:
            if p.p_type != s.p_type or p.p_brand == s.p_brand:
                continue
            a, b = words[s.p_partkey], words[p.p_partkey]
            overlap = len(a & b) / len(a | b) if a and b else 0.0
            distance = bin(image[s.p_partkey] ^ image[p.p_partkey]).count("1") if {s.p_partkey, p.p_partkey} <= image.keys() else None
            near = distance is not None and distance <= 40
            if near or overlap >= 0.28:
                found.append((not near, distance if near else 0, -overlap, p.p_partkey, distance))
        want |= {(s.p_partkey, k, d, round(-o, 6), rank) for rank, (_, _, o, k, d) in enumerate(sorted(found, key=lambda f: f[:4])[:8], 1)}
    assert {tuple(r) for r in queries.QUERIES["suggest_all_matches"](spark, DATA).collect()} == want and len(want) > len(parts)


def test_close_images_and_pairs_that_are_not_mutual(spark):
    schema = "id long, category string, vendor string, words array<string>, bits array<long>"
    rows = [(1, "c", "v", ["a"], [0, 0, 0, 0]), (2, "c", "w", ["b"], [0, 0, 0, 3]), (3, "c", "w", ["a"], [0, 0, 7, 0]), (4, "c", "v", ["x"], [0, 0, 0, 0]), (5, "c", "w", ["a"], [-1, 0, 0, 0]), (6, "d", "w", ["a"], [0, 0, 0, 0]), (7, "c", "u", ["a"], None)]
    got = matching.suggestions(matching.candidates(spark.createDataFrame(rows, schema))).where("seed = 1").orderBy("rank").collect()
    assert [(r.part, r.distance) for r in got] == [(2, 2), (3, 3), (5, 64), (7, None)]
    line = [(1, "c", None, [], [0]), (2, "c", None, [], [7]), (3, "c", None, [], [15]), (4, "c", None, [], [15])]
    assert [tuple(r) for r in matching.mutual(spark.createDataFrame(line, schema)).collect()] == [(3, 4, 64)]
    many = [(k, "c", f"v{k % 3}", [], [k * 0x9E3779B97F4A7C15 % 2**63 >> 20 << 20]) for k in range(60)]
    far = lambda a, b: bin(many[a][4][0] ^ many[b][4][0]).count("1")
    want = {(a, *x[::-1]) for a in range(60) for x in sorted((far(a, b), b) for b in range(60) if a % 3 != b % 3)[:2]}
    assert {(r.seed, r.part, r.distance) for r in matching.closest(spark.createDataFrame(many, schema), 2, 64, block=7).collect()} == want


@pytest.mark.skipif(not os.path.isdir(FIRST), reason="needs the test tables")
def test_first_builds_meet_every_rule(spark):
    """Each step against the rules' SQL over all eligible parts in stock, without any reduction."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FIRST}/{t}.parquet'")
    price = dict(con.execute(f"SELECT part_id, min(price_minor) FROM ({mapping.LISTING_SQL}) l WHERE in_stock GROUP BY part_id").fetchall())
    rows = con.execute(f"SELECT * FROM ({mapping.CATALOG_SQL}) c")
    names = [d[0] for d in rows.description]
    parts = {r["part_id"]: r for r in (dict(zip(names, x)) for x in rows.fetchall())}
    brands = sorted({p["brand"] for p in parts.values()})
    line = lambda f: next((f[: -len(x) - 1] for x in ("case", "bracelet") if f.endswith("-" + x)), None)
    got = {}
    for r in queries.QUERIES["first_build_options"](spark, FIRST).collect():
        got.setdefault((r.style_id, r.slot), []).append((r["rank"], r.part_id, r.n_warning, r.price_minor))

    def may(p):
        other = p["gmt"] is True or p["has_subdials"] is True
        return {"case": p["requires_ring"] is not True and not re.search("ring|bezel|tube|insert|gasket|spacer", p["name"]), "dial": not other, "hands": not other, "movement": p["caliber"] in ("NH35", "NH36") and p["crown_position"] is None}.get(p["slot"], True)

    ends = set()
    for style in (1, 2, 13):
        build = {}
        for slot in ("case", "bezelInsert", "dial", "movement", "hands", "strap"):
            if slot == "bezelInsert" and parts[build["case"]]["integrated_bezel"]:
                assert (style, slot) not in got
                continue
            tried = [k for k, p in parts.items() if p["slot"] == slot and k in price and may(p)]
            values = [(k, s, q) for k in tried for s, q in (*build.items(), (slot, k))]
            head, body = oracle.findings_sql(None, "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s}', {q})" for k, s, q in values) + ") v(build_id, slot, part_id)")
            count = {k: (e, w) for k, e, w in con.execute(head + f"SELECT build_id, count(*) FILTER (WHERE severity = 'error'), count(*) FILTER (WHERE severity = 'warning') FROM ({body}) f GROUP BY build_id").fetchall()}
            fits = lambda p: slot == "strap" and line(p["family"]) is not None and line(p["family"]) == line(parts[build["case"]]["family"])  # noqa: B023, E731
            order = sorted((-10 * fits(parts[k]) - (parts[k]["brand"] == brands[style - 1]), count.get(k, (0, 0))[1], price[k], k) for k in tried if count.get(k, (0, 0))[0] == 0)
            assert sorted(got.get((style, slot), [])) == [(n, k, w, c) for n, (_, w, c, k) in enumerate(order[:6], 1)], (style, slot)
            ends.add(slot)
            if not order:
                break
            build[slot] = order[0][3]
    assert {"case", "dial", "movement"} <= ends


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_pairs_are_judged_by_their_rules(spark):
    """Against a build for each two parts, and the rules' findings on it."""
    catalog, listings = mapping.catalog(spark, DATA), mapping.listings(spark, DATA)
    assert {("dial", "movement"), ("case", "dial"), ("dial", "hands"), ("bezelInsert", "crystal"), ("case", "strap"), ("case", "chapterRing")} <= matching.rule_pairs().keys()
    pairs = [("bezelInsert", "case"), ("case", "strap"), ("dial", "movement")]
    parts = catalog.select("slot", "part_id").collect()
    slots, builds = [], {}
    for a, b in pairs:
        for x in parts:
            for y in parts:
                if (x.slot, y.slot) == (a, b):
                    builds[len(builds)] = (a, b)
                    slots += [(len(builds) - 1, a, x.part_id), (len(builds) - 1, b, y.part_id)]
    wide = evaluate.wide_builds(spark.createDataFrame(slots, "build_id long, slot string, part_id long"), catalog, listings)
    found = {}
    for f in evaluate.findings(wide, tuple({r.key: r for p in pairs for r in matching.rule_pairs()[p]}.values())).collect():
        found.setdefault(f.build_id, []).append(f)
    want, joined = Counter(), matching.rule_pairs()
    for k, pair in builds.items():
        rules = [r.key for r in joined[pair]]
        for of in (None, *rules):
            mine = [f for f in found.get(k, []) if f.rule_key in (rules if of is None else [of])]
            warn = [f for f in mine if f.severity == "warning"]
            outcome = "error" if any(f.severity == "error" for f in mine) else "ok" if not warn else "cant-confirm" if all(re.search(matching.UNSURE, f.message) for f in warn) else "warning"
            want[(*pair, of, outcome, any(f.raw_severity == "error" for f in mine))] += 1
    got = matching.judged_pairs(catalog, listings, pairs).collect()
    assert Counter({tuple(r)[:5]: r.pairs for r in got}) == want and len({k[3] for k in want}) == 4
