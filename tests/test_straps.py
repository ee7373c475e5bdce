import random
import re

import pytest
from pyspark.sql import functions as F

from fitloom.operators import straps

KINDS = ["strap-band", "strap-nato", "strap-oyster", "strap-jubilee", "strap-bracelet", "other"]


def plain(builds, bands, refused):
    """Every strap scored for every build in turn."""
    out = []
    for collection in sorted({b[0] for b in builds}):
        used, kinds = set(), {}
        for _, position, build_id, slug, tags, case in sorted(b for b in builds if b[0] == collection):
            tags, case, slug = tags or [], case or "", slug or ""
            look = next((n for n, w in straps.NAMED if re.search(w, slug)), None) or ("dress" if "dressy" in tags and "tool-watch" not in tags else "field" if "pilot" in tags else "dive")
            order, dark = straps.KINDS[look], bool(re.search("black|pvd|dlc", case, re.I))
            platform = "SKX013" if re.search("SKX013", case, re.I) else "Turtle" if re.search("Turtle|SRP", case, re.I) else "SKX007"
            found = []
            for part, name, kind, st, fit in bands:
                name, st = name or "", st or []
                if kind not in order or (build_id, fit) in refused:
                    continue
                s = (len(order) - order.index(kind)) * 100
                leather, rubber = re.search(straps.LEATHER, name), re.search(straps.RUBBER, name)
                if kind == "strap-band":
                    want = straps.MATERIAL[look]
                    s += (120 if leather else -40 if rubber else 0) if want == "leather" else (120 if rubber else 30 if leather else 0) if want == "rubber" else 60 if leather or rubber else 0
                    s += 60 if look == "vintage" and re.search(straps.TROPIC, name) else 0
                s += 30 if set(tags) & set(straps.COLOURS) & set(st) else 14 if {"black", "brown"} & set(st) else 0
                s += 10 if dark and "black" in st else 0
                if kind not in ("strap-band", "strap-nato"):
                    s += 8 if dark and "black" in st else 0
                    s += 14 if not dark and ("silver-tone" in st or not st) else 0
                    s -= 30 if not dark and "black" in st else 0
                s += 18 if re.search(platform, name, re.I) else 0
                s -= (250 if part in used else 0) + 22 * kinds.get(kind, 0)
                found.append((-s, part, kind))
            s, part, kind = min(found, default=(None, None, None))
            if part is not None:
                used.add(part)
                kinds[kind] = kinds.get(kind, 0) + 1
            out.append((collection, position, build_id, look, part, kind, None if s is None else -s))
    return out


def test_picks_equal_a_plain_fold(spark):
    turn = random.Random(9)
    some = lambda words: turn.sample(words, turn.randint(0, 2))
    builds = [(c, p, c * 100 + p, turn.choice(["x-dress", "field-y", "gmt", "", None, "vintage", "utility"]), turn.choice([None, some(["green", "red", "dressy", "tool-watch", "pilot", "blue"])]), turn.choice([None, "SKX013 Black", "Turtle", "DLC", "Plain"])) for c in range(6) for p in range(turn.randint(1, 25))]
    bands = [(i, turn.choice([None, "Leather", "Tropic Rubber SKX007", "Rubber Turtle", "Plain SKX013", "Bracelet"]), turn.choice(KINDS), turn.choice([None, some(["black", "brown", "green", "red", "silver-tone"])]), f"f{turn.randint(0, 2)}") for i in range(60)]
    refused = {(b[2], f"f{k}") for b in builds for k in range(3) if turn.random() < 0.2}
    frame = spark.createDataFrame(builds, "collection long, position long, build_id long, slug string, tags array<string>, case_name string").repartition(3)
    known = spark.createDataFrame(bands, "part_id long, name string, kind string, tags array<string>, fit_class string").repartition(3)
    no = spark.createDataFrame(sorted(refused), "build_id long, fit_class string")
    fits = lambda pairs: pairs.join(no, ["build_id", "fit_class"], "left_anti")
    got = sorted(map(tuple, straps.pick_straps(frame, known, fits).collect()))
    assert got == plain(builds, bands, refused)
    # Lists that outlast their straps take used ones again; nothing to pick from gives no part.
    few = known.where(F.col("part_id").isin([r[0] for r in bands if r[2] == "strap-band"][:2]))
    kept = {r.part_id for r in few.collect()}
    assert sorted(map(tuple, straps.pick_straps(frame, few, fits).collect())) == plain(builds, [b for b in bands if b[0] in kept], refused)
    assert all(r.part_id is None for r in straps.pick_straps(frame, known.limit(0), fits).collect())
    assert straps.pick_straps(frame.limit(0), known, fits).count() == 0


def test_builds_alike_are_judged_once(spark):
    """Rules are asked for one build of each class of cases, and a list gets no more straps of a kind than it has builds; before, every build met every class of straps."""
    turn = random.Random(4)
    builds = [(c, p, c * 100 + p, turn.choice(["x-dress", "field-y", "", "vintage"]), turn.choice([None, ["green"], ["red", "pilot"]]), turn.choice([None, "SKX013 Black", "Turtle"])) for c in range(5) for p in range(1 + 3 * c)]
    bands = [(i, turn.choice(["Leather", "Tropic Rubber SKX007", "Rubber Turtle", "Bracelet"]), turn.choice(KINDS), turn.choice([None, ["black"], ["green"], ["silver-tone"]]), f"f{i % 7}") for i in range(300)]
    group = {b[2]: turn.choice(["a", "b", "c", None]) for b in builds}
    bad = {("a", "f1"), ("a", "f2"), ("b", "f0"), ("b", "f3"), *(("c", f"f{k}") for k in range(6))}
    refused = {(b, f"f{k}") for b, g in group.items() for k in range(7) if g is None or (g, f"f{k}") in bad}
    frame = spark.createDataFrame([(*b, group[b[2]]) for b in builds], "collection long, position long, build_id long, slug string, tags array<string>, case_name string, fits_like string").repartition(3)
    known = spark.createDataFrame(bands, "part_id long, name string, kind string, tags array<string>, fit_class string").repartition(3)
    no, asked = spark.createDataFrame(sorted(refused), "build_id long, fit_class string"), []
    fits = lambda pairs: asked.append(pairs) or pairs.join(no, ["build_id", "fit_class"], "left_anti")
    assert sorted(map(tuple, straps.pick_straps(frame, known, fits).collect())) == plain(builds, bands, refused)
    assert asked[0].count() == 3 * 7


def test_the_query_equals_its_sql(spark):
    """Cases of one class pass alike: the picks at the smallest size, by the query's own SQL."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    where, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    names = ["collection", "position", "build_id", "look", "part_id", "kind", "score"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()['strap_picks']})").fetchall()
    got = [tuple(r) for r in entry.queries()["strap_picks"](spark, where).select(*names).collect()]
    assert got and sorted(got) == sorted(want)
