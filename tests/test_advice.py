import random

from pyspark.sql import functions as F

from fitloom.operators import advice

TAGS = ["black", "blue", "lumed", "vintage", "dressy"]
CORE = ["movement", "case", "dial", "hands", "bezelInsert"]
PARTS = "part_id long, slot string, tags array<string>, price_minor long, previewable boolean, other_movement boolean, gmt boolean, has_date boolean"
ASKED = "wish_id long, tags array<string>, requires_date boolean, requires_gmt boolean, budget_minor long"


def allowed(part, wish):
    _, slot, _, price, _, other, gmt, date = part
    _, _, want_date, zone, _ = wish
    if price is None:
        return False
    if slot == "movement":
        return (not zone or gmt is True) and (want_date is None or (date is True) == want_date)
    return not (slot in ("dial", "hands") and other and not zone)


def plain(parts, wishes, depth, wanted, blocked):
    """Every pool sorted whole, and walked."""
    out = {}
    for w in wishes:
        asked = w[1] or []
        shared = lambda p: [t for t in dict.fromkeys(p[2] or []) if t in asked]  # noqa: E731, B023
        rank = lambda p: (p[3], p[0]) if p[1] == "movement" else (-len(shared(p)), not p[4], p[3], p[0])  # noqa: E731, B023
        pools = {s: sorted((p for p in parts if p[1] == s and allowed(p, w)), key=rank) for s in CORE}
        seen, found = set(), []
        for d in range(depth):
            chosen = [pools[s][min(d, len(pools[s]) - 1)] for s in CORE if pools[s]]
            ids, total = tuple(p[0] for p in chosen), sum(p[3] for p in chosen)
            if len(found) == wanted or len(chosen) < 3 or ids in seen:
                continue
            seen.add(ids)
            if (w[4] is None or total <= w[4]) and sum(ids) % 7 not in blocked:
                got = list(dict.fromkeys(t for p in chosen for t in shared(p)))
                found.append((ids, total, tuple(got), tuple(t for t in asked if t not in got)))
        out[w[0]] = found
    return out


def judge(slots):
    return slots.groupBy("build_id").agg((F.sum("part_id") % 7 == 2).cast("int").alias("n_error"), F.lit(0).alias("n_warning"))


def test_suggestions_equal_whole_sorts(spark):
    rng = random.Random(5)
    some = lambda n: rng.choice([None, [], *[rng.sample(TAGS, rng.randrange(1, n)) for _ in range(4)]])
    parts = [(k, rng.choice(CORE), some(4), rng.choice([None, *range(10, 60, 5)]), rng.choice([True, False, None]), rng.choice([True, False, None]), rng.choice([True, False, None]), rng.choice([True, False, None])) for k in range(150)]
    parts += [(1000 + k, "dial", ["black"], 5 + k % 3, True, False, None, None) for k in range(40)]  # a set of tags beyond the depth
    wishes = [(k, some(5), rng.choice([None, True, False]), rng.choice([None, True]), rng.choice([None, 90, 150])) for k in range(30)]
    frame = spark.createDataFrame(parts, PARTS), spark.createDataFrame(wishes, ASKED)
    for depth, wanted in ((14, 3), (3, 2)):
        got = {}
        for r in sorted(advice.tag_suggestions(*frame, judge, wanted, depth).collect(), key=lambda r: (r.wish_id, r.suggestion)):
            got.setdefault(r.wish_id, []).append((tuple(r.parts), r.total_minor, tuple(r.matched), tuple(r.missed)))
        assert got == {k: v for k, v in plain(parts, wishes, depth, wanted, {2}).items() if v}
    assert advice.tag_suggestions(frame[0].limit(0), frame[1], judge).count() == 0


def test_evaluation(spark):
    must = "struct<tags:array<string>,budget_minor:bigint,requires_date:boolean,requires_gmt:boolean,size_mm:double>"
    read = "struct<tags:array<string>,budget_minor:bigint,requires_date:boolean,requires_gmt:boolean,size_from:double,size_to:double>"
    rows = [
        (1, "model", (["black", "blue"], 1000, False, None, 41.0), ["lumed"], (["black", "lumed"], 1009, False, None, 39.0, 43.0), ["gold-ish"]),
        (2, "model", (None, 1000, None, True, 41.0), None, (None, 1011, None, None, None, None), None),
        (3, "keywords", (None, None, None, None, None), None, (["invented"], None, None, None, None, None), None),
    ]
    said = spark.createDataFrame([(1, 2, 900, 0, ["black"], ["lumed"]), (1, 1, 1001, 0, [], ["black", "lumed"]), (2, 1, 999, 0, ["black", "dive-bezel"], [])], "wish_id long, suggestion int, total_minor long, n_error long, matched array<string>, missed array<string>")
    requests = spark.createDataFrame(rows, f"wish_id long, mode string, must {must}, nice array<string>, intent {read}, dropped array<string>")
    results = advice.evaluate_requests(requests, said)
    got = {r.wish_id: r for r in results.collect()}
    assert [(got[k].must_ok, got[k].must_total, got[k].missed) for k in (1, 2, 3)] == [(4, 5, "blue"), (0, 3, "budget,gmt,size"), (0, 0, "")]
    assert (got[1].nice_ok, got[1].emitted, got[1].dropped, got[1].over_budget, got[1].top_minor) == (1, 3, 1, 1, 1001) and got[3].invented == 1 and got[3].n_builds == 0
    assert got[1].explanation == "No part carries the style asked for; this is the cheapest build that fits together. Nothing here has black and lumed."
    assert got[2].explanation == "Nearest in stock: has black and dive bezel."
    report = {r["mode"]: r for r in advice.evaluation_report(results).collect()}
    assert (report["model"].must_recall, report["model"].build_share, report["model"].verdict) == (0.5, 1.0, "fail") and (report["keywords"].must_recall, report["keywords"].verdict) == (None, "fail")


def test_plans_stay_small(spark):
    """Before, the parts were ranked anew wherever a later step read them: one plan of 3,417 lines, of which the driver died."""
    parts = spark.range(400).selectExpr("id AS part_id", "element_at(array('movement', 'case', 'dial', 'hands', 'bezelInsert'), cast(id % 5 + 1 AS int)) AS slot", "array('black') AS tags", "id AS price_minor", "true AS previewable", "false AS other_movement", "true AS gmt", "true AS has_date")
    asked = spark.range(50).selectExpr("id AS wish_id", "array('black') AS tags", "true AS requires_date", "cast(NULL AS boolean) AS requires_gmt", "100 * id AS budget_minor")
    got = advice.tag_suggestions(parts, asked, judge)
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len(lines) < 20 and sum("Range" in line for line in lines) == 1
    assert got.where("wish_id = 49").count() == 3


def test_requests_are_not_broadcast(spark):
    """Before, requests met their suggestions twice, and where Spark guessed them small all of them went through the driver."""
    must = "struct<tags:array<string>,budget_minor:bigint,requires_date:boolean,requires_gmt:boolean,size_mm:double>"
    asked = spark.createDataFrame([(1, "model", (None, 10, None, None, None), None, (None, None, None, None, None, None), None), (2, "model", None, None, None, None)], f"wish_id long, mode string, must {must}, nice array<string>, intent struct<tags:array<string>,budget_minor:bigint,requires_date:boolean,requires_gmt:boolean,size_from:double,size_to:double>, dropped array<string>")
    said = spark.createDataFrame([(1, 1, 9, 0, [], []), (1, 2, 11, 0, [], []), (1, 3, None, 0, [], []), (2, 1, 11, 0, [], [])], "wish_id long, suggestion int, total_minor long, n_error long, matched array<string>, missed array<string>")
    got = advice.evaluate_requests(asked, said)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "SortMergeJoin" in plan
    assert {r.wish_id: (r.n_builds, r.over_budget) for r in got.collect()} == {1: (3, 1), 2: (1, 0)}
