"""Drawn sizes, colours, outlines, hand roles and filled attributes on rows of their own."""

import math
import random

from pyspark.sql import functions as F

from fitloom.functions import drawing
from fitloom.operators import backfill


def test_sizes_without_and_with_figures(spark):
    row = spark.createDataFrame([(None, None), (37.0, 40.0)], "c double, i double")
    none, some = row.select(drawing.watch_sizes({"case": F.col("c"), "insertInner": F.col("i")}).alias("w")).select("w.*").collect()
    assert (none["case"], none.insertOuter, none.insertInner, none.ringInner, none.lugToLug, none.stated) == (42.5, 38.0, 31.8, 27.7, 46.0, "")
    # The insert follows its case, and its bore ends within it.
    assert (some["case"], some.insertOuter, some.insertInner, some.stated) == (37.0, 32.5, 31.5, "case,insertInner")


def test_colours_go_there_and_back(spark):
    codes = spark.range(256).select("id", drawing.coded(drawing.linear(F.col("id") / 255.0)).alias("again"))
    assert all(r.id == r.again for r in codes.collect())
    rows = spark.createDataFrame([(0.5, 0.25, 1.0), (0.3, 0.1, 0.5), (0.2, 0.2, 0.0), (2.0, -1.0, 1.0)], "u double, v double, c double")
    for r in rows.select("*", drawing.packed_uv(F.col("u"), F.col("v"), F.col("c")).alias("b")).collect():
        want = [math.floor(min(1, max(0, x / r.c)) * 4095 + 0.5) if r.c > 0 else 0 for x in (r.u, r.v)]
        assert [r.b[0] * 16 + r.b[1] // 16, r.b[1] % 16 * 256 + r.b[2]] == want


def test_polygon_distance(spark):
    """Against steps along the edges, and the winding of the corners."""
    draw = random.Random(3)
    corners = [(0.0, 0.0), (5.0, 1.0), (4.0, 4.0), (2.0, 2.0), (1.0, 5.0)]
    points = [(draw.uniform(-2, 7), draw.uniform(-2, 7)) for _ in range(60)]
    poly = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    got = spark.createDataFrame(points, "x double, y double").select("x", "y", drawing.polygon_distance(F.col("x"), F.col("y"), poly).alias("d")).collect()
    for r in got:
        edges = list(zip(corners, corners[1:] + corners[:1]))
        near = min(math.dist((r.x, r.y), (a[0] + (b[0] - a[0]) * k / 4000, a[1] + (b[1] - a[1]) * k / 4000)) for a, b in edges for k in range(4001))
        turn = sum(math.remainder(math.atan2(b[1] - r.y, b[0] - r.x) - math.atan2(a[1] - r.y, a[0] - r.x), 2 * math.pi) for a, b in edges)
        assert abs(abs(r.d) - near) < 2e-3 and (r.d < 0) == (abs(turn) > math.pi)
    empty = F.array().cast("array<struct<x:double,y:double>>")
    assert spark.range(1).select(drawing.polygon_distance(F.lit(0.0), F.lit(0.0), empty).alias("d")).first().d is None


def test_roles_of_hands(spark):
    rows = [("two", 1, 9.0, 3.0), ("two", 2, 12.0, 0.1), ("three", 1, 8.0, 2.0), ("three", 2, 12.0, 1.5), ("three", 3, 11.0, 0.4), ("four", 1, 5.0, 1.0), ("four", 2, 5.0, 1.0), ("four", 3, 5.0, 1.0), ("four", 4, 5.0, 0.0)]
    got = backfill.hand_roles(spark.createDataFrame(rows, "k string, i int, length double, thickness double"), "k", "i")
    assert {(r.k, r.i): r.role for r in got.collect()} == {
        ("two", 1): "hour", ("two", 2): "minute", ("three", 1): "hour", ("three", 2): "minute", ("three", 3): "second", ("four", 1): "second", ("four", 2): "minute", ("four", 3): "hour", ("four", 4): "extra",
    }
    assert backfill.hand_roles(spark.createDataFrame([], "k string, i int, length double, thickness double"), "k", "i").count() == 0


def test_titles_before_families(spark):
    rows = [
        (1, "case", "skx013-case", "NMK941 Diver Case Turtle"), (2, "case", "srpe-case", "Explorer Watch Case 36mm 3 o'clock NCG"), (3, "case", "nowhere", "Double Dome Case"), (4, "dial", "nh3x-dial-feetless", "Blue Dial No Date"),
        (5, "strap", "generic-strap", "Oyster Bracelet 20/16mm"), (6, "strap", "generic-strap", "Nylon 22 mm"), (7, "movement", "nh3x-movement", "NH36 Date @ 6H @ 4H Crown"), (8, "movement", "nh3x-movement", "NH70 open"), (9, None, None, None),
    ]
    got = {r.part_id: r for r in backfill.backfilled(spark.createDataFrame(rows, "part_id int, category string, family string, title string")).collect()}
    assert (got[1].case_mm, got[1].lug_mm, got[1].crystal_mm, got[1].integrated_ring, got[1].ring_excluded, got[1].integrated_bezel, got[1].outline) == (37.8, 20.0, 28.0, True, True, None, "cushion")
    assert (got[2].case_mm, got[2].crown_position, got[2].requires_ring, got[2].crown_at_three, got[2].no_crown_guard) == (36.0, "3.8", True, True, True)
    assert (got[3].case_mm, got[3].double_domed) == (None, True)
    assert (got[4].has_feet, got[4].dial_mm, got[4].has_date_window) == (False, 28.5, False)
    assert (got[5].lug_mm, got[5].vendor_scope, got[6].lug_mm, got[6].vendor_scope) == (20.0, "luciusatelier", 22.0, None)
    assert (got[7].caliber, got[7].has_day, got[7].has_date, got[7].date_position, got[7].height_mm, got[7].crown_position) == ("NH36", True, True, "6", 5.32, "4")
    assert (got[8].caliber, got[8].has_day, got[8].height_mm) == ("NH70", None, None)
    assert set(got[9][1:]) == {None}


def test_polygon_corners_are_paired_once(spark):
    """Before, each step of the fold built the whole array of corners again, some dozens of times."""
    rows = spark.createDataFrame([], "x double, y double, rim array<struct<x:double,y:double>>")
    plan = rows.select(drawing.polygon_distance(F.col("x"), F.col("y"), F.col("rim")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan[: plan.index("LogicalRDD")].count("rim#") <= 10
