import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom import picture_queries
from fitloom.operators import segments


def fill(start, inside, w, h):
    """Pixels that hang together with start, one at a time."""
    todo, seen = [start], {start}
    while todo:
        x, y = todo.pop()
        for p in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
            if 0 <= p[0] < w and 0 <= p[1] < h and p not in seen and inside(p):
                seen.add(p)
                todo.append(p)
    return seen


def plain(img):
    """(agreement, outside, enclosed, components) by flood fill, pixel by pixel."""
    h, w, _ = img.shape
    far = lambda a, b: max(abs(int(u) - int(v)) for u, v in zip(a, b))
    border = [img[y][x] for x in range(w) for y in (0, h - 1)] + [img[y][x] for y in range(h) for x in (0, w - 1)]
    counts = [sum(far(a, b) <= 18 for b in border) for a in border]
    back = border[counts.index(max(counts))]
    near = {(x, y) for y in range(h) for x in range(w) if far(img[y][x], back) <= 10}
    outside = set()
    for p in near:
        if (p[0] in (0, w - 1) or p[1] in (0, h - 1)) and p not in outside:
            outside |= fill(p, near.__contains__, w, h)
    left, parts = sorted({(x, y) for y in range(h) for x in range(w)} - near, key=lambda p: (p[1], p[0])), []
    seen = set()
    for p in left:
        if p not in seen:
            parts.append(fill(p, set(left).__contains__, w, h))
            seen |= parts[-1]
    parts = sorted((p for p in parts if len(p) >= math.floor(0.0015 * w * h + 0.5)), key=lambda p: -len(p))
    holes, seen = [[] for _ in parts], set()
    enclosed = near - outside
    for p in sorted(enclosed, key=lambda p: (p[1], p[0])):
        if p in seen:
            continue
        hole = fill(p, enclosed.__contains__, w, h)
        seen |= hole
        touch = [sum((x + i, y + j) in part for x, y in hole for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))) for part in parts]
        if len(hole) >= 12 and touch and max(touch):
            holes[touch.index(max(touch))].append(len(hole))
    return max(counts) / len(border), len(outside), len(enclosed), [(len(p), min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p), len(o), max(o, default=0)) for p, o in zip(parts, holes)]


@pytest.mark.parametrize("seed", range(12))
def test_labels_and_holes_equal_a_flood(seed):
    turn = np.random.default_rng(seed)
    h, w = int(turn.integers(5, 40)), int(turn.integers(5, 40))
    img = np.full((h, w, 3), 240) + turn.integers(-4, 5, (h, w, 3))
    for _ in range(int(turn.integers(0, 9))):
        x, y, r = turn.integers(0, w), turn.integers(0, h), turn.integers(1, 12)
        yy, xx = np.mgrid[:h, :w]
        d = (xx - x) ** 2 + (yy - y) ** 2
        img[(d <= r * r) & (d > (r - 2) ** 2 * turn.integers(0, 2))] = turn.integers(0, 255, 3)
    agreement, outside, enclosed, subject, components = segments.analyse(img)
    want = plain(img)
    assert (agreement, outside, enclosed) == (pytest.approx(want[0]), want[1], want[2]) and outside + enclosed + subject == w * h
    got = [(c["area"], c["min_x"], c["min_y"], c["max_x"], c["max_y"], c["n_holes"], round(c["hole_radius"] ** 2 * math.pi)) for c in components]
    assert sorted(got) == sorted(want[3]) and [g[0] for g in got] == [c[0] for c in want[3]]


@pytest.mark.parametrize("angle", [0.0, 0.4, 1.2, 2.5, -1.0])
def test_a_hand_at_any_angle(angle):
    """A bar of 60 with a boss and a hole at its tail: the pivot is the hole's centre and the tip the far end."""
    yy, xx = np.mgrid[:120, :120]
    u, v = (xx - 60) * math.cos(angle) + (yy - 60) * math.sin(angle), -(xx - 60) * math.sin(angle) + (yy - 60) * math.cos(angle)
    ink = ((np.abs(v) <= 2) & (u > -30) & (u < 30)) | ((u + 25) ** 2 + v**2 <= 64)
    img = np.where(ink & ((u + 25) ** 2 + v**2 > 9), 40, 250)[:, :, None].repeat(3, 2)
    (c,) = segments.analyse(img)[4]
    assert c["pivot_from_hole"] and math.hypot(c["pivot_x"] - (60 - 25 * math.cos(angle)), c["pivot_y"] - (60 - 25 * math.sin(angle))) < 0.6
    assert math.hypot(c["tip_x"] - (60 + 30 * math.cos(angle)), c["tip_y"] - (60 + 30 * math.sin(angle))) < 2.5
    assert 50 < c["length"] < 58 and 0 < c["tail_ratio"] < 0.55 and math.cos(c["theta"] - angle) ** 2 > 0.999


def picture(kind):
    yy, xx = np.mgrid[:80, :80]
    d = (xx - 40) ** 2 + (yy - 40) ** 2
    ink = {
        "disc": d <= 900, "ring": (d <= 900) & (d > 600), "thin": (d <= 1444) & (d > 1310), "two": ((xx - 20) ** 2 + (yy - 40) ** 2 <= 256) | ((xx - 60) ** 2 + (yy - 40) ** 2 <= 256), "flat": (xx - 40) ** 2 + 3 * (yy - 40) ** 2 <= 1200, "cross": (np.abs(xx - 40) < 2) | (np.abs(yy - 40) < 2),
        "none": xx < 0, "hands": (yy > 8) & (yy < 60) & (xx % 20 >= 8) & (xx % 20 < 13) & (xx < 60), "blob": ((yy > 8) & (yy < 60) & (xx % 20 >= 8) & (xx % 20 < 13) & (xx < 40)) | ((xx > 44) & (xx < 76) & (yy > 30) & (yy < 62)), "marked": (d <= 900) | ((yy == 75) & (xx > 5) & (xx < 30)),
    }[kind]
    return np.where(ink, 60, 250).astype(np.uint8)


def test_verdicts_and_odd_rows(spark):
    noise = np.where(np.random.default_rng(1).random((80, 80)) < 0.3, 90, 250).astype(np.uint8)
    cases = [
        ("dial", picture("disc"), "ok"), ("dial", picture("marked"), "ok"), ("dial", picture("ring"), "not-disc-shaped"), ("dial", picture("two"), "multiple-subjects"), ("dial", picture("flat"), "not-square-silhouette"), ("dial", picture("cross"), "two-backdrop-colours-in-one-frame"), ("dial", picture("none"), "no-subject-found"), ("dial", noise, "backdrop-not-seamless"),
        ("bezel_insert", picture("ring"), "ok"), ("bezel_insert", picture("disc"), "solid-centre"), ("bezel_insert", picture("thin"), "ring-too-thin"), ("chapter_ring", picture("ring"), "ok"), ("hands", picture("hands"), "ok"), ("hands", picture("disc"), "fewer-than-two-hands"), ("hands", picture("blob"), "large-shape-that-is-no-hand"),
    ]
    rows = [(i, c, 80, 80, bytearray(p.tobytes())) for i, (c, p, _) in enumerate(cases)]
    rows += [(100, "dial", 80, 80, None), (101, "dial", 80, 80, bytearray(b"")), (102, "dial", 80, 80, bytearray(b"abc")), (103, "dial", None, None, bytearray(b"abc")), (None, "dial", 1, 1, bytearray(b"a"))]
    frame = spark.createDataFrame(rows, "id long, category string, width int, height int, pixels binary").repartition(3)
    found = segments.segmented(frame)
    got = {r.id: r for r in segments.verdicts(found.join(frame.select("id", "category"), "id")).collect()}
    assert {i: got[i].reason for i in range(len(cases))} == {i: reason for i, (_, _, reason) in enumerate(cases)}
    assert all(got[i].reason == "backdrop-not-seamless" and got[i].n_subjects == 0 for i in range(100, 104))
    assert segments.segmented(frame.where(F.lit(False))).count() == 0 and found.where("id is null").count() == 1
    # Colour and an alpha channel: nothing but the colours counts.
    rgba = np.dstack([picture("disc")] * 3 + [np.full((80, 80), random.Random(1).randint(0, 255), np.uint8)])
    both = spark.createDataFrame([(1, 80, 80, bytearray(rgba.tobytes())), (2, 80, 80, bytearray(picture("disc").tobytes()))], "id long, width int, height int, pixels binary")
    a, b = [tuple(r)[1:] for r in segments.segmented(both).orderBy("id").collect()]
    assert a == b


def test_stacks_equal_single_pictures_and_drawing_equals_its_sql(spark):
    """Pictures are labelled together and drawn by arrays; before, each was drawn by an expression of 2,304 steps in one task."""
    turn = np.random.default_rng(5)
    stack = (turn.integers(0, 3, (40, 17, 23, 3)) * 9 + 220).astype(np.int16)
    assert segments.analyse_all(stack) == [segments.analyse(p) for p in stack]
    rows = [(k, s) for k in [*range(0, 1400, 3), -7, -50] for s in (1 + k % 50, 8)] + [(3, None), (4, None), (5, None)]
    parts = spark.createDataFrame(rows, "id long, size long")
    drawn = f"transform(transform(sequence(0L, 2303L), i -> named_struct('x', i % 48, 'y', i div 48)), p -> cast({picture_queries.grey('p.x', 'p.y', 'id', 'size')} as int))"
    want = {(r.id, r.size): r.g for r in parts.select("id", "size", F.expr(drawn).alias("g")).collect()}
    made = picture_queries.draw(np.array([r[0] for r in rows]), np.array([r[1] or 0 for r in rows]), np.array([r[1] is not None for r in rows]))
    assert all(want[r] == p.reshape(-1).tolist() for r, p in zip(rows, made, strict=True))


def test_a_small_table_is_spread(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = picture_queries.pictures(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 4 and found.select(F.spark_partition_id()).distinct().count() >= 4
