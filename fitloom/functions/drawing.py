"""Column expressions of drawn sizes, places, colours and outlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes in millimetres that are drawn where none is stated, in the order in which stated ones are named.
DEFAULT_MM = {
    "case": 42.5, "lugWidth": 22.0, "insertOuter": 38.0, "insertInner": 31.8, "ringOuter": 30.5, "ringInner": 27.7,
    "aperture": 28.5, "crown": 7.0, "hourHand": 8.5, "minuteHand": 12.5, "secondHand": 12.5,
}
# The canvas in pixels, what of it is used, the millimetres across it, and sizes by platform.
CANVAS, USED, SPAN_MM = 800, 0.95, 46
PLATFORM_MM = {
    "skx007": {"case": 42.5, "insert": 37.8, "ring": 30.6, "dial": 28.5, "crystal": 31.5},
    "skx013": {"case": 37.8, "insert": 33.0, "ring": 30.6, "dial": 28.5, "crystal": 28.0},
}
HANDS_MM, SEAT_MM, LUG_REACH_MM = 27.0, 1.65, 3.5
PX_PER_MM = CANVAS * USED / SPAN_MM


def watch_sizes(stated: dict[str, Column]) -> Column:
    """What is drawn, in millimetres, of the stated sizes (by the names of DEFAULT_MM); and which were stated."""
    null = F.lit(None).cast("double")
    said = {k: stated.get(k, null) for k in DEFAULT_MM}
    mm = {k: F.coalesce(said[k], F.lit(v)) for k, v in DEFAULT_MM.items()}
    # An insert of no stated size fills the bezel of its case.
    mm["insertOuter"] = F.coalesce(said["insertOuter"], mm["case"] - (DEFAULT_MM["case"] - DEFAULT_MM["insertOuter"]))
    # No bore is wider than what it is cut in.
    mm["insertInner"] = F.least(mm["insertInner"], mm["insertOuter"] - 1)
    mm["ringInner"] = F.least(mm["ringInner"], mm["ringOuter"] - 0.6)
    mm["lugToLug"] = mm["case"] + LUG_REACH_MM
    names = F.array_join(F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(k)) for k, c in said.items()])), ",")
    return F.struct(*[c.alias(k) for k, c in mm.items()], names.alias("stated"))


def radius_px(slot: Column, platform: Column) -> Column:
    """The radius at which a part is drawn; platforms without own sizes take those of the first."""

    def of(key: str) -> Column:
        first, *others = PLATFORM_MM
        size = F.lit(PLATFORM_MM[first][key])
        for p in others:
            size = F.when(platform == p, PLATFORM_MM[p][key]).otherwise(size)
        return size

    mm = F.when(slot.isin("case", "bezel"), of("case")).when(slot == "bezelInsert", of("insert")).when(slot == "chapterRing", of("ring")).when(slot == "crystal", of("crystal")).when(slot == "hands", HANDS_MM).otherwise(of("dial"))
    return mm * PX_PER_MM / 2


def seat_px(case_mm: Column) -> Column:
    """The radius of a bezel's seat, which is cut into the case."""
    return (case_mm / 2 - SEAT_MM) * PX_PER_MM


def place(radius: Column, degrees: Column) -> Column:
    """The canvas point at a radius and degrees clockwise from twelve."""
    turn = F.radians(degrees)
    return F.struct((CANVAS / 2 + radius * F.sin(turn)).alias("x"), (CANVAS / 2 - radius * F.cos(turn)).alias("y"))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _level(x: Column, top: int) -> Column:
    return F.floor(_unit(x) * top + 0.5).cast("int")


def srgb(linear: Column) -> Column:
    return F.when(linear <= 0.0031308, linear * 12.92).otherwise(F.pow(linear, F.lit(1 / 2.4)) * 1.055 - 0.055)


def linear(srgb: Column) -> Column:
    return F.when(srgb <= 0.04045, srgb / 12.92).otherwise(F.pow((srgb + 0.055) / 1.055, F.lit(2.4)))


def coded(light: Column) -> Column:
    """Linear light as one byte."""
    return _level(srgb(_unit(light)), 255)


def packed_uv(u: Column, v: Column, coverage: Column) -> Column:
    """Four bytes: 12 bits of each of u and v, which a pixel's coverage was multiplied into, and the coverage."""
    share = lambda x: F.when(coverage > 0, _level(x / coverage, 4095)).otherwise(0)
    a, b = share(u), share(v)
    low = a.bitwiseAND(F.lit(15)) * 16
    return F.array(F.shiftright(a, 4), low + F.shiftright(b, 8), b.bitwiseAND(F.lit(255)), _level(coverage, 255))


def smoothstep(lo: Column | float, hi: Column | float, x: Column) -> Column:
    t = _unit((x - lo) / (hi - lo))
    return t * t * (3 - t * 2)


def smooth_min(a: Column, b: Column, k: float) -> Column:
    """The lesser of two distances, with a fillet of about k where they are alike."""
    h = _unit((b - a) / k * 0.5 + 0.5)
    return b + (a - b) * h - h * (1 - h) * k


def polygon_distance(x: Column, y: Column, corners: Column) -> Column:
    """Distance of a point to a closed polygon, an array of (x, y) structs; negative inside.

    Null without corners.  Corners are paired into edges once, and each edge is folded into the least squared distance and the parity of crossings.
    """

    def fold(acc, e):
        ex, ey, wx, wy = e["ex"], e["ey"], x - e["ax"], y - e["ay"]
        length = ex * ex + ey * ey
        t = F.when(length > 0, _unit((wx * ex + wy * ey) / length)).otherwise(0.0)
        dx, dy = wx - ex * t, wy - ey * t
        crosses = ((e["ay"] > y) != (e["by"] > y)) & (wx < ex * wy / F.nullif(ey, F.lit(0.0)))
        return F.struct(F.least(acc["d"], dx * dx + dy * dy).alias("d"), (acc["inside"] != F.coalesce(crosses, F.lit(False))).alias("inside"))

    follow = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    edges = F.zip_with(corners, follow, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["y"].alias("by"), (b["x"] - a["x"]).alias("ex"), (b["y"] - a["y"]).alias("ey")))
    zero = F.struct(F.lit(float("inf")).alias("d"), F.lit(False).alias("inside"))
    done = lambda acc: F.when(acc["inside"], -F.sqrt(acc["d"])).otherwise(F.sqrt(acc["d"]))
    return F.when(F.size(corners) > 0, F.aggregate(edges, zero, fold, done))


def ring_status(integrated: Column, required: Column) -> Column:
    """What a case says about a chapter ring."""
    return F.when(integrated, "integrated").when(required, "required").otherwise("unstated")


def insert_print(tags: Column) -> Column:
    has = lambda *t: F.arrays_overlap(tags, F.array(*map(F.lit, t)))
    return F.when(has("blue"), "blue").when(has("gold-tone", "rose-gold"), "gold").when(has("silver-tone"), "steel").otherwise("black")


def ring_print(tags: Column) -> Column:
    has = lambda *t: F.arrays_overlap(tags, F.array(*map(F.lit, t)))
    return F.when(has("gold-tone", "rose-gold"), "gold").when(has("cream"), "cream").otherwise("white")
