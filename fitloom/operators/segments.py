"""Subjects of pictures: backdrop, flood from the border, components, what they enclose, geometry, and a verdict.

The flood crosses pixels near the backdrop that hang together with the border; near
pixels that it can't reach are enclosed.  Both are regions of one labelling, which
joins runs of equal rows.  A picture is bounded, so numpy takes it whole, with others of
its size, in Arrow batches; the verdict over its components is column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances of the backdrop and of the flood, least areas of a component (of the picture) and of a hole (pixels).
PROBE, FLOOD, NOISE, HOLE = 18, 10, 0.0015, 12
#: Pixels of the pictures that are labelled together.
STACK = 1 << 18
# Shares of the largest box that make a subject, of the frame that make a backdrop, and of agreement that make it seamless.
SUBJECT, HAND_SUBJECT, SIDE, SPAN, AGREEMENT = 0.3, 0.18, 0.1, 0.98, 0.9
# Aspects and fills of discs, central holes of rings, slenderness and tails of hands.
ASPECT, FILL, DIAL_HOLE, RINGS = (0.9, 1.11), (0.68, 0.92), 0.4, {"bezel_insert": (0.55, 0.93), "chapter_ring": (0.72, 0.98)}
SLENDER, TAIL, DEBRIS, COVERED, MOST_SUBJECTS, HANDS = 2.5, 0.55, 0.5, 0.95, 6, (2, 4)
ROUND_ASPECT, ROUND_FILL, NEAR_END = (0.6, 1.67), (0.55, 0.95), 0.3
FIELDS = "area min_x min_y max_x max_y n_holes".split()
MEASURES = "cx cy hole_radius theta length thickness tail_ratio pivot_x pivot_y tip_x tip_y".split()
COMPONENT = pa.struct([*[pa.field(f, pa.int64()) for f in FIELDS], *[pa.field(f, pa.float64()) for f in MEASURES], pa.field("pivot_from_hole", pa.bool_())])
_STRUCT = "struct<" + ", ".join([*[f"{f}: bigint" for f in FIELDS], *[f"{f}: double" for f in MEASURES], "pivot_from_hole: boolean"]) + ">"
SCHEMA = f"id long, width long, height long, agreement double, outside long, enclosed long, subject long, components array<{_STRUCT}>"


def backdrops(imgs: np.ndarray, tolerance: int = PROBE) -> tuple[np.ndarray, np.ndarray]:
    """Of each picture of a stack the border colour that most of the border agrees with, and how much does; the first of equals, along rows and then columns."""
    n, h, w, channels = imgs.shape
    step = max(1, min(w, h) // 100)
    sides = (imgs[:, 0, ::step], imgs[:, -1, ::step]), (imgs[:, ::step, 0], imgs[:, ::step, -1])
    border = np.concatenate([np.stack(pair, 2).reshape(n, -1, channels) for pair in sides], 1)
    agree = np.zeros(border.shape[:2], np.int64)
    for k in range(border.shape[1]):
        agree += np.abs(border - border[:, k : k + 1]).max(2) <= tolerance
    best = agree.argmax(1)
    return border[np.arange(n), best], agree[np.arange(n), best] / border.shape[1]


def regions(mask: np.ndarray) -> np.ndarray:
    """4-connected regions of a mask, numbered from 0 by their first pixel; -1 elsewhere.

    Runs of a row meet the runs of the row above that they overlap, and take the least number
    among all that hang together, twice as far in each round.
    """
    h, w = mask.shape
    out = np.full((h, w), -1, np.int64)
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, start), stop = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    if not len(row):
        return out
    run = np.repeat(np.arange(len(row)), stop - start)
    out[mask] = run
    both = mask[1:] & mask[:-1]
    links = np.stack(np.divmod(np.unique(out[1:][both] * len(row) + out[:-1][both]), len(row)), 1)  # pairs as single numbers sort fast
    root = np.arange(len(row))
    while len(links):
        a, b = root[links[:, 0]], root[links[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    _, number = np.unique(root, return_inverse=True)
    out[mask] = number[run]
    return out


def _boxes(label: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Areas, centres and boxes of labels 0 to n - 1 of a stack (pictures, height, width)."""
    _, y, x = np.nonzero(label >= 0)
    k = label[label >= 0]
    area = np.bincount(k, minlength=n)
    out = {"area": area, "cx": np.bincount(k, x, n) / np.maximum(area, 1), "cy": np.bincount(k, y, n) / np.maximum(area, 1)}
    for name, v, pick, start in (("min_x", x, np.minimum, label.shape[2]), ("min_y", y, np.minimum, label.shape[1]), ("max_x", x, np.maximum, -1), ("max_y", y, np.maximum, -1)):
        out[name] = np.full(n, start, np.int64)
        pick.at(out[name], k, v)
    return out


def _touching(holes: np.ndarray, label: np.ndarray) -> dict[int, int]:
    """Owner of each hole: the component that most sides of its pixels touch; of equals the larger component."""
    n, pairs = int(label.max()) + 1 or 1, []
    for a, b in ((np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:, :, 1:], np.s_[:, :, :-1]), (np.s_[:, :, :-1], np.s_[:, :, 1:])):
        meet = (holes[a] >= 0) & (label[b] >= 0)
        pairs.append(holes[a][meet] * n + label[b][meet])
    codes, counts = np.unique(np.concatenate(pairs), return_counts=True)
    found = np.stack(np.divmod(codes, n), 1)
    owner: dict[int, int] = {}
    for k in np.lexsort((found[:, 1], -counts)):
        owner.setdefault(int(found[k, 0]), int(found[k, 1]))
    return owner


def hand(x: np.ndarray, y: np.ndarray, cx: float, cy: float, holes: list[dict]) -> dict:
    """Axis by second moments, pivot (a round hole near an end, else within the heavier end), tip, and the mass behind the pivot against that before it."""
    dx, dy = x - cx, y - cy
    theta = 0.5 * np.arctan2(2 * (dx * dy).sum(), (dx * dx).sum() - (dy * dy).sum())
    ax, ay = np.cos(theta), np.sin(theta)
    t = dx * ax + dy * ay
    low, high, thickness = t.min(), t.max(), 2 * np.abs(dy * ax - dx * ay).mean()
    long = max(1.0, high - low)
    at = lambda s: np.array([cx + ax * s, cy + ay * s])
    along = lambda o: (o["cx"] - cx) * ax + (o["cy"] - cy) * ay
    good = [o for o in holes if min(abs(along(o) - low), abs(along(o) - high)) / long <= NEAR_END and ROUND_ASPECT[0] <= o["aspect"] <= ROUND_ASPECT[1] and ROUND_FILL[0] <= o["fill"] <= ROUND_FILL[1]]
    if good:
        pivot = np.array([good[0]["cx"], good[0]["cy"]])
    else:
        inset = min(thickness, abs(high - low) * 0.08)
        pivot = at(low + inset) if (t < 0).sum() * 2 > len(t) else at(high - inset)
    ends = at(low), at(high)
    far = [float(np.hypot(*(e - pivot))) for e in ends]
    tip = ends[0] if far[0] > far[1] else ends[1]
    toward = 1.0 if (tip - pivot) @ (ax, ay) >= 0 else -1.0
    before = int((((x - pivot[0]) * ax + (y - pivot[1]) * ay) * toward >= 0).sum())
    return {"theta": float(theta), "length": max(far), "thickness": float(thickness), "tail_ratio": (len(t) - before) / before if before else 1.0, "pivot_x": float(pivot[0]), "pivot_y": float(pivot[1]), "tip_x": float(tip[0]), "tip_y": float(tip[1]), "pivot_from_hole": bool(good)}


def _stacked(mask: np.ndarray) -> np.ndarray:
    """`regions` of each picture of a stack, numbered through all: pictures stand beneath each other with an empty row between."""
    n, h, w = mask.shape
    return regions(np.pad(mask, ((0, 0), (0, 1), (0, 0))).reshape(n * (h + 1), w)).reshape(n, h + 1, w)[:, :h]


def analyse_all(imgs: np.ndarray) -> list[tuple]:
    """`analyse` of each picture of a stack (pictures, height, width, channels), labelled and measured together."""
    n, h, w = imgs.shape[:3]
    colour, agreement = backdrops(imgs)
    near = np.abs(imgs - colour[:, None, None]).max(3) <= FLOOD
    back = _stacked(near)
    on_edge = np.zeros(int(back.max()) + 2, bool)
    for side in (back[:, 0], back[:, -1], back[:, :, 0], back[:, :, -1]):
        on_edge[side] = True
    on_edge[-1] = False  # also where the label is -1
    outside = on_edge[back]
    enclosed = near & ~outside
    raw = _stacked(~near)
    flat = raw[raw >= 0]
    sizes = np.bincount(flat)
    picture = np.zeros(len(sizes), np.int64)
    picture[flat] = np.nonzero(raw >= 0)[0]
    order = np.lexsort((-sizes, picture))  # stable, so that equal areas keep the order of their first pixels
    order = order[sizes[order] >= np.floor(NOISE * w * h + 0.5)]
    place = np.full(len(sizes) + 1, -1)
    place[order] = np.arange(len(order))
    label = place[raw]
    holes = _stacked(enclosed)
    owned: list[list[dict]] = [[] for _ in order]
    if (holes >= 0).any():
        box, owner = _boxes(holes, int(holes.max()) + 1), _touching(holes, label)
        for k in np.argsort(-box["area"], kind="stable"):
            if box["area"][k] >= HOLE and int(k) in owner:
                bw, bh = int(box["max_x"][k] - box["min_x"][k]) + 1, int(box["max_y"][k] - box["min_y"][k]) + 1
                owned[owner[int(k)]].append({"area": int(box["area"][k]), "cx": float(box["cx"][k]), "cy": float(box["cy"][k]), "radius": float(np.sqrt(box["area"][k] / np.pi)), "aspect": bw / bh, "fill": float(box["area"][k] / (bw * bh))})
    box, components = _boxes(label, len(order)), [[] for _ in range(n)]
    _, y, x = np.nonzero(label >= 0)
    by = np.argsort(label[label >= 0], kind="stable")
    y, x, ends = y[by], x[by], np.cumsum(box["area"])
    columns = {f: box[f].tolist() for f in [*FIELDS[:5], "cx", "cy"]}
    for k, (start, end) in enumerate(zip((ends - box["area"]).tolist(), ends.tolist(), strict=True)):
        one = {f: v[k] for f, v in columns.items()} | {"n_holes": len(owned[k]), "hole_radius": owned[k][0]["radius"] if owned[k] else 0.0}
        components[picture[order[k]]].append(one | hand(x[start:end], y[start:end], one["cx"], one["cy"], owned[k]))
    pixels = lambda mask: mask.sum((1, 2)).tolist()
    return list(zip(agreement.tolist(), pixels(outside), pixels(enclosed), pixels(~near), components, strict=True))


def analyse(img: np.ndarray) -> tuple:
    """(agreement, pixels outside, enclosed and of the subject, components: the largest first) of a picture (height, width, channels)."""
    return analyse_all(img[None])[0]


def _run(batches):
    for batch in batches:
        ids, width, height, pixels = (batch.column(k) for k in range(4))
        rows: list[tuple] = [(0.0, 0, 0, 0, [])] * len(ids)  # nothing that can be decoded stays so
        alike: dict[tuple, list[int]] = {}
        for k, (w, h, size) in enumerate(zip(width.to_pylist(), height.to_pylist(), pc.binary_length(pixels).to_pylist(), strict=True)):
            if w and h and size and not size % (w * h):
                alike.setdefault((h, w, size // (w * h)), []).append(k)
        for (h, w, channels), places in alike.items():
            step = max(1, STACK // (h * w))
            for start in range(0, len(places), step):
                own = places[start : start + step]
                imgs = np.stack([np.frombuffer(pixels[k].as_buffer(), np.uint8).reshape(h, w, channels)[:, :, :3] for k in own]).astype(np.int16)
                for k, found in zip(own, analyse_all(imgs), strict=True):
                    rows[k] = found
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        types = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(COMPONENT)]
        yield pa.RecordBatch.from_arrays([ids, width, height, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["id", "width", "height", "agreement", "outside", "enclosed", "subject", "components"])


def segmented(rasters: DataFrame) -> DataFrame:
    """rasters (id, width, height, pixels: bytes of one, three or four channels) to backdrop agreement, pixel counts and components.

    Cases: pixels that are null, empty or no whole number of channels have no
    component and agreement 0; a fourth channel is not read; equal areas keep the order of their first pixels.
    """
    return rasters.select(F.col("id").cast("long").alias("id"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("pixels").cast("binary").alias("pixels")).mapInArrow(_run, SCHEMA)


def _wide(c: Column) -> Column:
    return c["max_x"] - c["min_x"] + 1


def _high(c: Column) -> Column:
    return c["max_y"] - c["min_y"] + 1


def subjects(hands: Column) -> Column:
    """The components that are as big an object as the largest one, or a good part of it."""
    first = F.element_at("components", 1)
    diagonal, side = (lambda c: F.hypot(_wide(c), _high(c))), (lambda c: F.least(_wide(c), _high(c)))
    share = F.when(hands, HAND_SUBJECT).otherwise(SUBJECT)
    return F.filter("components", lambda c: (diagonal(c) >= diagonal(first) * share) & (side(c) >= side(first) * SIDE))


def shape(c: Column, width: Column, height: Column) -> Column:
    """Aspect and fill of the box, largest hole against the outer radius, and the share of the frame."""
    return F.struct((_wide(c) / _high(c)).alias("aspect"), (c["area"] / (_wide(c) * _high(c))).alias("fill"), (c["hole_radius"] / (F.greatest(_wide(c), _high(c)) / 2)).alias("hole_ratio"), (c["area"] / (width * height)).alias("coverage"))


def hand_shaped(c: Column) -> Column:
    return (c["thickness"] > 0) & (c["length"] / c["thickness"] >= SLENDER) & (c["tail_ratio"] <= TAIL)


def verdicts(found: DataFrame) -> DataFrame:
    """segmented rows with a `category` (dial, bezel_insert, chapter_ring, hands) to (id, category, n_subjects, aspect, fill, hole_ratio, coverage, n_hands, state, reason)."""
    told = found.withColumn("subjects", subjects(F.col("category") == "hands"))
    first, manual = F.get("subjects", F.lit(0)), F.lit("needs-manual")
    told = told.withColumn("shape", F.when(F.size("subjects") > 0, shape(first, F.col("width"), F.col("height")))).withColumn("hands", F.filter("subjects", hand_shaped)).withColumn("debris", F.filter("subjects", lambda c: ~hand_shaped(c)))
    spanning = F.exists("subjects", lambda c: (_wide(c) >= F.col("width") * SPAN) & (_high(c) >= F.col("height") * SPAN))
    count, n, s = F.size("subjects"), F.size("hands"), F.col("shape")
    longest = F.array_max(F.transform("hands", lambda c: c["length"]))
    hole = {k: F.col("category") == k for k in RINGS}
    low, high = (F.when(hole["bezel_insert"], RINGS["bezel_insert"][i]).when(hole["chapter_ring"], RINGS["chapter_ring"][i]) for i in (0, 1))
    hands, ring = F.col("category") == "hands", F.col("category").isin(*RINGS)
    reason = (
        F.when(F.col("agreement") < AGREEMENT, "backdrop-not-seamless").when(spanning, "two-backdrop-colours-in-one-frame").when(count == 0, "no-subject-found").when(s["coverage"] > COVERED, "no-background-separated")
        .when(hands & (count > MOST_SUBJECTS), "too-many-subjects").when(hands & (n < HANDS[0]), "fewer-than-two-hands").when(hands & (n > HANDS[1]), "too-many-hands")
        .when(hands & F.exists("debris", lambda d: d["length"] >= longest * DEBRIS), "large-shape-that-is-no-hand").when(hands & (F.size("debris") > n), "mostly-unidentifiable-shapes").when(hands, "ok")
        .when(count > 1, "multiple-subjects").when((s["aspect"] < ASPECT[0]) | (s["aspect"] > ASPECT[1]), "not-square-silhouette")
        .when(ring & (s["hole_ratio"] < low), "solid-centre").when(ring & (s["hole_ratio"] > high), "ring-too-thin")
        .when(~ring & ((s["fill"] < FILL[0]) | (s["fill"] > FILL[1])), "not-disc-shaped").when((F.col("category") == "dial") & (s["hole_ratio"] > DIAL_HOLE), "unexpected-central-hole").otherwise("ok")
    )
    told = told.withColumn("reason", reason)
    return told.select("id", "category", F.size("subjects").cast("long").alias("n_subjects"), "shape.*", F.when(hands, n).otherwise(0).cast("long").alias("n_hands"), F.when(F.col("reason") == "ok", "ready").when(F.col("reason") == "no-subject-found", "unavailable").otherwise(manual).alias("state"), "reason")
