"""Registered queries of drawn pictures, with their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.operators import segments
from fitloom.plans import mapping
from fitloom.plans.titles import choice
from fitloom.queries import query, table

N = 48
CATEGORIES = ["dial", "bezel_insert", "chapter_ring", "hands"]


def grey(x: str, y: str, k: str, s: str) -> str:
    """SQL of a pixel of the picture of part k of size s: its backdrop, its subject, and one of eleven faults.  Read by the SQL; `draw` makes whole pictures of it."""
    v, r = f"(CAST(floor({k} / 4) AS BIGINT) % 11)", f"(14 + {s} % 8)"
    back, ink = f"(250 - {k} % 3 * 2)", f"(60 + {k} % 5 * 20)"
    d2 = f"(({x} - 24) * ({x} - 24) + ({y} - 24) * ({y} - 24))"
    flat = f"(({x} - 24) * ({x} - 24) + 2 * ({y} - 24) * ({y} - 24))"
    twin = f"(least(({x} - 12) * ({x} - 12), ({x} - 36) * ({x} - 36)) + ({y} - 24) * ({y} - 24))"
    inner = f"CASE {k} % 4 WHEN 0 THEN CASE WHEN {v} = 3 THEN {r} - 6 ELSE -1 END WHEN 1 THEN {r} - 5 ELSE {r} - 3 END"
    disc = f"CASE WHEN {v} = 1 THEN {twin} <= 81 WHEN {v} = 2 THEN {flat} <= {r} * {r} AND {flat} > ({inner}) * abs({inner}) ELSE {d2} <= {r} * {r} AND {d2} > ({inner}) * abs({inner}) END"
    # Hands: up to four bars with a boss and, mostly, a hole in it.
    bar = f"CAST(floor(({x} - CAST(floor({y} * ({v} % 2) / 9) AS BIGINT) - 1) / 11) AS BIGINT)"
    dx = f"({x} - CAST(floor({y} * ({v} % 2) / 9) AS BIGINT) - 7 - 11 * {bar})"
    end = f"(26 + ({s} + 5 * {bar}) % 16)"
    boss = f"({dx} * {dx} + ({y} - {end}) * ({y} - {end}))"
    hands = f"({bar} >= 0 AND {bar} < 1 + {v} % 4 + {s} % 2 AND ((abs({dx}) <= 1 AND {y} >= 4 AND {y} <= {end}) OR {boss} <= 16) AND NOT ({v} <> 4 AND {boss} <= 4))"
    shape = f"CASE WHEN {k} % 4 = 3 THEN {hands} ELSE {disc} END"
    return (
        f"CASE WHEN {v} = 5 AND ({x} * 7 + {y} * 13) % 4 = 0 THEN 120 WHEN {v} = 6 AND (abs({x} - 24) <= 1 OR abs({y} - 24) <= 1) THEN 30 WHEN {v} = 7 AND {y} = 46 AND {x} < 6 AND {x} > 0 THEN 90 WHEN {v} = 8 THEN {back}"
        f" WHEN {v} = 4 AND abs({x} - 20) <= 2 AND abs({y} - 24) <= 2 THEN {back} - 6 WHEN {v} = 9 AND {x} > 0 THEN {ink} WHEN {v} = 10 AND {d2} <= 36 THEN {back} - 9 WHEN {shape} THEN {ink} ELSE {back} END"
    )


_P = f"SELECT p_partkey AS id, x, y, {grey('x', 'y', 'p_partkey', 'p_size')} AS g FROM part CROSS JOIN (SELECT unnest(range({N})) AS x) CROSS JOIN (SELECT unnest(range({N})) AS y)"


def draw(key: np.ndarray, size: np.ndarray, sized: np.ndarray) -> np.ndarray:
    """`grey` of whole pictures (parts, N, N) at once; a part without a size (where not `sized`) has no disc but twins, and no hands."""
    k, s = (v.astype(np.int64)[:, None, None] for v in (key, size))
    rest = lambda a, n: np.fmod(a, n).astype(np.int32)  # noqa: E731  of the sign of a, as in SQL
    known, y, x = sized[:, None, None], *np.ogrid[:N, :N]
    y, x = y[None].astype(np.int32), x[None].astype(np.int32)
    kind, v, r, back, ink = rest(k, 4), rest(k // 4, 11), 14 + rest(s, 8), 250 - rest(k, 3) * 2, 60 + rest(k, 5) * 20
    d2 = (x - 24) ** 2 + (y - 24) ** 2
    flat, twin = (x - 24) ** 2 + 2 * (y - 24) ** 2, np.minimum((x - 12) ** 2, (x - 36) ** 2) + (y - 24) ** 2
    inner = np.where(kind == 0, np.where(v == 3, r - 6, -1), np.where(kind == 1, r - 5, r - 3))
    least = inner * np.abs(inner)
    far = np.where(v == 2, flat, d2)
    shape = np.where(v == 1, twin <= 81, (far <= r * r) & (far > least) & known)
    of = (kind == 3)[:, 0, 0] & sized
    if of.any():
        own, n, bent = v[of], s[of], np.fmod(v[of], 2)
        lean = x - y * bent // 9
        bar = (lean - 1) // 11
        dx, end = lean - 7 - 11 * bar, 26 + np.fmod(n + 5 * bar, 16)
        boss = dx * dx + (y - end) ** 2
        shape[of] = (bar >= 0) & (bar < 1 + np.fmod(own, 4) + np.fmod(n, 2)) & (((np.abs(dx) <= 1) & (y >= 4) & (y <= end)) | (boss <= 16)) & ~((own != 4) & (boss <= 4))
    shape[(kind == 3)[:, 0, 0] & ~sized] = False
    out = np.where(shape, ink, back)
    faults = [
        (5, (x * 7 + y * 13) % 4 == 0, 120), (6, (np.abs(x - 24) <= 1) | (np.abs(y - 24) <= 1), 30), (7, (y == 46) & (x < 6) & (x > 0), 90), (8, x >= 0, back),
        (4, (np.abs(x - 20) <= 2) & (np.abs(y - 24) <= 2), back - 6), (9, (x > 0) & (y >= 0), ink), (10, d2 <= 36, back - 9),
    ]
    for fault, where, value in faults:
        out = np.where((v == fault) & where, value, out)
    return out.astype(np.uint8)


def _drawn(batches):
    """Some hundred parts at a time; a part without a key has an empty picture."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            ids, sizes = (batch.column(i).slice(start, 512) for i in range(2))
            key, size = (np.asarray(pc.fill_null(c.cast(pa.int64()), 0)) for c in (ids, sizes))
            made = draw(key, size, np.asarray(sizes.is_valid()))
            pixels = pa.array([p.tobytes() if known else b"" for p, known in zip(made, np.asarray(ids.is_valid()), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pixels], names=["id", "pixels"])


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, width, height, pixels): each part drawn as a grey picture, in tasks over all cores."""
    parts = mapping.spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("long").alias("p_size")), "id")
    drawn = parts.mapInArrow(_drawn, "id long, pixels binary")
    return drawn.select("id", F.expr(choice("id", CATEGORIES)).alias("category"), F.lit(N).alias("width"), F.lit(N).alias("height"), "pixels")


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_P}),
border AS (SELECT id, g, row_number() OVER (PARTITION BY id ORDER BY side, place, far) AS i FROM (
  SELECT id, g, 0 AS side, x AS place, y AS far FROM p WHERE y IN (0, {N - 1}) UNION ALL SELECT id, g, 1, y, x FROM p WHERE x IN (0, {N - 1})) e),
greys AS (SELECT id, g, count(*) AS n, min(i) AS first FROM border GROUP BY id, g),
agreed AS (SELECT a.id, a.g, a.first, sum(b.n) AS n FROM greys a JOIN greys b ON a.id = b.id AND abs(a.g - b.g) <= 18 GROUP BY ALL),
back AS (SELECT id, arg_min(g, (-n, first)) AS g, max(n) / {4 * N}.0 AS agreement FROM agreed GROUP BY id),
near AS MATERIALIZED (SELECT p.id, x, y FROM p JOIN back b ON b.id = p.id AND abs(p.g - b.g) <= 10),
reached AS (SELECT id, x, y FROM near WHERE x IN (0, {N - 1}) OR y IN (0, {N - 1}) UNION SELECT n.id, n.x, n.y FROM reached r JOIN near n ON n.id = r.id AND abs(n.x - r.x) + abs(n.y - r.y) = 1 AND n.x BETWEEN r.x - 1 AND r.x + 1),
outside AS (SELECT id, count(*) AS n FROM reached GROUP BY id), close AS (SELECT id, count(*) AS n FROM near GROUP BY id)
SELECT b.id, b.agreement::DOUBLE AS agreement, coalesce(o.n, 0)::BIGINT AS outside, (c.n - coalesce(o.n, 0))::BIGINT AS enclosed, ({N * N} - c.n)::BIGINT AS subject FROM back b JOIN close c USING (id) LEFT JOIN outside o USING (id)""")
def subject_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backdrop agreement and the pixels outside, enclosed and of the subject, by a flood from the border."""
    return segments.segmented(pictures(spark, sf_dir)).select("id", "agreement", "outside", "enclosed", "subject")


@query()
def component_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component: box, holes that it owns, axis, pivot, tip and tail."""
    return segments.segmented(pictures(spark, sf_dir)).select("id", F.posexplode("components").alias("place", "c")).select("id", "place", "c.*")


@query()
def picture_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part's picture can be used, and why not."""
    return segments.verdicts(segments.segmented(pictures(spark, sf_dir)).withColumn("category", F.expr(choice("id", CATEGORIES))))
