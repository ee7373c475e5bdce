"""Registered queries of drawn sizes, colours, outlines, hand roles and filled attributes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.functions import drawing, text
from fitloom.ingest_queries import _tags_sql
from fitloom.operators import backfill
from fitloom.plans import mapping
from fitloom.plans.titles import TITLE_SQL, titles
from fitloom.queries import ORACLE, query, table

#: What the catalog's parts state for a drawing: (name, slot, expression).
_STATED = [
    ("case", "case", "diameter_mm + 12.0e0"), ("lugWidth", "case", "lug_width_mm"), ("aperture", "case", "aperture_mm"), ("insertOuter", "bezelInsert", "diameter_mm + 9.0e0"), ("insertInner", "bezelInsert", "aperture_mm + 9.0e0"),
    ("ringOuter", "chapterRing", "diameter_mm + 2.0e0"), ("ringInner", "chapterRing", "aperture_mm + 1.0e0"), ("crown", "crown", "lug_width_mm / 4.0e0"), ("hourHand", "hands", "length_set_mm - 4.0e0"), ("minuteHand", "hands", "length_set_mm"),
]
_SAID = ", ".join(f"max({e}) FILTER (WHERE slot = '{s}') AS s_{n}" for n, s, e in _STATED)


@query(f"""WITH w AS (SELECT b.build_id, {_SAID} FROM ({mapping.BUILD_SLOT_SQL}) b JOIN (SELECT * EXCLUDE (slot), slot AS own FROM ({mapping.CATALOG_SQL})) c USING (part_id) GROUP BY b.build_id),
 d AS (SELECT *, coalesce(s_case, 42.5e0) AS "case", coalesce(s_insertOuter, coalesce(s_case, 42.5e0) - 4.5e0) AS "insertOuter", coalesce(s_ringOuter, 30.5e0) AS "ringOuter" FROM w)
 SELECT build_id, "case", coalesce(s_lugWidth, 22.0e0) AS "lugWidth", "insertOuter", least(coalesce(s_insertInner, 31.8e0), "insertOuter" - 1) AS "insertInner", "ringOuter", least(coalesce(s_ringInner, 27.7e0), "ringOuter" - 0.6e0) AS "ringInner", coalesce(s_aperture, 28.5e0) AS aperture,
 coalesce(s_crown, 7.0e0) AS crown, coalesce(s_hourHand, 8.5e0) AS "hourHand", coalesce(s_minuteHand, 12.5e0) AS "minuteHand", 12.5e0 AS "secondHand", "case" + 3.5e0 AS "lugToLug",
 concat_ws(',', CASE WHEN s_case IS NOT NULL THEN 'case' END, CASE WHEN s_lugWidth IS NOT NULL THEN 'lugWidth' END, CASE WHEN s_insertOuter IS NOT NULL THEN 'insertOuter' END, CASE WHEN s_insertInner IS NOT NULL THEN 'insertInner' END, CASE WHEN s_ringOuter IS NOT NULL THEN 'ringOuter' END,
 CASE WHEN s_ringInner IS NOT NULL THEN 'ringInner' END, CASE WHEN s_aperture IS NOT NULL THEN 'aperture' END, CASE WHEN s_crown IS NOT NULL THEN 'crown' END, CASE WHEN s_hourHand IS NOT NULL THEN 'hourHand' END, CASE WHEN s_minuteHand IS NOT NULL THEN 'minuteHand' END) AS stated FROM d""")
def watch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn of each build, in millimetres, and which sizes its parts state."""
    fields = mapping.catalog(spark, sf_dir).select("part_id", "diameter_mm", "aperture_mm", "lug_width_mm", "length_set_mm")
    rows = mapping.build_slots(spark, sf_dir).join(fields, "part_id")
    said = rows.groupBy("build_id").agg(*[F.max(F.when(F.col("slot") == s, F.expr(e))).alias(f"s_{n}") for n, s, e in _STATED])
    return said.select("build_id", drawing.watch_sizes({n: F.col(f"s_{n}") for n, _, _ in _STATED}).alias("w")).select("build_id", "w.*")


@query(f"""WITH r AS (SELECT part_id, slot, j, diameter_mm, CASE WHEN slot IN ('case', 'bezel') THEN CASE platform WHEN 'skx013' THEN 37.8e0 ELSE 42.5e0 END WHEN slot = 'bezelInsert' THEN CASE platform WHEN 'skx013' THEN 33.0e0 ELSE 37.8e0 END WHEN slot = 'chapterRing' THEN 30.6e0
 WHEN slot = 'crystal' THEN CASE platform WHEN 'skx013' THEN 28.0e0 ELSE 31.5e0 END WHEN slot = 'hands' THEN 27.0e0 ELSE 28.5e0 END * (760.0e0 / 46) / 2 AS radius FROM ({mapping.CATALOG_SQL}))
 SELECT part_id, round(radius, 6) AS radius_px, CASE WHEN slot = 'case' THEN round(((diameter_mm + 12.0e0) / 2 - 1.65e0) * (760.0e0 / 46), 6) END AS seat_px, round(400 + radius * sin(radians((j % 12) * 30 + 7)), 6) AS x, round(400 - radius * cos(radians((j % 12) * 30 + 7)), 6) AS y FROM r""")
def drawn_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius in pixels of each part, a case's seat, and the place of a mark on the part's rim."""
    c = mapping.catalog(spark, sf_dir).select("part_id", "slot", "j", "diameter_mm", drawing.radius_px(F.col("slot"), F.col("platform")).alias("radius"))
    at = drawing.place(F.col("radius"), F.col("j") % 12 * 30 + 7)
    seat = F.when(F.col("slot") == "case", F.round(drawing.seat_px(F.col("diameter_mm") + 12.0), 6))
    return c.select("part_id", F.round("radius", 6).alias("radius_px"), seat.alias("seat_px"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS light, 1 - l_tax * 12.5e0 AS cov, l_quantity / 50 AS u, l_extendedprice / 110000 AS v FROM lineitem),
 q AS (SELECT *, CASE WHEN cov > 0 THEN CAST(floor(greatest(0, least(1, u * cov / cov)) * 4095 + 0.5) AS INTEGER) ELSE 0 END AS a, CASE WHEN cov > 0 THEN CAST(floor(greatest(0, least(1, v * cov / cov)) * 4095 + 0.5) AS INTEGER) ELSE 0 END AS b, greatest(0, least(1, light)) AS l FROM p),
 c AS (SELECT *, CAST(floor(greatest(0, least(1, CASE WHEN l <= 0.0031308 THEN 12.92 * l ELSE 1.055 * pow(l, 1 / 2.4e0) - 0.055 END)) * 255 + 0.5) AS INTEGER) AS code FROM q)
 SELECT l_orderkey, l_linenumber, code, round(CASE WHEN code / 255.0e0 <= 0.04045 THEN code / 255.0e0 / 12.92 ELSE pow((code / 255.0e0 + 0.055) / 1.055, 2.4) END, 6) AS light, concat_ws(',', a >> 4, ((a & 15) << 4) | (b >> 8), b & 255, CAST(floor(greatest(0, least(1, cov)) * 255 + 0.5) AS INTEGER)) AS uv FROM c""")
def pixel_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light as a byte and back, and places in a print as four bytes; a line of an order is a pixel."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("light"), (1 - F.col("l_tax") * 12.5).alias("cov"), (F.col("l_quantity") / 50).alias("u"), (F.col("l_extendedprice") / 110000).alias("v"))
    uv = drawing.packed_uv(F.col("u") * F.col("cov"), F.col("v") * F.col("cov"), F.col("cov"))
    coded = p.select("l_orderkey", "l_linenumber", drawing.coded(F.col("light")).alias("code"), F.array_join(uv, ",").alias("uv"))
    return coded.select("l_orderkey", "l_linenumber", "code", F.round(drawing.linear(F.col("code") / 255.0), 6).alias("light"), "uv")


@query("""WITH p AS (SELECT p_partkey, p_size / 10.0e0 AS s, (p_partkey % 53) / 10.0e0 - 0.53e0 AS x, (floor(p_partkey / 53) % 41) / 10.0e0 - 0.47e0 AS y FROM part),
 k AS (SELECT * FROM (VALUES (0, 0.0e0, 0.0e0, 4.0e0, 0.0e0), (1, 4.0e0, 0.0e0, 4.0e0, 1.0e0), (2, 4.0e0, 1.0e0, 1.0e0, 1.0e0), (3, 1.0e0, 1.0e0, 1.0e0, 3.0e0), (4, 1.0e0, 3.0e0, 0.0e0, 3.0e0), (5, 0.0e0, 3.0e0, 0.0e0, 0.0e0)) v(i, ax, ay, kx, ky)),
 e AS (SELECT p_partkey, x, y, i, ax * s AS ax, ay * s AS ay, (kx - ax) * s AS ex, (ky - ay) * s AS ey, ky * s AS b_y FROM p CROSS JOIN k),
 t AS (SELECT *, greatest(0, least(1, ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey))) AS t FROM e),
 d AS (SELECT p_partkey, any_value(x) AS x, any_value(y) AS y, sqrt(min(pow(x - ax - ex * t, 2) + pow(y - ay - ey * t, 2))) AS d, count(*) FILTER (WHERE (ay > y) <> (b_y > y) AND x - ax < ex * (y - ay) / ey) % 2 = 1 AS inside FROM t GROUP BY p_partkey),
 g AS (SELECT p_partkey, CASE WHEN inside THEN -d ELSE d END AS d, sqrt(x * x + y * y) - 1.5e0 AS c, greatest(0, least(1, (x - 1) / 2)) AS w FROM d)
 SELECT p_partkey, round(d, 6) AS distance, round(CASE WHEN abs(c - d) >= 0.8e0 THEN least(c, d) ELSE least(c, d) - pow(0.8e0 - abs(c - d), 2) / 3.2e0 END, 6) AS outline, round(3 * w * w - 2 * w * w * w, 6) AS shoulder FROM g""")
def outline_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distances of a point a part to an outline: a corner piece, the same joined with a disc, and a soft shoulder."""
    p = mapping.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", (F.col("p_size") / 10.0).alias("s"), (F.col("p_partkey") % 53 / 10.0 - 0.53).alias("x"), (F.floor(F.col("p_partkey") / 53) % 41 / 10.0 - 0.47).alias("y"))
    corners = F.array(*[F.struct((F.col("s") * a).alias("x"), (F.col("s") * b).alias("y")) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0))])
    d = p.select("p_partkey", "x", (F.hypot("x", "y") - 1.5).alias("c"), drawing.polygon_distance(F.col("x"), F.col("y"), corners).alias("d"))
    return d.select("p_partkey", F.round("d", 6).alias("distance"), F.round(drawing.smooth_min(F.col("c"), F.col("d"), 0.8), 6).alias("outline"), F.round(drawing.smoothstep(1.0, 3.0, F.col("x")), 6).alias("shoulder"))


@query("""WITH h AS (SELECT *, l_quantity AS length, l_tax * 100 AS thickness, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), s AS (SELECT *, n >= 3 AND row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN thickness > 0 THEN length / thickness ELSE 0 END DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) = 1 AS second FROM h)
 SELECT l_orderkey, l_linenumber, length, thickness, CASE WHEN second THEN 'second' ELSE CASE row_number() OVER (PARTITION BY l_orderkey, second ORDER BY length DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) WHEN 1 THEN 'minute' WHEN 2 THEN 'hour' ELSE 'extra' END END AS role FROM s""")
def hand_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of hands by slenderness and length; an order is a picture and its lines are hands."""
    h = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", F.col("l_quantity").alias("length"), (F.col("l_tax") * 100).alias("thickness"))
    return backfill.hand_roles(h, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax").select("l_orderkey", "l_linenumber", "length", "thickness", "role")


@query(f"""WITH t AS ({TITLE_SQL}), g AS (SELECT part_id, category, string_split({_tags_sql('title', 'category')}, ',') AS tags FROM t)
 SELECT part_id, CASE g.category WHEN 'bezel_insert' THEN CASE WHEN list_contains(tags, 'blue') THEN 'blue' WHEN list_has_any(tags, ['gold-tone', 'rose-gold']) THEN 'gold' WHEN list_contains(tags, 'silver-tone') THEN 'steel' ELSE 'black' END
 WHEN 'chapter_ring' THEN CASE WHEN list_has_any(tags, ['gold-tone', 'rose-gold']) THEN 'gold' WHEN list_contains(tags, 'cream') THEN 'cream' ELSE 'white' END END AS print, CASE WHEN slot = 'case' THEN CASE WHEN integrated_ring THEN 'integrated' WHEN requires_ring THEN 'required' ELSE 'unstated' END END AS ring
 FROM g JOIN ({mapping.CATALOG_SQL}) c USING (part_id)""")
def part_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The print of each insert and ring by its colours, and what each case says about a ring."""
    tags = text.style_tags(F.col("title"), F.col("category"))
    t = titles(spark, sf_dir).select("part_id", F.when(F.col("category") == "bezel_insert", drawing.insert_print(tags)).when(F.col("category") == "chapter_ring", drawing.ring_print(tags)).alias("print"))
    c = mapping.catalog(spark, sf_dir).select("part_id", F.when(F.col("slot") == "case", drawing.ring_status(F.col("integrated_ring"), F.col("requires_ring"))).alias("ring"))
    return t.join(c, "part_id")


_STATES = """SELECT t.part_id, t.category, CASE WHEN t.category = 'dial' THEN CASE t.j % 5 WHEN 0 THEN 'nh3x-dial-standard' WHEN 1 THEN 'nh34-gmt-dial' WHEN 2 THEN 'nh3x-dial-feetless' WHEN 3 THEN 'vk6x-dial' ELSE 'unknown' END WHEN t.category = 'case' AND t.j % 11 = 0 THEN 'srp-turtle-case' ELSE c.family END AS family,
 CASE WHEN t.category = 'case' AND t.j % 2 = 0 THEN concat('NMK9', lpad(CAST(t.j % 70 AS STRING), 2, '0'), ' ', ending) WHEN t.category = 'case' AND t.j % 3 = 0 THEN concat(title, ' Square Watch Case - 38mm 3 o''clock NCG double domed') WHEN t.category = 'strap' AND t.j % 3 = 0 THEN concat('Jubilee Bracelet 20/16mm ', title) WHEN t.category = 'movement' AND t.j % 4 = 0 THEN concat(title, ' Date @ 6H') ELSE title END AS title"""


@query(f"""WITH t AS ({TITLE_SQL}), f AS ({_STATES} FROM t JOIN ({mapping.CATALOG_SQL}) c ON c.part_id = t.part_id), y AS (SELECT *, lower(title) AS x, category = 'case' AS k, category = 'movement' AS m, category = 'dial' AS d, nullif(upper(regexp_extract(title, '\\b(NH(?:3[4568]|7[012]))(?:A?\\b)', 1, 'i')), '') AS cal FROM f)
 SELECT part_id, CASE WHEN k THEN coalesce(CAST(nullif(regexp_extract(title, '(?:^|[^\\w.])(\\d{{2}}(?:\\.\\d)?)\\s*mm\\b', 1, 'i'), '') AS DOUBLE), CASE family WHEN 'skx007-case' THEN 42.5e0 WHEN 'skx013-case' THEN 37.8e0 WHEN 'srpe-case' THEN 43.8e0 WHEN 'srp-turtle-case' THEN 44.3e0 END) END AS case_mm,
 CASE WHEN k THEN CASE WHEN family IN ('skx007-case', 'srpe-case', 'srp-turtle-case') THEN 22.0e0 WHEN family = 'skx013-case' THEN 20.0e0 END WHEN category = 'strap' THEN CAST(nullif(concat(regexp_extract(title, '(\\d{{2}})\\s*/\\s*\\d{{2}}\\s*mm|\\b(\\d{{2}})\\s*mm\\b', 1, 'i'), regexp_extract(title, '(\\d{{2}})\\s*/\\s*\\d{{2}}\\s*mm|\\b(\\d{{2}})\\s*mm\\b', 2, 'i')), '') AS DOUBLE) END AS lug_mm,
 CASE WHEN family IN ('skx007-case', 'skx013-case', 'srpe-case', 'srp-turtle-case') AND k THEN 28.5e0 END AS aperture_mm, CASE WHEN k THEN CASE family WHEN 'skx007-case' THEN 31.5e0 WHEN 'skx013-case' THEN 28.0e0 END END AS crystal_mm, CASE WHEN k AND regexp_matches(x, 'double.?dome') THEN true END AS double_domed,
 CASE WHEN k AND regexp_matches(x, 'ultra thin|\\[nh34-ready\\]|watch case - 3[689]mm|(datejust|gs|gs diver|explorer|seikonaut) watch case') THEN true END AS requires_ring, CASE WHEN k AND regexp_extract(title, '^NMK(\\d+)\\b', 1) IN ('912', '926', '931', '936', '937', '938', '939', '940', '941', '945', '948', '949', '950', '952', '953', '955', '958', '963') THEN true END AS integrated_ring,
 CASE WHEN k AND regexp_extract(title, '^NMK(\\d+)\\b', 1) = '941' THEN true END AS ring_excluded, CASE WHEN k AND regexp_extract(title, '^NMK(\\d+)\\b', 1) IN ('926', '931', '936', '937', '938', '952', '955', '958') THEN true END AS integrated_bezel,
 CASE WHEN NOT k THEN NULL WHEN regexp_matches(x, '\\bb&r\\b|\\bsquare\\b') THEN 'square' WHEN regexp_matches(x, 'nautilus|royal oak') THEN 'octagonal' WHEN regexp_matches(x, '\\btuna\\b') THEN 'shrouded' WHEN contains(x, 'turtle') THEN 'cushion' END AS outline, CASE WHEN k AND regexp_matches(x, '3 ?o''?clock|\\b3h\\b') THEN true END AS crown_at_three, CASE WHEN k AND regexp_matches(x, 'no crown guard|\\bncg\\b') THEN true END AS no_crown_guard,
 CASE WHEN d AND family IN ('nh3x-dial-standard', 'nh34-gmt-dial', 'nh3x-dial-feetless') THEN 28.5e0 END AS dial_mm, CASE WHEN d AND family <> 'unknown' THEN family <> 'nh3x-dial-feetless' END AS has_feet, CASE WHEN d AND family <> 'unknown' THEN family = 'vk6x-dial' END AS has_subdials,
 CASE WHEN NOT d THEN NULL WHEN regexp_matches(x, 'day[\\s\\-/]?date') THEN true WHEN contains(x, 'no date') THEN false WHEN regexp_matches(x, '\\bdate\\b') THEN true END AS has_date_window, CASE WHEN NOT d THEN NULL WHEN regexp_matches(x, 'day[\\s\\-/]?date') THEN true WHEN regexp_matches(x, '\\bdate\\b') THEN false END AS has_day_window,
 CASE WHEN category NOT IN ('dial', 'hands') THEN NULL WHEN contains(x, 'no lume') THEN false WHEN regexp_matches(x, 'lume|bgw9|c3|luminous') THEN true END AS lumed, CASE WHEN category IN ('bezel_insert', 'crystal', 'strap', 'chapter_ring', 'crown', 'bezel') THEN a.material END AS material,
 CASE WHEN category NOT IN ('bezel_insert', 'crystal', 'strap') THEN NULL WHEN contains(x, 'domed') OR regexp_matches(x, 'double.?dome') THEN 'domed' WHEN regexp_matches(x, '\\bsloped?\\b') THEN 'slope' WHEN regexp_matches(x, '\\bflat\\b') THEN 'flat' END AS profile,
 CASE WHEN category = 'strap' AND regexp_matches(x, '^(oyster|settimo|president|jubilee|gs|super engineer|beads of rice|milanese) bracelet \\d+/\\d+mm') THEN 'luciusatelier' END AS vendor_scope, CASE WHEN m THEN cal END AS caliber, CASE WHEN m AND cal LIKE 'NH3%' THEN cal = 'NH36' END AS has_day, CASE WHEN m AND cal LIKE 'NH3%' THEN cal <> 'NH38' END AS has_date,
 CASE WHEN m AND contains(x, 'date @ 6h') THEN '6' END AS date_position, CASE WHEN m AND cal LIKE 'NH3%' THEN 5.32e0 END AS height_mm,
 CASE WHEN k THEN CASE WHEN family IN ('skx007-case', 'srpe-case', 'srp-turtle-case') THEN '3.8' END WHEN m THEN nullif(concat(regexp_extract(title, '\\((\\d(?:\\.\\d)?) o''clock crown case\\)', 1, 'i'), regexp_extract(title, '@ (\\d)H Crown', 1, 'i')), '') END AS crown_position
 FROM y JOIN ({ORACLE["listing_attributes"]}) a USING (part_id)""")
def attribute_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of every part by its family's constants and its title."""
    c = mapping.catalog(spark, sf_dir).select("part_id", "family")
    t = titles(spark, sf_dir).alias("t").join(c.alias("c"), "part_id")
    family = F.when(F.col("category") == "dial", F.element_at(F.array(*map(F.lit, ("nh3x-dial-standard", "nh34-gmt-dial", "nh3x-dial-feetless", "vk6x-dial", "unknown"))), (F.col("j") % 5 + 1).cast("int"))).when((F.col("category") == "case") & (F.col("j") % 11 == 0), "srp-turtle-case").otherwise(F.col("family"))
    case, title = F.col("category") == "case", F.col("title")
    put = F.when(case & (F.col("j") % 2 == 0), F.concat(F.lit("NMK9"), F.lpad((F.col("j") % 70).cast("string"), 2, "0"), F.lit(" "), "ending")).when(case & (F.col("j") % 3 == 0), F.concat(title, F.lit(" Square Watch Case - 38mm 3 o'clock NCG double domed")))
    put = put.when((F.col("category") == "strap") & (F.col("j") % 3 == 0), F.concat(F.lit("Jubilee Bracelet 20/16mm "), title)).when((F.col("category") == "movement") & (F.col("j") % 4 == 0), F.concat(title, F.lit(" Date @ 6H"))).otherwise(title)
    return backfill.backfilled(t.select("part_id", "category", family.alias("family"), put.alias("title")))
