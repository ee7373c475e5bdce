"""SQL for the rule queries: each finding as a condition, a severity and its slots.

Written apart from the column expressions, for an engine that checks them.
"""

from __future__ import annotations

from fitloom.plans.mapping import BUILD_SLOT_SQL, CATALOG_SQL, EXCEPTION_SQL, LISTING_SQL, SLOTS

# Short names of the joined parts.
A = {"movement": "mv", "case": "cs", "dial": "dl", "hands": "hd", "bezelInsert": "bi", "crystal": "cr", "chapterRing": "rg", "crown": "cw", "bezel": "bz", "strap": "st"}


def wide_sql(slots_sql: str = BUILD_SLOT_SQL) -> tuple[str, str]:
    joins = " ".join(f"LEFT JOIN parts {A[s]} ON {A[s]}.part_id = b.\"{s}\"" for s in SLOTS)
    pivot = ", ".join(f"min(CASE WHEN slot = '{s}' THEN part_id END) AS \"{s}\"" for s in SLOTS)
    return f"""WITH listing AS ({LISTING_SQL}), slot_rows AS ({slots_sql}), exc AS ({EXCEPTION_SQL}),
offers AS (SELECT part_id, count(*) AS n_offers, arg_min(vendor_id, (price_minor, vendor_id)) AS cheapest_vendor, arg_min(in_stock, (price_minor, vendor_id)) AS cheapest_in_stock, list(DISTINCT vendor_id) AS vendors FROM listing GROUP BY part_id),
parts AS (SELECT c.*, coalesce(o.n_offers, 0) AS n_offers, o.cheapest_vendor, o.cheapest_in_stock, o.vendors, nullif(regexp_extract(c.family, '^(.*)-(case|insert|crystal|chapter-ring|crown|bezel|bracelet)$', 1), '') AS plat FROM ({CATALOG_SQL}) c LEFT JOIN offers o USING (part_id)),
b AS (SELECT build_id, {pivot} FROM slot_rows GROUP BY build_id),
w AS MATERIALIZED (SELECT b.build_id, {', '.join(A[s] for s in SLOTS)} FROM b {joins})
""", "FROM w b"


def _on(*slots: str) -> str:
    return " AND ".join(f"{A[s]}.part_id IS NOT NULL" for s in slots)


def _fit(slot: str, bad: str = "error"):
    a = A[slot]
    return [(f"{_on(slot, 'case')} AND {a}.plat <> cs.plat", bad, (slot, "case")), (f"{_on(slot, 'case')} AND ({a}.plat IS NULL OR cs.plat IS NULL)", "warning", (slot, "case"))]


def _hours(x: str) -> str:
    h, m, f = (f"regexp_extract(trim({x}), '^(\\d{{1,2}})(?::(\\d{{2}})|(\\.\\d+))?$', {k})" for k in (1, 2, 3))
    frac = f"(CASE WHEN {m} <> '' THEN CAST({m} AS DOUBLE) / 60 WHEN {f} <> '' THEN CAST('0' || {f} AS DOUBLE) ELSE 0.0 END)"
    hour = f"CAST(nullif({h}, '') AS DOUBLE)"
    return f"(CASE WHEN {hour} BETWEEN 1 AND 12 AND {frac} < 1 THEN ({hour} + {frac}) % 12 END)"


def _date():
    pair, all_ = ("dial", "movement"), ("dial", "movement", "case")
    both = _on("dial", "movement")
    known = "(coalesce(mv.date_position, '') <> '' AND coalesce(cs.crown_position, '') <> '' AND dl.date_cuts IS NOT NULL)"
    cuts = [f"nullif(string_split(dl.date_cuts, ',')[{k}], '')" for k in (1, 2)]  # no dial here has more than two
    mv, crown, sold = _hours("mv.date_position"), _hours("cs.crown_position"), _hours("coalesce(mv.crown_position, '3')")
    read = f"({mv} IS NOT NULL AND {crown} IS NOT NULL AND {sold} IS NOT NULL AND " + " AND ".join(f"({c} IS NULL OR {_hours(c)} IS NOT NULL)" for c in cuts) + ")"
    landed = f"((({mv} + {crown} - {sold}) % 12 + 12) % 12)"
    near = "coalesce(" + " OR ".join(f"least(abs({_hours(c)} - {landed}) % 12, 12 - abs({_hours(c)} - {landed}) % 12) <= 0.25" for c in cuts) + ", false)"
    shown = f"{both} AND dl.has_date_window"
    return [
        (f"{both} AND NOT dl.has_date_window AND mv.has_date", "warning", pair), (f"{both} AND NOT dl.has_date_window AND mv.has_date IS NULL", "warning", pair), (f"{both} AND dl.has_date_window IS NULL", "warning", pair),
        (f"{shown} AND NOT {known} AND cs.part_id IS NOT NULL", "warning", all_), (f"{shown} AND NOT {known} AND cs.part_id IS NULL", "warning", pair),
        (f"{shown} AND {known} AND NOT {read}", "warning", all_), (f"{shown} AND {known} AND {read} AND NOT {near}", "error", all_),
    ]


def _per_slot(make) -> list:
    return [x for s in SLOTS for x in make(s, A[s])]


def conditions() -> dict[str, tuple[list, tuple]]:
    """Rule key to (findings, slots for which a family's figures decide)."""
    dm, dc, sc = ("dial", "movement"), ("dial", "case"), ("strap", "case")
    ndm = _on("dial", "movement")
    no_offer = " OR ".join(f"({A[s]}.part_id IS NOT NULL AND {A[s]}.n_offers = 0)" for s in SLOTS)
    used = f"len(list_distinct(list_filter([{', '.join(A[s] + '.cheapest_vendor' for s in SLOTS)}], lambda v: v IS NOT NULL)))"
    domed = "(coalesce(cs.double_domed, false) OR (cr.part_id IS NOT NULL AND regexp_matches(cr.name, 'double.?dome', 'i')))"
    nh34 = f"{_on('hands', 'movement')} AND mv.caliber = 'NH34'"
    strap = _on("strap", "case")
    ic = _on("bezelInsert", "crystal")
    blank = "(coalesce(bi.profile, '') = '' OR coalesce(cr.profile, '') = '')"
    nhx = f"{ndm} AND mv.family = 'nh3x-movement'"
    return {
        "movement-case-fit": ([("mv.family = 'nh3x-movement-accessory'", "error", ("movement",))], ("movement",)),
        "dial-movement-feet": ([
            (f"{ndm} AND dl.has_subdials AND mv.family NOT LIKE 'vk6x%'", "error", dm), (f"{ndm} AND NOT dl.has_subdials AND mv.family LIKE 'vk6x%'", "warning", dm), (f"{ndm} AND dl.has_subdials IS NULL", "warning", dm),
            (f"{ndm} AND NOT dl.has_feet", "warning", dm), (f"{ndm} AND dl.has_feet IS NULL", "warning", ("dial",))], dm),
        "dial-case-diameter": ([
            (f"{_on(*dc)} AND (dl.diameter_mm IS NULL OR cs.aperture_mm IS NULL)", "warning", dc), (f"{_on(*dc)} AND dl.diameter_mm > cs.aperture_mm + 0.3", "error", dc), (f"{_on(*dc)} AND cs.aperture_mm - dl.diameter_mm > 2", "warning", dc)], ()),
        "nh34-hand-stack": ([
            (f"{_on('hands', 'movement')} AND mv.caliber IS NULL", "warning", ("hands", "movement")), (f"{nh34} AND NOT coalesce(hd.gmt, false)", "warning", ("hands", "movement")),
            (f"{nh34} AND NOT {domed} AND cr.part_id IS NOT NULL", "warning", ("hands", "movement", "crystal")), (f"{nh34} AND NOT {domed} AND cr.part_id IS NULL", "warning", ("hands", "movement", "case"))], ()),
        "date-window-alignment": (_date(), ()),
        "day-window-presence": ([(f"{ndm} AND mv.has_day AND NOT dl.has_day_window", "warning", dm), (f"{ndm} AND NOT mv.has_day AND dl.has_day_window", "error", dm), (f"{ndm} AND (mv.has_day IS NULL OR dl.has_day_window IS NULL)", "warning", dm)], ()),
        "insert-case-fit": (_fit("bezelInsert"), ("bezelInsert", "case")), "crystal-case-fit": (_fit("crystal"), ("crystal", "case")), "chapter-ring-fit": (_fit("chapterRing", "warning"), ("chapterRing", "case")),
        "hand-stack-clearance": ([(f"{_on('hands', 'chapterRing')} AND hd.length_set_mm IS NULL", "warning", ("hands", "chapterRing"))], ()),
        "unverified-part": (_per_slot(lambda s, a: [(f"{a}.spec_source = 'family-inferred'", "warning", (s,)), (f"{a}.spec_source IN ('marketplace-stated', 'user-entered')", "warning", (s,))]), SLOTS),
        "lume-mismatch": ([(f"{_on('hands', 'dial')} AND (hd.lumed IS NULL OR dl.lumed IS NULL)", "info", ("hands", "dial")), (f"{_on('hands', 'dial')} AND hd.lumed <> dl.lumed", "info", ("hands", "dial"))], ()),
        "stock-availability": (_per_slot(lambda s, a: [(f"{a}.part_id IS NOT NULL AND {a}.n_offers = 0", "info", (s,)), (f"{a}.n_offers > 0 AND NOT {a}.cheapest_in_stock", "info", (s,))]), ()),
        "multi-vendor-shipping": ([(f"({no_offer})", "info", ()), (f"NOT ({no_offer}) AND {used} >= 3", "info", ())], ()),
        "bezel-case-fit": (_fit("bezel"), ("bezel", "case")), "crown-case-fit": (_fit("crown"), ("crown", "case")),
        "strap-fit": ([
            (f"{strap} AND st.family = 'generic-strap' AND st.lug_width_mm <> cs.lug_width_mm", "warning", sc), (f"{strap} AND st.family = 'generic-strap' AND (st.lug_width_mm IS NULL OR cs.lug_width_mm IS NULL)", "warning", sc),
            (f"{strap} AND st.family <> 'generic-strap' AND st.plat <> cs.plat", "error", sc), (f"{strap} AND st.family <> 'generic-strap' AND (st.plat IS NULL OR cs.plat IS NULL)", "warning", sc)], sc),
        "insert-crystal-profile-fit": ([(f"{ic} AND {blank}", "warning", ("bezelInsert", "crystal")), (f"{ic} AND NOT {blank} AND (bi.profile, cr.profile) IN (('flat', 'domed'), ('slope', 'flat'))", "error", ("bezelInsert", "crystal"))], ()),
        "dial-case-model-exclusion": ([(f"{_on(*dc)} AND list_contains(string_split(dl.excluded_cases, ','), cs.family)", "error", dc)], ("case",)),
        "requires-chapter-ring": ([("cs.requires_ring AND rg.part_id IS NULL AND dl.part_id IS NOT NULL", "error", ("case", "chapterRing", "dial"))], ()),
        "bracelet-vendor-scope": ([(f"{strap} AND st.vendor_scope IS NOT NULL AND cs.n_offers = 0", "warning", sc), (f"{strap} AND st.vendor_scope IS NOT NULL AND cs.n_offers > 0 AND NOT list_contains(cs.vendors, st.vendor_scope)", "error", sc)], ()),
        "dial-movement-size": ([(f"{nhx} AND mv.caliber LIKE 'NH7%'", "warning", dm), (f"{nhx} AND coalesce(mv.caliber, '') NOT LIKE 'NH7%' AND coalesce(mv.caliber, '') NOT IN ('NH34', 'NH35', 'NH36', 'NH38')", "warning", dm)], ()),
        "crown-stem-length": ([(_on("crown", "case"), "info", ("crown", "case"))], ()),
        "integrated-chapter-ring": ([(f"{_on('case', 'chapterRing')} AND cs.integrated_ring AND coalesce(cs.ring_excluded, false)", "error", ("case", "chapterRing")), (f"{_on('case', 'chapterRing')} AND cs.integrated_ring AND NOT coalesce(cs.ring_excluded, false)", "warning", ("case", "chapterRing"))], ()),
        "chapter-ring-unstated": ([("cs.part_id IS NOT NULL AND rg.part_id IS NULL AND NOT coalesce(cs.requires_ring, false) AND NOT coalesce(cs.integrated_ring, false)", "warning", ("case", "chapterRing"))], ()),
        "integrated-bezel": ([(f"cs.integrated_bezel AND {A[s]}.part_id IS NOT NULL", "error", ("case", s)) for s in ("bezelInsert", "bezel")], ()),
    }


VERIFIED_SQL = "'" + "','".join("bezel-case-fit bracelet-vendor-scope crown-case-fit crystal-case-fit day-window-presence dial-case-diameter dial-case-model-exclusion dial-movement-feet family-exception insert-case-fit integrated-bezel integrated-chapter-ring insert-crystal-profile-fit movement-case-fit requires-chapter-ring strap-fit".split()) + "'"


def _weak(slots, decides) -> str:
    tests = [f"coalesce({A[s]}.spec_source IN ('marketplace-stated', 'user-entered'{', ' + repr('family-inferred') if s in decides else ''}), false)" for s in slots]
    return "(" + " OR ".join(tests or ["false"]) + ")"


def findings_sql(keys: list[str] | None = None, slots_sql: str = BUILD_SLOT_SQL) -> tuple[str, str]:
    """(WITH clause, SELECT of build_id, rule_key, severity, raw_severity, tier, slots)."""
    head, source = wide_sql(slots_sql)
    rows = []
    for key, (found, decides) in conditions().items():
        if keys is None or key in keys:
            rows += [f"SELECT b.build_id, '{key}' AS rule, '{key}' AS rule_key, '{sev}' AS raw, '{','.join(slots)}' AS slots, {_weak(slots, decides)} AS weak {source} WHERE {cond}" for cond, sev, slots in found]
    if keys is None or "family-exception" in keys:
        rows += [f"SELECT b.build_id, 'family-exception' AS rule, exc.rule_key, exc.severity AS raw, '{s}' AS slots, {_weak((s,), ())} AS weak {source} JOIN exc ON exc.part_id = {A[s]}.part_id" for s in SLOTS]
    body = " UNION ALL ".join(rows)
    tier = f"CASE WHEN weak THEN 'unconfirmed' WHEN rule IN ({VERIFIED_SQL}) THEN 'verified' ELSE 'checked' END"
    return head, f"SELECT build_id, rule_key, CASE WHEN raw = 'error' AND {tier} <> 'verified' THEN 'warning' ELSE raw END AS severity, raw AS raw_severity, {tier} AS tier, slots FROM ({body}) f"
