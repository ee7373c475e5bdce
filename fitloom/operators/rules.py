"""Compatibility rules as column expressions over wide build rows.

A wide row has a struct for each slot (null where the slot is empty) and `n_parts`.
Unknown attributes warn; they never pass and never block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions.clock import clock_gap, hours
from fitloom.plans.mapping import SLOTS

ERROR, WARNING, INFO = "error", "warning", "info"

#: Suffixes of a family name before which its platform stands, in the order they are tried.
PLATFORM_SUFFIX = "case|insert|crystal|chapter-ring|crown|bezel|bracelet"


@dataclass(frozen=True)
class Rule:
    key: str
    findings: Callable[[], list[Finding]]
    family_decides: tuple[str, ...] = ()


def part(slot: str, field: str | None = None) -> Column:
    return F.col(f"p_{slot}") if field is None else F.col(f"p_{slot}")[field]


def has(*slots: str) -> Column:
    found = F.lit(True)
    for s in slots:
        found = found & part(s).isNotNull()
    return found


def is_(column: Column, value: bool) -> Column:
    return column.eqNullSafe(F.lit(value))


class Finding(NamedTuple):
    when: Column
    severity: str | Column
    slots: list[str]
    text: Column | str
    fix: str | None = None

    def row(self) -> Column:
        """A struct, null where the finding does not hold."""
        level = F.lit(self.severity) if isinstance(self.severity, str) else self.severity
        message = F.lit(self.text) if isinstance(self.text, str) else self.text
        return F.when(self.when, F.struct(F.lit(None).cast("string").alias("own_key"), level.alias("severity"), F.array(*map(F.lit, self.slots)).cast("array<string>").alias("slots"), message.alias("message"), F.lit(self.fix).cast("string").alias("fix")))


finding = Finding


def platform(family: Column) -> Column:
    found = F.regexp_extract(family, f"^(.*)-({PLATFORM_SUFFIX})$", 1)
    return F.when(found != "", found)


def _fit(key: str, slot: str, mismatch: str = ERROR) -> Rule:
    """A part made for one case platform, against the case chosen."""

    def findings():
        ours, case = platform(part(slot, "family")), platform(part("case", "family"))
        both = has(slot, "case")
        return [
            finding(both & (ours != case), mismatch, [slot, "case"], F.concat(F.lit(f"The {slot} is made for "), ours, F.lit(" cases and this one is "), case)),
            finding(both & (ours.isNull() | case.isNull()), WARNING, [slot, "case"], f"Whether the {slot} fits this case is not stated"),
        ]

    return Rule(key, findings, (slot, "case"))


def _movement_case():
    return [finding(part("movement", "family") == "nh3x-movement-accessory", ERROR, ["movement"], "This is a spare for a movement, not a movement")]


def _dial_feet():
    both, sub, feet = has("dial", "movement"), part("dial", "has_subdials"), part("dial", "has_feet")
    chrono = part("movement", "family").startswith("vk6x")
    pair = ["dial", "movement"]
    return [
        finding(both & is_(sub, True) & ~chrono, ERROR, pair, "The dial has subdials that this movement can't drive"),
        finding(both & is_(sub, False) & chrono, WARNING, pair, "A chronograph movement behind a dial without subdials"),
        finding(both & sub.isNull(), WARNING, pair, "Whether the dial has subdials is not stated"),
        finding(both & is_(feet, False), WARNING, pair, "The dial has no feet", "Use dial dots"),
        finding(both & feet.isNull(), WARNING, ["dial"], "Whether the dial has feet is not stated"),
    ]


def _dial_case():
    both, d, a, pair = has("dial", "case"), part("dial", "diameter_mm"), part("case", "aperture_mm"), ["dial", "case"]
    return [
        finding(both & (d.isNull() | a.isNull()), WARNING, pair, "A diameter is not stated"),
        finding(both & (d > a + 0.3), ERROR, pair, F.format_string("The dial of %s mm does not go into an opening of %s mm", d.cast("string"), a.cast("string"))),
        finding(both & (a - d > 2), WARNING, pair, "A gap around the dial would show"),
    ]


def _hand_stack():
    both, cal = has("hands", "movement"), part("movement", "caliber")
    nh34 = both & (cal == "NH34")
    domed = is_(part("case", "double_domed"), True) | F.coalesce(part("crystal", "name").rlike("(?i)double.?dome"), F.lit(False))
    return [
        finding(both & cal.isNull(), WARNING, ["hands", "movement"], "The caliber is not stated"),
        finding(nh34 & ~is_(part("hands", "gmt"), True), WARNING, ["hands", "movement"], "The set has no fourth hand"),
        finding(nh34 & ~domed & has("crystal"), WARNING, ["hands", "movement", "crystal"], "Four hands may touch a crystal that is not double-domed"),
        finding(nh34 & ~domed & part("crystal").isNull(), WARNING, ["hands", "movement", "case"], "Four hands may touch a crystal that is not double-domed"),
    ]


def _date_window():
    both, pair, all_ = has("dial", "movement"), ["dial", "movement"], ["dial", "movement", "case"]
    window, date = part("dial", "has_date_window"), part("movement", "has_date")
    cuts = part("dial", "date_cuts")
    known = F.coalesce(part("movement", "date_position") != "", F.lit(False)) & F.coalesce(part("case", "crown_position") != "", F.lit(False)) & cuts.isNotNull()
    shown = both & is_(window, True)
    mv, crown, sold = hours(part("movement", "date_position")), hours(part("case", "crown_position")), hours(F.coalesce(part("movement", "crown_position"), F.lit("3")))
    listed = F.when(cuts == "", F.array().cast("array<string>")).otherwise(F.split(cuts, ","))
    at = F.transform(listed, hours)
    read = mv.isNotNull() & crown.isNotNull() & sold.isNotNull() & ~F.exists(at, lambda c: c.isNull())
    landed = F.pmod(mv + crown - sold, F.lit(12.0))
    near = F.exists(at, lambda c: clock_gap(c, landed) <= 0.25)
    return [
        finding(both & is_(window, False) & is_(date, True), WARNING, pair, "The movement's date is hidden"),
        finding(both & is_(window, False) & date.isNull(), WARNING, pair, "Whether the movement has a date is not stated"),
        finding(both & window.isNull(), WARNING, pair, "Whether the dial has a date window is not stated"),
        finding(shown & ~known & has("case"), WARNING, all_, "A position is not stated"),
        finding(shown & ~known & part("case").isNull(), WARNING, pair, "A position is not stated"),
        finding(shown & known & ~read, WARNING, all_, "A position can't be read"),
        finding(shown & known & read & ~near, ERROR, all_, F.concat(F.lit("The date lands at hour "), F.round(landed, 2).cast("string"), F.lit(", away from the window"))),
    ]


def _day_window():
    both, mv, dial, pair = has("dial", "movement"), part("movement", "has_day"), part("dial", "has_day_window"), ["dial", "movement"]
    return [
        finding(both & is_(mv, True) & is_(dial, False), WARNING, pair, "The movement's day is hidden"),
        finding(both & is_(mv, False) & is_(dial, True), ERROR, pair, "The dial has a day window and the movement no day"),
        finding(both & (mv.isNull() | dial.isNull()), WARNING, pair, "Whether there is a day is not stated"),
    ]


def _clearance():
    return [finding(has("hands", "chapterRing") & part("hands", "length_set_mm").isNull(), WARNING, ["hands", "chapterRing"], "The hands' length is not stated")]


def _exceptions():
    """One finding for each exception of a part, under the exception's own key; see evaluate.wide_builds."""
    return []


def _unverified():
    out = []
    for s in SLOTS:
        source = part(s, "spec_source")
        out.append(finding(source == "family-inferred", WARNING, [s], f"The {s}'s figures are those of its family"))
        out.append(finding(source.isin("marketplace-stated", "user-entered"), WARNING, [s], f"The {s}'s figures come from outside the catalog"))
    return out


def _lume():
    both, h, d, pair = has("hands", "dial"), part("hands", "lumed"), part("dial", "lumed"), ["hands", "dial"]
    return [finding(both & (h.isNull() | d.isNull()), INFO, pair, "Lume can't be confirmed"), finding(both & (h != d), INFO, pair, "One of hands and dial is lumed")]


def _stock():
    out = []
    for s in SLOTS:
        none = F.coalesce(part(s, "n_offers"), F.lit(0)) == 0
        out.append(finding(has(s) & none, INFO, [s], f"No vendor lists the {s}"))
        sold_out = has(s) & ~none & ~part(s, "cheapest_in_stock")
        out.append(finding(sold_out, INFO, [s], F.when(part(s, "any_in_stock"), F.lit("The cheapest offer is out of stock; another is not")).otherwise(F.lit("Out of stock"))))
    return out


def _vendors():
    unlisted = F.lit(False)
    for s in SLOTS:
        unlisted = unlisted | (has(s) & (F.coalesce(part(s, "n_offers"), F.lit(0)) == 0))
    used = F.array_distinct(F.array_compact(F.array(*[part(s, "cheapest_vendor") for s in SLOTS])))
    return [finding(unlisted, INFO, [], "Some parts have no vendor"), finding(~unlisted & (F.size(used) >= 3), INFO, [], F.concat(F.lit("Parcels from vendors: "), F.size(used).cast("string")))]


def _strap():
    both, pair, generic = has("strap", "case"), ["strap", "case"], part("strap", "family") == "generic-strap"
    s, c = part("strap", "lug_width_mm"), part("case", "lug_width_mm")
    ours, case = platform(part("strap", "family")), platform(part("case", "family"))
    return [
        finding(both & generic & (s != c), WARNING, pair, "Strap and lugs differ in width"),
        finding(both & generic & (s.isNull() | c.isNull()), WARNING, pair, "A width is not stated"),
        finding(both & ~generic & (ours != case), ERROR, pair, "The bracelet is made for another case"),
        finding(both & ~generic & (ours.isNull() | case.isNull()), WARNING, pair, "Whether the bracelet fits is not stated"),
    ]


def _profile():
    both, i, c, pair = has("bezelInsert", "crystal"), part("bezelInsert", "profile"), part("crystal", "profile"), ["bezelInsert", "crystal"]
    blank = F.coalesce(i == "", F.lit(True)) | F.coalesce(c == "", F.lit(True))
    clash = ((i == "flat") & (c == "domed")) | ((i == "slope") & (c == "flat"))
    return [finding(both & blank, WARNING, pair, "A profile is not stated"), finding(both & ~blank & clash, ERROR, pair, "Insert and crystal don't meet flush", "Pick profiles that belong together")]


def _exclusion():
    listed = F.coalesce(F.array_contains(F.split(part("dial", "excluded_cases"), ","), part("case", "family")), F.lit(False))
    return [finding(has("dial", "case") & listed, ERROR, ["dial", "case"], "The dial's vendor rules this case out")]


def _needs_ring():
    return [finding(is_(part("case", "requires_ring"), True) & part("chapterRing").isNull() & has("dial"), ERROR, ["case", "chapterRing", "dial"], "This case needs a chapter ring", "Add one of the case's platform")]


def _scope():
    both, scope = has("strap", "case"), part("strap", "vendor_scope")
    vendors = part("case", "vendors")
    none = F.coalesce(F.size(vendors), F.lit(0)) <= 0
    pair = ["strap", "case"]
    return [
        finding(both & scope.isNotNull() & none, WARNING, pair, "Who sells the case is not known"),
        finding(both & scope.isNotNull() & ~none & ~F.array_contains(vendors, scope), ERROR, pair, "The bracelet fits that vendor's own case alone"),
    ]


def _dial_movement():
    both = has("dial", "movement") & (part("movement", "family") == "nh3x-movement")
    cal, pair = part("movement", "caliber"), ["dial", "movement"]
    fits = F.coalesce(cal.isin("NH34", "NH35", "NH36", "NH38"), F.lit(False))
    small = F.coalesce(cal.startswith("NH7"), F.lit(False))
    return [finding(both & small, WARNING, pair, "This caliber takes another dial"), finding(both & ~fits & ~small, WARNING, pair, "Which dial this caliber takes is not known")]


def _integrated_ring():
    hit = has("case", "chapterRing") & is_(part("case", "integrated_ring"), True)
    return [finding(hit, F.when(is_(part("case", "ring_excluded"), True), F.lit(ERROR)).otherwise(F.lit(WARNING)), ["case", "chapterRing"], "The case has a ring of its own")]


def _ring_unstated():
    open_ = has("case") & part("chapterRing").isNull() & ~is_(part("case", "requires_ring"), True) & ~is_(part("case", "integrated_ring"), True)
    return [finding(open_, WARNING, ["case", "chapterRing"], "Whether the case needs a chapter ring is not stated")]


def _integrated_bezel():
    fixed = is_(part("case", "integrated_bezel"), True)
    return [finding(fixed & has(s), ERROR, ["case", s], f"The case's bezel is fixed, so no {s} goes on it") for s in ("bezelInsert", "bezel")]


def _stem():
    return [finding(has("crown", "case"), INFO, ["crown", "case"], "The stem must be cut to length")]


RULES: tuple[Rule, ...] = (
    Rule("movement-case-fit", _movement_case, ("movement",)),
    Rule("dial-movement-feet", _dial_feet, ("dial", "movement")),
    Rule("dial-case-diameter", _dial_case),
    Rule("nh34-hand-stack", _hand_stack),
    Rule("date-window-alignment", _date_window),
    Rule("day-window-presence", _day_window),
    _fit("insert-case-fit", "bezelInsert"),
    _fit("crystal-case-fit", "crystal"),
    _fit("chapter-ring-fit", "chapterRing", WARNING),
    Rule("hand-stack-clearance", _clearance),
    Rule("family-exception", _exceptions),
    Rule("unverified-part", _unverified, SLOTS),
    Rule("lume-mismatch", _lume),
    Rule("stock-availability", _stock),
    Rule("multi-vendor-shipping", _vendors),
    _fit("bezel-case-fit", "bezel"),
    _fit("crown-case-fit", "crown"),
    Rule("strap-fit", _strap, ("strap", "case")),
    Rule("insert-crystal-profile-fit", _profile),
    Rule("dial-case-model-exclusion", _exclusion, ("case",)),
    Rule("requires-chapter-ring", _needs_ring),
    Rule("bracelet-vendor-scope", _scope),
    Rule("dial-movement-size", _dial_movement),
    Rule("crown-stem-length", _stem),
    Rule("integrated-chapter-ring", _integrated_ring),
    Rule("chapter-ring-unstated", _ring_unstated),
    Rule("integrated-bezel", _integrated_bezel),
)

# Rules whose errors have been confirmed and so may block.
VERIFIED = frozenset(
    "bezel-case-fit bracelet-vendor-scope crown-case-fit crystal-case-fit day-window-presence dial-case-diameter dial-case-model-exclusion dial-movement-feet family-exception "
    "insert-case-fit integrated-bezel integrated-chapter-ring insert-crystal-profile-fit movement-case-fit requires-chapter-ring strap-fit".split()
)
