"""Facts that a listing states, as column expressions: link, slot, sizes, scope, family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions import text as T

# Marketplaces whose listings may be added, and how a single listing's path looks there.
EBAY = ["com", "co.uk", "de", "fr", "it", "es", "nl", "be", "at", "ch", "ie", "ca", "com.au", "pl"]
ALI = ["", "www.", "m.", "de.", "fr.", "es.", "it.", "nl.", "pl.", "pt.", "ja.", "ko."]
EBAY_PATH, ALI_PATH = r"^/itm/(?:[^/]+/)?(\d{9,15})/?$", r"^/item/(\d{6,20})\.html$"

# Words for goods of other makes, and for other case models, which matter only to parts that follow a case.
OTHER_MAKES = [("miyota", r"\bmiyota\b"), ("orient", r"\borient\b"), ("tool", r"\btweezers?\b|\bbergeon\b|\bscrewdriver|\bhand.?press|\bcase.?opener|\bmovement holder"), ("kit", r"\bdiy watchmaking kit\b"), ("gasket", r"\bgasket\b")]
OTHER_CASES = [("ssk023", r"\bssk023\b"), ("snxs", r"\bsnxs\b"), ("sumo", r"\bsumo\b"), ("mm300", r"\bmm300\b"), ("samurai", r"\bsamurai\b"), ("sea urchin", r"\burchin\b|\bsnzf\b"), ("62mas", r"\b62mas\b"), ("mako or ray", r"\bmako\b|\bray\b")]
CASE_SHAPED = ("case", "crown", "bezel", "bezel_insert", "strap", "crystal", "chapter_ring")

# Spare parts of a movement, cases' backs, and components that are sold by themselves.
SPARE = r"(?i)day.?wheel|date.?wheel|\brotor\b|\bbridge\b|corrector|\bwheel\b|washer|\bscrews?\b|\bbarrel\b|mainspring|\bc clip\b|\bsnap\b|\bspacer\b|\bpinion\b|\bgasket\b|movement stem|\bstem\b|holding spacer"
CASE_PART, HAND_CAP, ONE_HAND, OTHER_MOVEMENT = r"(?i)caseback|case back|gasket|tube|bezel|insert|ring|spacer", r"(?i)\bcap\b", r"(?i)\b(seconds?|gmt) hand\b(?!s)", r"(?i)\bgmt\b|\bnh34\b|\bchrono|\bvk\d*\b"
VENDOR_PREFIX = r"^(Namoki|DLW|Watch & Style|Lucius Atelier) "

# The words that name a slot, in order of precedence.
SLOT_WORDS = [
    ("bezelInsert", r"\bbezel insert\b|\binsert\b"), ("chapterRing", r"\bchapter ring\b|\brehaut\b"), ("bezel", r"\bbezel\b(?! insert)"), ("crystal", r"\bcrystal\b|\bsapphire glass\b"), ("crown", r"(?<!o'?clock |\dh )\bcrown\b(?! (?:at|@|position)\b)"),
    ("hands", r"\bhands?\b"), ("dial", r"\bdial\b"), ("movement", r"\bmovement\b"), ("case", r"\bcase\b"), ("strap", r"\bstrap\b|\bbracelet\b|\bband\b"),
]
CATEGORY = {"movement": "movement", "case": "case", "dial": "dial", "hands": "hands", "bezelInsert": "bezel_insert", "bezel": "bezel", "crystal": "crystal", "chapterRing": "chapter_ring", "crown": "crown", "strap": "strap"}
SUFFIX = {"case": "case", "bezelInsert": "insert", "crystal": "crystal", "chapterRing": "chapter-ring", "crown": "crown", "bezel": "bezel", "strap": "bracelet"}

# Sizes that a title ties to one part, with their bounds.
TITLE_SIZES = {
    "caseDiameterMm": (r"(?i)(?<![\w.])(\d{2}(?:\.\d)?)\s*mm\s+(?:watch\s+)?case\b|\bcase\s+(?:size|diameter)?:?\s*(\d{2}(?:\.\d)?)\s*mm\b", 30, 50), "diameterMm": (r"(?i)(?<![\w.])(\d{2}(?:\.\d)?)\s*mm\s+dial\b|\bdial\s+(?:size|diameter):?\s*(\d{2}(?:\.\d)?)\s*mm\b", 20, 40),
    "outerDiameterMm": (r"(?i)(?<![\w.])(\d{2}(?:\.\d)?)\s*mm\s+(?:\w+\s+)?(?:bezel\s+)?insert\b()", 28, 45), "lugWidthMm": (r"(?i)\blug\s+width:?\s*(\d{2})\s*mm\b|(?<![\w.])(\d{2})\s*mm\s+(?:[a-z]+\s+){0,2}(?:lugs?|strap|band|bracelet)\b", 10, 30),
}
CALIBERS = r"(?i)(?<![\w.])(NH(?:3[4568]|7[012])|VK6[34])A?(?!\w)"


def _text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def listing_link(raw: Column) -> Column:
    """(platform, item_id, problem) of a marketplace link; nothing but the exact hosts and a single listing's path is taken."""
    url = F.trim(raw)
    part = lambda name: F.try_parse_url(url, F.lit(name))
    host, path = F.lower(F.regexp_replace(F.coalesce(part("HOST"), F.lit("")), r":\d+$", "")), F.coalesce(part("PATH"), F.lit(""))
    ebay, ali = host.isin([f"{s}ebay.{t}" for t in EBAY for s in ("", "www.", "m.")]), host.isin([f"{s}aliexpress.{t}" for s in ALI for t in ("com", "us")])
    item = F.when(ebay, F.regexp_extract(path, EBAY_PATH, 1)).when(ali, F.regexp_extract(path, ALI_PATH, 1)).otherwise("")
    extra = part("USERINFO").isNotNull() | F.coalesce(part("AUTHORITY"), F.lit("")).rlike(r":\d+$")
    problem = (
        F.when(part("PROTOCOL").isNull() | (host == ""), "not a link").when(~F.lower(part("PROTOCOL")).isin("http", "https"), "not a web link").when(extra, "extra parts")
        .when(~(ebay | ali), "other shop").when(item == "", "not a single listing")
    )
    return F.struct(F.when(problem.isNull(), F.when(ebay, "ebay").otherwise("aliexpress")).alias("platform"), F.when(problem.isNull(), item).alias("item_id"), problem.alias("problem"))


def case_model(text: Column) -> Column:
    """Platform that a lower-case text names; the first in order."""
    return (
        F.when(text.rlike(r"\bssk\b") & ~text.contains("ssk023"), "ssk-gmt").when(text.contains("srpe"), "srpe").when(text.contains("skx013"), "skx013")
        .when(text.contains("skx007") | text.contains("srpd"), "skx007").when(text.contains("turtle"), "srp-turtle")
    )


def is_caseback(title: Column) -> Column:
    return title.rlike("(?i)case ?back") & ~title.rlike("(?i)with case ?back")


def is_spare(title: Column) -> Column:
    return title.rlike(SPARE)


def out_of_scope(text: Column, category: Column) -> Column:
    """Why a lower-case text speaks of goods out of scope; null if it does not."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in OTHER_MAKES], *[F.when(category.isin(*CASE_SHAPED) & text.rlike(p), F.lit(name)) for name, p in OTHER_CASES])


def lumed(title: Column, tags: Column) -> Column:
    blob = F.lower(F.concat(title, F.lit(" "), tags))
    return F.when(blob.contains("no lume"), False).when(blob.rlike("lume|bgw9|c3|luminous"), True)


def movement_crown(title: Column) -> Column:
    pattern = r"(?i)\((\d(?:\.\d)?) o'clock crown case\)|@ (\d)H Crown"
    return _text(F.concat(F.regexp_extract(title, pattern, 1), F.regexp_extract(title, pattern, 2)))


def is_case_component(name: Column) -> Column:
    """A part of a case and no case; a name that names a case is one, whatever else it lists."""
    return name.rlike(CASE_PART) & ~F.regexp_replace(name, r"(?i)\(with case ?back\)", "").rlike(r"(?i)\bcase\b(?!\s*back)")


def is_hand_component(name: Column) -> Column:
    return name.rlike(HAND_CAP) | (name.rlike(ONE_HAND) & ~name.contains("+"))


def for_other_movement(name: Column) -> Column:
    return name.rlike(OTHER_MOVEMENT)


def eligible(category: Column, name: Column, caliber: Column, crown: Column) -> Column:
    """Whether a first build may be offered the part."""
    return (
        F.when(category == "case", ~is_case_component(name)).when(category == "hands", ~is_hand_component(name) & ~for_other_movement(name)).when(category == "dial", ~for_other_movement(name))
        .when(category == "movement", F.coalesce(caliber.isin("NH35", "NH36"), F.lit(False)) & crown.isNull()).otherwise(True)
    )


def slot_of(title: Column) -> Column:
    """The one slot that a title names; null if it names none or several."""
    t = F.regexp_replace(F.lower(title), r"\s+", " ")
    named = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(s)) for s, p in SLOT_WORDS]))
    single = lambda n: F.when(F.size(n) == 1, F.element_at(n, 1))
    return T.once(T.once(named, lambda n: F.when(F.array_contains(n, "bezelInsert"), F.array_remove(n, "bezel")).otherwise(n)), single)


def title_size(title: Column, field: str) -> Column:
    pattern, low, high = TITLE_SIZES[field]
    value = F.concat(F.regexp_extract(title, pattern, 1), F.regexp_extract(title, pattern, 2)).try_cast("double")
    return F.when(value.between(low, high), value)


def calibers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CALIBERS), F.lit(1)), F.upper))


def family_for(slot: Column, text: Column, has_feet: Column, movements: Column, known: list[str]) -> Column:
    """Family by the one case model or the calibers that a lower-case text names, if the catalog has it; else `unknown`."""
    category = F.coalesce(*[F.when(slot == s, F.lit(c)) for s, c in CATEGORY.items()])
    models = F.array_distinct(F.array_compact(F.transform(F.split(text, r"[\s,/|&+()]+"), case_model)))
    suffix = F.coalesce(*[F.when(slot == s, F.lit(x)) for s, x in SUFFIX.items()])
    nh, vk = (((F.size(movements) > 0) & F.forall(movements, lambda m: m.startswith(p))) for p in ("NH", "VK"))
    by_model = lambda m: F.when(F.size(m) == 1, F.concat_ws("-", F.element_at(m, 1), suffix)).when((slot == "strap") & (F.size(m) == 0) & text.rlike(r"\bstrap\b"), "generic-strap")
    found = (
        F.when(slot.isin(*SUFFIX), T.once(models, by_model)).when(slot == "movement", F.when(nh, "nh3x-movement").when(vk, "vk6x-movement"))
        .when(slot == "dial", F.when(nh & (~F.coalesce(has_feet, F.lit(True))), "nh3x-dial-feetless").when(nh, "nh3x-dial-standard").when(vk, "vk6x-dial")).when(slot == "hands", F.when(nh, "nh3x-hands-standard").when(vk, "vk6x-hands"))
    )
    good = F.when(slot.isNotNull() & out_of_scope(text, category).isNull(), found)
    return T.once(good, lambda f: F.when(F.coalesce(f.isin(*known), F.lit(False)), f).otherwise("unknown"))


def facts(title: Column, known: list[str]) -> Column:
    """What a title states: slot, family, sizes, calibers, crown, feet and windows, profile and material."""
    t = F.regexp_replace(F.lower(title), r"\s+", " ")
    feet = F.when(t.rlike(r"\bfeetless\b|\bno (?:dial )?feet\b|\bwithout feet\b"), False).when(t.rlike(r"\bwith (?:dial )?feet\b|\bfeet at\b"), True)
    said = r"(?i)(?<![\w.])(\d(?:\.\d)?)\s*(?:o'?clock|h)\s+crown\b|\bcrown\s+(?:at|@)\s*(\d(?:\.\d)?)\b"
    crown = F.coalesce(movement_crown(title), _text(F.concat(F.regexp_extract(title, said, 1), F.regexp_extract(title, said, 2))))
    windows = T.complication(title)

    def all_of(r: Column) -> Column:
        return F.struct(
            r["slot"].alias("slot"), family_for(r["slot"], r["t"], r["feet"], r["moves"], known).alias("family"), *[title_size(title, f).alias(f) for f in TITLE_SIZES], F.array_join(r["moves"], ",").alias("calibers"),
            F.when(F.size(r["moves"]) == 1, F.element_at(r["moves"], 1)).alias("caliber"), crown.alias("crown"), r["feet"].alias("has_feet"), windows["has_date"].alias("has_date"), windows["has_day"].alias("has_day"),
            T.profile(title).alias("profile"), T.material(title).alias("material"),
        )

    return T.once(F.struct(slot_of(title).alias("slot"), t.alias("t"), feet.alias("feet"), calibers(title).alias("moves")), all_of)
