"""Listing text as column expressions: links, words, tags, dimensions, listing facts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which product a name means.
STOPWORDS = "the for and with watch watches style styled set sets seiko mod mods modding new premium quality finish finished fits fit replacement part parts custom compatible your build builds a of to in".split()

# Words for colours.
_COLOUR = "black|white|blue|green|red|orange|yellow|grey|gray|gold|silver|brown|bronze|cream|beige|biege|pink|purple|navy|slate"
_WEAR = ("dial", "hands", "bezel_insert", "strap", "case")

# Style tags, the words that give evidence of each, and the categories that may carry it.
STYLE_TAGS = [
    ("black", r"\bblack\b|\bonyx\b|\bnoir\b", _WEAR), ("white", r"\bwhite\b|\bsnow\b|\barctic\b", _WEAR), ("cream", r"\bcream\b|\bivory\b|\bbiege\b|\bbeige\b|\becru\b", _WEAR),
    ("blue", r"\bblue\b|\bnavy\b|\baegean\b|\bcobalt\b", _WEAR), ("green", r"\bgreen\b|\bolive\b|\bemerald\b|\bjade\b", _WEAR), ("grey", r"\bgrey\b|\bgray\b|\bslate\b|\bgun\s?metal\b|\bcharcoal\b", _WEAR),
    ("brown", r"\bbrown\b|\bbronze\b|\bcopper\b|\bumber\b|\bchocolate\b|\btropical\b", _WEAR), ("red", r"\bred\b|\bburgundy\b|\bmaroon\b|\bcherry\b", _WEAR), ("orange", r"\borange\b|\bamber\b", _WEAR), ("yellow", r"\byellow\b|\bmustard\b", _WEAR),
    ("rose-gold", r"\brose\s?gold\b|\bsalmon\s?gold\b", _WEAR), ("gold-tone", r"\bgold\b|\bgilt\b|\bbrass\b", _WEAR), ("silver-tone", r"\bsilver\b|\bsteel\b|\bstainless\b|\brhodium\b", _WEAR),
    ("sunburst", r"\bsunburst\b|\bsun\s?ray\b", ("dial",)), ("matte", r"\bmatte\b|\bmatt\b|\bsandblast", ("dial", "bezel_insert", "case")), ("textured", r"\btextur|\bwaffle\b|\bgrain|\bhammered\b|\blinen\b|\bwave\b", ("dial",)),
    ("enamel", r"\benamel\b|\blacquer\b|\bglossy?\b", ("dial",)), ("mother-of-pearl", r"\bmother\s?(of\s?)?pearl\b|\bMOP\b", ("dial",)), ("aged-lume", r"\bpatina\b|\baged\b|\bfaded\b|\bvintage\b|\bghost\b", ("dial", "hands", "bezel_insert")),
    ("polished", r"\bpolish", ("hands", "bezel_insert", "case")), ("brushed", r"\bbrushed\b", ("hands", "bezel_insert", "case")),
    ("arabic-numerals", r"\barabic\b|\bnumeral", ("dial",)), ("roman-numerals", r"\broman\b", ("dial",)), ("no-branding", r"\bsterile\b|\bno\s?logo\b|\bunbranded\b|\bblank\b", ("dial",)), ("half-numeral", r"\bcalifornia\b", ("dial",)),
    ("sword-hands", r"\bsword\b", ("hands",)), ("dauphine-hands", r"\bdauphine\b", ("hands",)), ("syringe-hands", r"\bsyringe\b", ("hands",)), ("pencil-hands", r"\bpencil\b", ("hands",)), ("arrow-hands", r"\barrow\b", ("hands",)),
    ("faceted-hands", r"\bsnowflake\b|\bfacet", ("hands",)), ("three-lobe-hands", r"\bmercedes\b|\bmerc\b", ("hands",)), ("skeleton-hands", r"\bskeleton\b", ("hands",)),
    ("lumed", r"\blume(d)?\b|\bluminous\b|\bbgw\b|\bsuper\s?luminova\b|\bglow", ("dial", "hands", "bezel_insert")),
    ("dive-bezel", r"\bdive\b|\bcount\s?(up|down)\b|\bsub\b|\bdiver\b|\btimer\b", ("bezel_insert",)), ("gmt-bezel", r"\bgmt\b|\bdual\s?time\b|\b24\s?h(our)?\b|\bworldtime", ("bezel_insert",)),
    ("two-tone-bezel", rf"\b(?:{_COLOUR})\b\s*(?:/|-|\band\b)\s*\b(?:{_COLOUR})\b|\btwo[\s-]?(?:tone|colou?r)\b|\bpepsi\b|\bbatman\b|\bcoke\b|\broot\s?beer\b", ("bezel_insert",)),
    ("plain-bezel", r"\bsmooth\b|\bplain\b|\bfluted\b|\byacht\b", ("bezel_insert",)), ("ceramic", r"\bceramic\b", ("bezel_insert",)), ("aluminium", r"\baluminium\b|\baluminum\b", ("bezel_insert",)),
    ("vintage", r"\bvintage\b|\bretro\b|\bheritage\b|\bpatina\b|\bfaded\b|\baged\b", ("dial", "hands", "bezel_insert")), ("dressy", r"\bdress\b|\bdauphine\b|\broman\b|\benamel\b|\bmother\s?(of\s?)?pearl\b", ("dial", "hands")),
    ("tool-watch", r"\bdiver?\b|\bfield\b|\bpilot\b|\bmilitary\b|\bmilspec\b|\bsterile\b|\btool\b", ("dial", "hands", "bezel_insert")), ("pilot", r"\bpilot\b|\bflieger\b|\baviator\b", ("dial", "hands")),
]

COLOURS = ("black", "white", "cream", "blue", "green", "grey", "brown", "red", "orange", "yellow", "gold-tone", "silver-tone")

# Shapes of a part by category, in order of precedence, the tags that speak for one, and what is drawn where none fits.
SHAPES = {
    "hands": [
        ("hand-three-lobe", r"\bmercedes\b|\bmerc\b"), ("hand-faceted", r"\bsnowflake\b|\bfacet"), ("hand-dauphine", r"\bdauphine\b"), ("hand-syringe", r"\bsyringe\b"), ("hand-arrow", r"\bbroad\s?arrow\b|\barrow\b"), ("hand-cathedral", r"\bcathedral\b"),
        ("hand-pencil", r"\bpencil\b"), ("hand-sword", r"\bsword\b|\bdagger\b|\bflieger\b|\bplongeur\b|\blance\b"), ("hand-baton", r"\bbaton\b|\bstick\b|\bbar\s?hand"),
    ],
    "crown": [("crown-onion", r"\bonion\b"), ("crown-bolt", r"\bbolt\b"), ("crown-coin", r"\bcoin\b|\bfluted\b|\bribbed\b"), ("crown-knurled", r"\bknurl"), ("crown-chunky", r"\bchunky\b|\bbig\b|\boversiz"), ("crown-smooth", r"\bsmooth\b|\bflat\b|\bplain\b|\bpolished\b")],
    "chapter_ring": [("ring-angled", r"\bangled\b|\bslope|\bincline|\bbevel"), ("ring-plain", r"\bplain\b|\bsandbl|\bbrushed\b|\bpolished\b|\bsmooth\b")],
    "bezel_insert": [("insert-gmt", r"\bgmt\b|\bdual\s?time\b|\b24\s?h(our)?\b|\bworldtime|\bpepsi\b|\bbatman\b"), ("insert-dive", r"\bdive\b|\bdiver\b|\bcount\s?(up|down)\b|\btimer\b|\bsub\b"), ("insert-plain", r"\bsmooth\b|\bplain\b|\bfluted\b|\byacht\b|\bno\s?scale\b")],
    "strap": [
        ("strap-nato", r"\bnato\b|\bzulu\b|\bsingle\s?pass\b|\bseatbelt\b|\bperlon\b"), ("strap-jubilee", r"\bjubilee\b|\bbeads?\s?of\s?rice\b|\bpresident\b"), ("strap-oyster", r"\boyster\b|\bsuper\s?-?\s?engineer\b|\bengineer\b"),
        ("strap-bracelet", r"\bbracelet\b|\bmilanese\b|\bmesh\b|\bnautilus\b"), ("strap-band", r"\bleather\b|\brubber\b|\bfkm\b|\bsilicone\b|\bnylon\b|\bcanvas\b|\bsuede\b|\bcordovan\b|\btropic\b|\bwaffle\b|\bstrap\b"),
    ],
}
SHAPE_OF_TAG = {
    "three-lobe-hands": "hand-three-lobe", "faceted-hands": "hand-faceted", "dauphine-hands": "hand-dauphine", "syringe-hands": "hand-syringe", "arrow-hands": "hand-arrow",
    "pencil-hands": "hand-pencil", "sword-hands": "hand-sword", "gmt-bezel": "insert-gmt", "dive-bezel": "insert-dive", "plain-bezel": "insert-plain",
}
FALLBACK = {"hands": "hand-sword", "crown": "crown-knurled", "chapter_ring": "ring-plain", "bezel_insert": "insert-dive", "strap": "strap-band"}

# Words that name other makers' goods.
RESERVED = [
    "rolex", "omega", "tudor", "submariner", "sub", "explorer", "daytona", "datejust", "gmt-master", "gmt master", "yacht-master", "yacht master", "sea-dweller", "sea dweller", "milgauss", "oyster", "mercedes", "pepsi", "batman", "hulk", "kermit", "coke",
    "black bay", "pelagos", "speedmaster", "seamaster", "planet ocean", "railmaster", "nautilus", "aquanaut", "royal oak", "fifty fathoms", "fathoms", "luminor", "radiomir", "flieger", "marinemaster", "turtle", "samurai", "monster", "sumo", "willard",
    "captain willard", "alpinist", "spork", "tuna", "shogun", "cocktail time", "snowflake", "milspec", "divemaster", "worldtimer", "vantage", "b. wayne",
]

# Bounds of believable sizes in millimetres.
BOUNDS = {"outer": (24, 46), "inner": (18, 40), "diameter": (4, 11), "hour": (4, 14), "minute": (7, 17), "second": (7, 18), "caseDiameter": (30, 48), "lugWidth": (14, 26), "aperture": (22, 36)}

# How sizes are written.
_N = r"(\d{1,2}(?:\.\d{1,2})?)"
SIZES = {
    "outer": rf"(?i)(?:outer|outside)\s*(?:diameter|dia\.?)\s*[:\-–]?\s*{_N}\s*mm", "inner": rf"(?i)(?:inner|inside)\s*(?:diameter|dia\.?)\s*[:\-–]?\s*{_N}\s*mm", "diameter": rf"(?i)crown\s*(?:diameter|dia\.?|size|width)\s*[:\-–]?\s*{_N}\s*mm",
    "hands": rf"(?i)(?:h\s*/\s*m\s*/\s*s|hour\s*/\s*minute\s*/\s*second)\s*[:\-–]?\s*{_N}\s*(?:mm)?\s*/\s*{_N}\s*(?:mm)?\s*/\s*{_N}\s*mm",
}
# How a request states money, a size, a date and a second zone.
MONEY = r"(?:£|gbp\s*)(\d[\d,]*(?:\.\d{1,2})?)|(\d[\d,]*)\s*(?:pounds|quid|gbp)"
ASKED_SIZE, NO_DATE, DATE, SECOND_ZONE = r"(\d{2}(?:\.\d)?)\s*mm", r"\bno date\b|dateless|without a date", r"\bdate\b", r"\bgmt\b|second time ?zone|dual time|two time ?zone"


def strip_html(html: Column) -> Column:
    """Text between tags, entities as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "(?i)&nbsp;|&[a-z]+;", " "), r"\s+", " "))


def product_url(raw: Column) -> Column:
    """host/products/handle of a product link, whatever its spelling; null for any other link."""
    text = F.trim(raw)
    full = F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", "")
    path = F.try_parse_url(full, F.lit("PATH"))
    handle = F.regexp_extract(path, r"^.*/products/+([^/]+)", 1)
    good = host.isNotNull() & F.try_parse_url(full, F.lit("PROTOCOL")).isin("http", "https") & (handle != "")
    return F.when(good, F.concat(host, F.lit("/products/"), F.lower(F.coalesce(F.try_url_decode(handle), handle))))


def url_parts(url: Column) -> Column:
    """Host without www, and path without query or closing slash, lower-cased."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.struct(host.alias("host"), F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), "/+$", "").alias("path"))


def keywords(name: Column) -> Column:
    """Distinct words of a name that tell products apart, in order."""
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS) & ~w.rlike("^[0-9]+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 where either side has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def style_tags(name: Column, category: Column) -> Column:
    return F.array_compact(F.array(*[F.when(category.isin(*slots) & name.rlike(f"(?i){pattern}"), F.lit(tag)) for tag, pattern, slots in STYLE_TAGS]))


def known_tags(candidates: Column) -> Column:
    """Those of the candidates that the vocabulary has, cleaned, once each."""
    clean = F.array_distinct(F.transform(candidates, lambda t: F.lower(F.trim(t))))
    return F.array_intersect(clean, F.array(*[F.lit(t) for t, _, _ in STYLE_TAGS]))


def dropped_tags(candidates: Column) -> Column:
    """Those of the candidates that the vocabulary lacks, cleaned, once each; empty ones are none."""
    clean = F.array_distinct(F.transform(candidates, lambda t: F.lower(F.trim(t))))
    return F.filter(F.array_except(clean, F.array(*[F.lit(t) for t, _, _ in STYLE_TAGS])), lambda t: t != "")


def once(value: Column, use) -> Column:
    """use(value), with value worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matched_shape(text: Column, tags: Column, category: Column) -> Column:
    """The shape that tags speak for, else the one that the text does; null where neither does."""
    orders = F.coalesce(*[F.when(category == c, F.array(*[F.lit(s) for s, _ in shapes])) for c, shapes in SHAPES.items()])
    of_tag = F.create_map(*[F.lit(x) for pair in SHAPE_OF_TAG.items() for x in pair])
    by_tag = F.get(F.array_intersect(orders, F.transform(tags, lambda t: of_tag[t])), 0)
    by_text = [F.when((category == c) & text.rlike(f"(?i){p}"), F.lit(s)) for c, shapes in SHAPES.items() for s, p in shapes]
    return F.coalesce(by_tag, *by_text)


def shape(text: Column, tags: Column, category: Column) -> Column:
    """A tag beats the text, the text the fallback of its category."""
    return F.coalesce(matched_shape(text, tags, category), fallback(category))


def fallback(category: Column) -> Column:
    return F.coalesce(*[F.when(category == c, F.lit(s)) for c, s in FALLBACK.items()])


def reserved_terms(text: Column) -> Column:
    hay = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    return once(hay, lambda h: F.array_compact(F.array(*[F.when(F.contains(h, F.lit(f" {re.sub('[^a-z0-9]+', ' ', t)} ")), F.lit(t)) for t in RESERVED])))


def redact_terms(text: Column) -> Column:
    """The text without the reserved terms found in it, spaces closed up; a text that has none stays as it is."""
    without = lambda found: F.aggregate(found, text, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\b\Q"), t, F.lit(r"\E\b")), F.lit("")))
    closed = lambda found: F.trim(F.regexp_replace(F.regexp_replace(without(found), r"\s{2,}", " "), r"\s+([,.])", "$1"))
    return once(reserved_terms(text), lambda found: F.when(F.size(found) == 0, text).otherwise(closed(found)))


def _bounded(field: str, raw: Column) -> Column:
    low, high = BOUNDS[field]
    value = raw.try_cast("double")
    return F.when(value.between(low, high), value)


def dimensions(text: Column, category: Column | None = None) -> Column:
    """outer, inner, crown diameter and hand lengths that the text states and that hold together; of its category only, if one is given."""
    flat = strip_html(text)
    get = lambda name, k=1: F.regexp_extract(flat, SIZES[name], k)
    outer, inner = _bounded("outer", get("outer")), _bounded("inner", get("inner"))
    clash = F.coalesce(inner >= outer, F.lit(False))
    hour, minute = _bounded("hour", get("hands", 1)), _bounded("minute", get("hands", 2))
    good = F.coalesce(minute > hour, F.lit(False))
    of = lambda value, *names: value if category is None else F.when(category.isin(*names), value)
    return F.struct(
        of(F.when(~clash, outer), "bezel_insert", "chapter_ring").alias("outer"), of(F.when(~clash, inner), "bezel_insert", "chapter_ring").alias("inner"), of(_bounded("diameter", get("diameter")), "crown").alias("diameter"),
        of(F.when(good, hour), "hands").alias("hour"), of(F.when(good, minute), "hands").alias("minute"), of(F.when(good, _bounded("second", get("hands", 3))), "hands").alias("second"),
    )


def case_dimensions(diameter: Column, lug: Column, aperture: Column) -> Column:
    """Sizes of a case that lie within believable bounds, however they were stated."""
    return F.struct(*[_bounded(name, c.cast("string")).alias(name) for name, c in (("caseDiameter", diameter), ("lugWidth", lug), ("aperture", aperture))])


def first_mm(title: Column) -> Column:
    """The first size in millimetres of a title."""
    got = F.regexp_extract(title, r"(?i)(?<![\w.])(\d{2}(?:\.\d)?)\s*mm\b", 1)
    return F.when(got != "", got.cast("double"))


def caliber(title: Column) -> Column:
    got = F.upper(F.regexp_extract(title, r"(?i)\b(NH(?:3[4568]|7[012]))(?=A?\b)", 1))
    return F.when(got != "", got)


def complication(title: Column) -> Column:
    t = F.lower(title)
    day, none, date = t.rlike(r"day[\s\-/]?date"), t.rlike("no date"), t.rlike(r"\bdate\b")
    return F.struct(F.when(day, True).when(none, False).when(date, True).alias("has_date"), F.when(day, True).when(none | date, False).alias("has_day"))


def profile(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike("double.?dome|domed"), "domed").when(t.rlike(r"\bslope[d]?\b"), "slope").when(t.rlike(r"\bflat\b"), "flat")


def material(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.contains("ceramic"), "ceramic").when(t.contains("sapphire"), "sapphire").when(t.rlike("alumini?um"), "aluminum").when(t.rlike("steel (bezel )?insert"), "steel").when(t.contains("carbon"), "carbon").when(t.contains("glass"), "glass")


def intent(query: Column) -> Column:
    """Budget (the first amount in the text), size, date and second-zone wishes of a request in words, and the tags that it names."""
    t = F.lower(query)
    amount = F.regexp_replace(F.concat(F.regexp_extract(t, MONEY, 1), F.regexp_extract(t, MONEY, 2)), ",", "").try_cast("double")
    mm = F.nullif(F.regexp_extract(t, ASKED_SIZE, 1), F.lit("")).cast("double")
    size = (mm > 20) & (mm < 60)
    return F.struct(
        F.when(amount > 0, F.round(amount * 100).cast("long")).alias("budget_minor"), F.when(size, mm - 2).alias("size_from"), F.when(size, mm + 2).alias("size_to"),
        F.when(t.rlike(NO_DATE), False).when(t.rlike(DATE), True).alias("requires_date"), F.when(t.rlike(SECOND_ZONE), True).alias("requires_gmt"),
        F.array_compact(F.array(*[F.when(t.rlike(f"(?i){pattern}"), F.lit(tag)) for tag, pattern, _ in STYLE_TAGS])).alias("tags"),
    )


def english_list(words: Column) -> Column:
    """a, b and c."""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(words, -1)))


def minor_units(price: Column) -> Column:
    """Pence of a price written with two decimals; null for any other spelling.  Never through a float."""
    return F.when(price.rlike(r"^\d+\.\d{2}$"), F.regexp_replace(price, r"\.", "").cast("long"))


def money(minor: Column, symbol: str = "£") -> Column:
    return F.concat(F.lit(symbol), F.format_string("%d.%02d", F.floor(minor / 100), F.pmod(minor, F.lit(100))))
