"""Secret scans: pattern spans, and tokens that a character Markov model of random
strings explains better than one of ordinary identifiers.

DataFrame functions only.  A match's place is the length of the gaps and matches
before it: `split` gives the gaps and `regexp_extract_all` the matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the three base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Tokens that the Markov models judge, and their smallest length.
TOKEN, LEAST_TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}", 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: A token is a secret above this log-likelihood ratio in all (thousandths of a nat) and a character.
LEAST_TOTAL, LEAST_EACH = 12_000, 900

# Everyday and programming words of the corpus' languages, from
# which ordinary identifiers are put together.
WORDS = """the and that with have this from they would there their what about which when make time just know take people into year
your good some could them other than then look only come over think also back after work first well even want because these give most
user name file path index value count list table column query result error message request response server client session config
default create update delete insert select order number string buffer stream reader writer handler manager service factory builder
total amount price status state event action result length width height color image layer matrix vector thread process system
nicht einen werden haben ihre durch gegen zwischen schaft lichkeit ungen heiten entwicklung verein gesellschaft arbeit straße
para como pero entre hasta desde mente ciones trabajo gobierno dans avec pour cette leurs elle tion ement ville maison""".split()


def labelled_samples(spark: SparkSession, n: int = 12_000) -> DataFrame:
    """(random, s): n strings of either kind, made by rule and the same everywhere.

    Random ones are digests in lower and upper hexadecimal, base 64 and base
    64 without case or signs; ordinary ones are two to five words joined in the
    usual ways, at times with a number.
    """
    rows = spark.range(n).select(F.col("id").alias("i"))
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("i").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    kind = F.col("i") % 6
    random = F.when(kind == 0, digest).when(kind == 1, F.upper(F.substring(digest, 1, 40))).when(kind == 2, F.translate(F.upper(b64), "+/=", "XQZ")).when(kind == 3, F.translate(F.lower(b64), "+/=", "xqz")).otherwise(b64)
    words = F.array(*[F.lit(w.replace("ß", "ss")) for w in WORDS])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit(k), "i"), F.lit(len(WORDS))) + 1).cast("int"))
    some = F.slice(F.array(*[word(k) for k in range(5)]), 1, (F.pmod(F.xxhash64(F.lit("n"), "i"), F.lit(4)) + 2).cast("int"))
    joined = (
        F.when(kind == 0, F.array_join(some, "_")).when(kind == 1, F.array_join(F.transform(some, F.initcap), "")).when(kind == 2, F.upper(F.array_join(some, "_")))
        .when(kind == 3, F.array_join(some, "-")).when(kind == 4, F.array_join(some, "")).otherwise(F.array_join(some, "/"))
    )
    number = F.when(F.col("i") % 7 == 0, F.concat(F.lit("_"), (F.pmod(F.xxhash64("i"), F.lit(2030))).cast("string"))).otherwise(F.lit(""))
    return rows.select(F.lit(1).alias("random"), random.alias("s")).unionByName(rows.select(F.lit(0).alias("random"), F.concat(joined, number).alias("s")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """Log-likelihood ratio, random over ordinary, of each pair of characters, in thousandths.

    Row-major over ALPHABET; pairs are counted in Spark, and the driver gets a row
    for each pair and label at most.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2))))
    counts = samples.where(F.length("s") > 1).select("random", pair.alias("p")).groupBy("random", "p").count().collect()
    seen = {(r["random"], r["p"]): r["count"] for r in counts}
    size = len(ALPHABET)
    out = []
    for a in ALPHABET:
        total = [sum(seen.get((k, a + b), 0) for b in ALPHABET) + smoothing * size for k in (0, 1)]
        out += [round(1000 * (math.log((seen.get((1, a + b), 0) + smoothing) / total[1]) - math.log((seen.get((0, a + b), 0) + smoothing) / total[0]))) for b in ALPHABET]
    return out


def ratio(token: Column, model: list[int]) -> Column:
    """Sum of the model over the token's pairs of characters; each character is looked up once."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    places = F.transform(F.filter(F.split(token, "", -1), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda acc, at: F.struct(
        at.alias("last"), (acc["total"] + F.when(acc["last"] > 0, F.element_at(table, (acc["last"] - 1) * len(ALPHABET) + at)).otherwise(0)).alias("total")
    )
    return F.aggregate(places, F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("total")), step, lambda acc: acc["total"])


def scan(docs: DataFrame, model: list[int], text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """docs with `base` and `spans`: arrays of (start, kind, end), kind an index into KINDS.

    base has the spans of the three patterns; spans adds tokens judged random
    that overlap none of them.  Both are in order of start, then kind.  Cases: a
    null or empty text has none; texts and tokens of any length are scanned whole, in
    time that grows as their length; repeated rows and rows of a null id are rows
    like any other, as no id is read; an empty table gives an empty one; other
    columns are passed on, but columns named as base_col and spans_col are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= LEAST_ASSIGN))).otherwise(none)
    long_run = text.rlike("[A-Za-z0-9+/_-]{20}")
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1, F.transform(_matches(text, ACCESS), lambda m: F.length(m) >= LEAST_ACCESS))).otherwise(none)
    # A run of 24 hexadecimal digits or more; shorter ones are dropped anyway and touch no other.
    hex_ = F.when(long_run & text.rlike("[0-9a-f]{24}"), _spans(text, f"[0-9a-f]{{{LEAST_HEX},}}", 2)).otherwise(none)
    base = F.array_sort(F.concat(assign, access, hex_))
    judged = lambda m: ratio(m, model) >= F.greatest(F.lit(LEAST_TOTAL).cast("long"), LEAST_EACH * F.length(m).cast("long"))
    tokens = F.when(long_run, _spans(text, TOKEN, 3, F.transform(_matches(text, TOKEN), judged))).otherwise(none)
    found = docs.withColumn(base_col, base).withColumn(spans_col, tokens)
    free = F.filter(spans_col, lambda t: ~F.exists(base_col, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    return found.withColumn(spans_col, F.when(F.size(spans_col) > 0, F.array_sort(F.concat(base_col, free))).otherwise(F.col(base_col)))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(text: Column, pattern: str, order: int, good: Column | None = None) -> Column:
    """Spans (start, order, end) of the leftmost non-overlapping matches, of those that `good` marks if it is given.

    start and end count code points.
    """
    found = F.transform(_matches(text, pattern), lambda m: F.length(m))
    # One gap more than matches; the last one is followed by none.
    steps = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), found, lambda g, m: g + F.coalesce(m, F.lit(0)))
    spans = F.zip_with(_running(steps), found, lambda end, m: F.when(m.isNotNull(), F.struct((end - m).alias("start"), F.lit(order).alias("kind"), end.alias("end"))))
    return F.array_compact(spans if good is None else F.zip_with(spans, good, lambda span, g: F.when(g, span)))


#: Numbers of a block in a running sum, which appends to short arrays only.
BLOCK = 128


def _running(steps: Column) -> Column:
    """Running sums of an array, in blocks: within each, and over the blocks' sums."""
    none = F.expr("cast(array() as array<int>)")
    total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x)
    scan = lambda values, first: F.aggregate(values, F.struct(first.alias("at"), none.alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")), lambda acc: acc["out"])
    cut = lambda values: F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK)), lambda a: F.slice(values, a, F.lit(BLOCK)))
    joined = lambda blocks: F.flatten(F.zip_with(blocks, scan(F.transform(blocks, total), F.lit(0)), lambda block, end: scan(block, end - total(block))))
    return _once(_once(steps, cut), joined)


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once however often a lambda in it asks."""
    return F.element_at(F.transform(F.array(value), use), 1)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "[secret]", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The text with each run of spans replaced by mark; overlapping spans are one run."""
    text = F.col(text_col)

    def step(acc, s):
        inside = s["start"] < acc["at"]
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(new).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans_col, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size(spans_col) > 0, done).otherwise(text))
