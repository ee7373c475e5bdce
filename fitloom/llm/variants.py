"""Spelling variants of words: pairs one edit apart by bands of letter-parity masks.

A word's mask has, for each class of letters, the parity of how often they occur.
One inserted or deleted letter flips one bit and one replaced letter two at most, so of
three bands of the mask one at least is equal (two, if lengths differ).  One edit
also leaves one half of the word as it is.  Words meet where length, a band and a half
are equal, and what meets is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import Scratch

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = r"A-Za-zÀ-ÿ"
#: Bits of a band; a letter's band is its code point modulo 3.
BAND_BITS = 16
#: Words that meet in one bucket; those of larger buckets meet by what a deletion leaves, where at most one letter's choice of words meets.
BUCKET = 256


def _low(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def word_counts(docs: DataFrame, length: int = 6, least: int = 5, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of `length` letters or more that occur `least` times or more in all texts.

    slip: let h be the crc32 of `<id>:<word>`; where slip divides h, the word
    loses its letter h % its length, as a slip of the pen would take it.
    Occurrences are counted within each task before they are shuffled.
    """
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run")).select("id", _low(F.col("run")).alias("word"))
    if slip:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "word"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.withColumn("h", h).select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """A bit for the parity of each class of letters, in three bands of BAND_BITS."""
    code = lambda c: F.ascii(c).cast("int")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (code(c) % 3) * BAND_BITS + F.floor(code(c) / 3).cast("int") % BAND_BITS)))


def _keys(words: DataFrame) -> DataFrame:
    """(key, word, mask, longer): the buckets of each word.

    A bucket is of words of some length s and of longer ones by a letter; a word
    is in those of its own length by all bands, and in those of one letter less by two bands,
    one of which is equal wherever one bit flips.
    """
    size, keys = F.char_length("word"), []
    for longer, bands in ((False, (0, 1, 2)), (True, (0, 1))):
        s = size - 1 if longer else size
        half = F.floor(s / 2).cast("int")
        for end, part in ((0, F.left("word", half)), (1, F.right("word", s - half))):
            for band in bands:
                value = F.shiftright("mask", band * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))
                keys.append(F.struct(F.xxhash64(F.lit(band * 2 + end), s, value, part).alias("key"), F.lit(longer).alias("longer")))
    return words.select("word", "mask", F.explode(F.array(*keys)).alias("k")).select(F.col("k")["key"].alias("key"), "word", "mask", F.col("k")["longer"].alias("longer"))


def _one_edit(pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) that one edit turns into each other."""
    return pairs.where(F.levenshtein("a", "b", 1) == 1)


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: distinct words that one inserted, deleted or replaced code point turns into each other."""
    masked = scratch.keep(words.select("word", parity_mask(F.col("word")).alias("mask")), "masks")
    keys = _keys(masked)
    sizes = keys.groupBy("key").count().where("count > 1")
    met = keys.join(sizes, "key")
    few = met.where(F.col("count") <= BUCKET)
    one, two = (few.select("key", F.col("word").alias(w), F.col("mask").alias(f"{w}_mask"), F.col("longer").alias(f"{w}_longer")) for w in "ab")
    # Texts are compared only where as many bits differ as one edit flips.
    flips = F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask")))
    near = _one_edit(one.join(two, "key").where((F.col("a") < F.col("b")) & ~(F.col("a_longer") & F.col("b_longer")) & (flips <= 2)).select("a", "b"))
    # Words of large buckets: equal after losing the same letter's place, or one is what the other leaves.
    many = met.where(F.col("count") > BUCKET).select("word").distinct()
    rest = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.struct(i.alias("at"), F.concat(F.left("word", i - 1), F.substring("word", i + 1, F.char_length("word"))).alias("left")))
    left = many.select("word", F.explode(rest).alias("r")).select("word", "r.at", "r.left")
    one, two = left.withColumnRenamed("word", "a"), left.withColumnRenamed("word", "b")
    replaced = one.join(two, ["at", "left"]).where("a < b").select("a", "b")
    dropped = left.join(many.select(F.col("word").alias("other")), F.col("left") == F.col("other")).select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b"))
    return near.unionByName(_one_edit(replaced.unionByName(dropped))).distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form, following forms to the last one, twice as far in each round.

    n grows by a factor from form to form, so chains are short; a word is the form of its near words only.
    """
    now, moved = scratch.keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots"), 1
    while moved:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(now.drop("moved").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now, moved = new, new.where("moved").limit(1).count()
    return now.select("word", "root")


def variants(counts: DataFrame, scratch: Scratch, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of counts (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point
    order), if that is `factor` times the word's own n or more.  counts must have each word once.
    """
    words = scratch.keep(counts, "words")
    pairs = scratch.keep(near_pairs(words, scratch), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    told = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = told.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    shaped = words.join(best, "word", "left").withColumn("takes", -F.col("best")["less"] >= factor * F.col("n"))
    shaped = scratch.keep(shaped.select("word", F.when(F.col("takes"), F.col("best")["form"]).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), -F.col("best")["less"]).alias("form_n")), "forms")
    roots = _roots(shaped.where("form IS NOT NULL"), scratch)
    return shaped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, length: int = 6, least: int = 5, slip: int | None = None, factor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of docs with their near words' number, form and root.

    Cases: a null or empty text has no words; very long texts are taken whole; a
    null id counts as an empty one in the slip's sum; repeated rows count each time; ties of n take the
    smallest form; an empty table, or one without common words, gives no row; other columns are not
    read.  Tables lie in spark.checkpoint.dir (in local mode without one, in a temporary folder).
    """
    return variants(word_counts(docs, length, least, slip, id_col, text_col), Scratch(docs.sparkSession, "variants"), factor)
