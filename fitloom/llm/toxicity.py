"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features: densities of learned lexicons (words and word beginnings, also of
de-obfuscated words), how near they stand to second-person words, capitals,
punctuation and obfuscation rates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm import gbt
from fitloom.llm.common import BASE, BYTE_VALUE, U64, Scratch, byte_view, chunks, mix, small_batches
from fitloom.llm.labelled import remainder, sample_labels
from fitloom.llm.quality import to_matrix, training_rows

#: Labelled rows of each class that the lexicon and the trees are fitted on, at most.
LEXICON_ROWS, FIT_ROWS = 4_000, 8_000
#: Words around a second-person word that count as near.
NEAR = 6

# Second-person words of the languages in the corpus.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes vosotros tus".split()

# Characters that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

NAMES = [
    "log_words", "word_density", "begin4_density", "begin5_density", "weight_density", "weight_top", "log_hits", "second_density", "near_density", "near_share",
    "upper", "upper_words", "bang", "question", "punct", "disguised", "digits", "mean_word", "first_hit",
]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_INSIDE = _LETTER.copy()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _from, _to in DISGUISE.items():
    _INSIDE[ord(_from)] = True
    _FOLD[ord(_from)] = ord(_to)


def _words(raw: np.ndarray, offsets: np.ndarray):
    """Word runs: row, start, length, and hashes of the whole word and its first 4 and 5 bytes."""
    inside = _INSIDE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = inside[heads]
    at = np.flatnonzero(start)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((3, 0), U64), none.astype(bool)
    folded = _FOLD[raw]
    # After the lead byte 0xC3 capitals lie 32 below their small letters.
    accent = np.concatenate([[False], (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)])
    folded[accent] += 32
    body = np.flatnonzero(inside)
    word = np.cumsum(start[body]) - 1
    pos = body - at[word]
    first = np.searchsorted(body, at)
    power = np.cumprod(np.concatenate([[U64(1)], np.full(int(pos.max()), BASE, U64)]))
    value = BYTE_VALUE[folded[body]] * power[pos]
    length = np.diff(np.concatenate([first, [len(body)]]))
    hashes = [mix(np.add.reduceat(value, first))]
    for k in (4, 5):
        hashes.append(np.where(length > k, mix(np.add.reduceat(np.where(pos < k, value, U64(0)), first) + U64(k)), U64(0)))
    plain = np.add.reduceat(_LETTER[raw[body]].astype(np.int64), first)
    disguised = (plain > 0) & (plain < length)
    row = np.searchsorted(offsets, at, "right") - 1
    keep = plain > 0
    return row[keep], at[keep], length[keep], np.stack(hashes)[:, keep], disguised[keep]


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[3][0, 0]


_SECOND = np.sort(np.array([_word_hash(w) for w in SECOND_PERSON], U64))


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def dense_features(raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(documents, len(NAMES)); keys are sorted hashes of the lexicon."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    row, at, length, hashes, disguised = _words(raw, offsets)
    count = np.bincount(row, minlength=n).astype(float)
    each = np.maximum(count, 1)
    hit, weight = np.zeros((3, len(row)), bool), np.zeros(len(row))
    if len(keys) and len(row):
        for k in range(3):
            place = np.minimum(np.searchsorted(keys, hashes[k]), len(keys) - 1)
            hit[k] = (keys[place] == hashes[k]) & (hashes[k] != 0)
            weight = np.maximum(weight, np.where(hit[k], weights[place], 0))
    any_hit = hit.any(0)
    by = lambda values: np.bincount(row, values, n)
    second = np.isin(hashes[0], _SECOND)
    spread = np.concatenate([[0], np.cumsum(second)])
    lo, hi = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
    index = np.arange(len(row))
    near = any_hit & (spread[np.minimum(index + NEAR + 1, hi[row])] > spread[np.maximum(index - NEAR, lo[row])]) if len(row) else any_hit
    top = np.zeros(n)
    np.maximum.at(top, row, weight)
    first_hit = np.ones(n)
    np.minimum.at(first_hit, row[any_hit], ((index - lo[row]) / each[row])[any_hit] if len(row) else np.zeros(0))
    upper = (raw >= 65) & (raw <= 90)
    capital = np.concatenate([[0], np.cumsum(upper)])
    shouted = (capital[np.minimum(at + length, len(raw))] - capital[at] == length) & (length > 2)
    punct = np.isin(raw, np.frombuffer(b"!\"'(),-.:;?", np.uint8))
    hits = by(any_hit)
    columns = [
        np.log1p(count), by(hit[0]) / each, by(hit[1]) / each, by(hit[2]) / each, by(weight) / each, top, np.log1p(hits), by(second) / each, by(near) / each, by(near) / np.maximum(hits, 1),
        _sums(upper, offsets) / size, by(shouted) / each, _sums(raw == 33, offsets) / size, _sums(raw == 63, offsets) / size, _sums(punct, offsets) / size, by(disguised) / each,
        _sums((raw >= 48) & (raw <= 57), offsets) / size, by(length) / each, first_hit,
    ]
    return np.stack(columns, 1)


def _terms(batches):
    """(y, term) of each distinct hash of a labelled text."""
    for batch in batches:
        raw, offsets = byte_view(batch.column(0))
        labels = np.asarray(batch.column(1), np.float64)
        for a, b in chunks(offsets):
            row, _, _, hashes, _ = _words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            pairs = np.unique(np.stack([np.tile(row, 3).astype(U64), hashes.reshape(-1)]), axis=1)
            pairs = pairs[:, pairs[1] != 0]
            yield pa.RecordBatch.from_arrays([pa.array(labels[a + pairs[0].astype(np.int64)]), pa.array(pairs[1].view(np.int64))], names=["y", "term"])


def learn_lexicon(docs: DataFrame, sample: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and beginnings that go with label 1, and their weights.

    Counts documents by term and label in Spark over the sampled rows; the
    driver gets all terms whose log-likelihood ratio shows that they go with label 1, a part of the sample's own.
    """
    texts = docs.join(F.broadcast(sample), "doc_id").select("text", F.col(label).cast("double").alias("y"))
    totals = sample.agg(F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)), F.count("*")).first()
    pos, neg = float(totals[0]), float(totals[1] - totals[0])
    if not pos or not neg:
        return np.zeros(0, U64), np.zeros(0)
    terms = texts.mapInArrow(_terms, "y double, term long").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a >= 2")
    a, b, p = F.col("a"), F.col("b"), F.lit(pos / (pos + neg))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (part(a, (a + b) * p) + part(b, (a + b) * (1 - p)))
    weight = F.log((a + 0.5) / pos) - F.log((b + 0.5) / neg)
    found = terms.select("term", weight.alias("w"), ratio.alias("g")).where("w > 1.5 and g > 8").collect()
    keys = np.array([r.term for r in found], np.int64).view(U64)
    order = np.argsort(keys)
    return keys[order], np.array([r.w for r in found])[order]


def _features(lexicon):
    def run(batches):
        keys, weights = lexicon.value
        for batch in batches:
            raw, offsets = byte_view(batch.column(1))
            got = [dense_features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keys, weights) for a, b in chunks(offsets)]
            x = np.concatenate(got).astype(np.float32) if got else np.zeros((0, len(NAMES)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float32()))], names=["doc_id", "x"])

    return run


def _score(model):
    def run(batches):
        trees, knots_x, knots_y = model.value
        for batch in batches:
            score = np.clip(np.interp(trees.raw(to_matrix(batch.column(1), len(NAMES))), knots_x, knots_y), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, bound: int = FIT_ROWS, lexicon_bound: int = LEXICON_ROWS, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Labels are learned only from documents whose crc32(doc_id) mod `modulus`
    is not `held`; half of those (by a hash of the id) teach the lexicon, of
    the others three quarters teach the trees and one quarter the calibration.  At most
    about `bound` rows of each class are used, `lexicon_bound` for the lexicon.
    Cases: a null or empty text has features of zero words and is scored;
    a null id is not held out and not learned from; without labels of both kinds
    scores follow the share of label 1; repeated rows give a row each; an
    empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = labels.where(remainder("doc_id", modulus) != held)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    words, _ = sample_labels(learn.where(half == 0), label, lexicon_bound)
    lexicon = spark.sparkContext.broadcast(learn_lexicon(rows, words, label))
    features = scratch.keep(rows.mapInArrow(_features(lexicon), "doc_id long, x array<float>"), "features")
    sample, counts = sample_labels(learn.where(half == 1), label, bound)
    x, y, weight, ids = training_rows(features, sample, label, counts, len(NAMES))
    aside = (mix(ids.astype(np.int64).view(U64)) & U64(3)) == 0
    trees = gbt.fit(x[~aside], y[~aside], weight[~aside])
    if aside.any():
        knots = gbt.isotonic(trees.raw(x[aside]), y[aside], weight[aside])
    else:
        knots = np.array([0.0]), np.array([float(gbt.sigmoid(np.array(trees.start)))])
    model = spark.sparkContext.broadcast((trees, *knots))
    held_out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out")
    return features.select("doc_id", "x", held_out).mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
