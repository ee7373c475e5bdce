"""Document quality: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm import gbt
from fitloom.llm.common import SPACE, Scratch, byte_view, chunks, small_batches, word_hashes
from fitloom.llm.labelled import remainder, sample_labels

#: Labelled rows of each class that the trees are fitted on, at most.
FIT_ROWS = 8_000

NAMES = [
    "log_words", "log_bytes", "mean_word", "upper", "digit", "punct", "bang", "pipe", "symbol", "space", "high_bytes", "lines_per_word", "distinct_words", "top_run",
    "repeat_next", "long_words", "short_words", "symbol_run", "distinct_lines", "stop_end",
]

_CLASS = {name: np.zeros(256, bool) for name in ("upper", "digit", "punct", "symbol")}
_CLASS["upper"][65:91] = True
_CLASS["digit"][48:58] = True
_CLASS["punct"][[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
_CLASS["symbol"][[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = True


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, len(NAMES)) of the whole texts; all zero for an empty one."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    bytes_ = np.maximum(size, 1)
    words, row = word_hashes(raw, offsets)
    lo, hi = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
    count = (hi - lo).astype(float)
    each = np.maximum(count, 1)
    solid = _sums(~SPACE[raw], offsets)
    same = np.concatenate([[False], (words[1:] == words[:-1]) & (row[1:] == row[:-1])])
    order = np.lexsort((words, row))
    w, r = words[order], row[order]
    first = np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])]) if len(w) else np.zeros(0, bool)
    distinct = np.bincount(r[first], minlength=n).astype(float)
    starts = np.flatnonzero(first)
    often = np.diff(np.concatenate([starts, [len(w)]])) if len(starts) else np.zeros(0, np.int64)
    top = np.zeros(n)
    np.maximum.at(top, r[starts], often)
    symbol = _CLASS["symbol"][raw]
    pair = np.concatenate([symbol[1:] & symbol[:-1] & (raw[1:] == raw[:-1]), [False]]) if len(raw) else symbol
    lines = _sums(raw == 10, offsets) + (size > 0)
    # Word lengths: bytes between the starts of white-space words.
    body = ~SPACE[raw]
    start = body.copy()
    start[1:] &= ~body[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = body[heads]
    at = np.flatnonzero(start)
    total = np.concatenate([[0], np.cumsum(body)])
    length = total[np.concatenate([at[1:], [len(raw)]])] - total[at] if len(at) else np.zeros(0, np.int64)
    long_, short = np.bincount(row[length > 14], minlength=n), np.bincount(row[length < 3], minlength=n)
    newline = raw == 10
    stop = np.isin(raw, (46, 33, 63, 124))
    ended = np.concatenate([stop[:-1] & newline[1:], [False]]) if len(raw) else stop
    columns = [
        np.log1p(count), np.log1p(size), solid / each, _sums(_CLASS["upper"][raw], offsets) / bytes_, _sums(_CLASS["digit"][raw], offsets) / bytes_, _sums(_CLASS["punct"][raw], offsets) / bytes_,
        _sums(raw == 33, offsets) / each, _sums(raw == 124, offsets) / each, _sums(symbol, offsets) / each, (size - solid) / bytes_, _sums(raw > 127, offsets) / bytes_, lines / each,
        distinct / each, top / each, np.bincount(row[same], minlength=n) / each, long_ / each, short / each, _sums(pair, offsets) / each, _sums(ended, offsets) / np.maximum(lines, 1), _sums(stop, offsets) / each,
    ]
    return np.stack(columns, 1) * (size > 0)[:, None]


def _features(batches):
    for batch in batches:
        raw, offsets = byte_view(batch.column(1))
        got = [statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
        x = np.concatenate(got).astype(np.float32) if got else np.zeros((0, len(NAMES)), np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float32()))], names=["doc_id", "x"])


def to_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def training_rows(features: DataFrame, sample: DataFrame, label: str, counts: dict, width: int):
    """(x, y, weight, doc ids) of the sampled rows; weights restore the classes' shares.

    The sample's bound (some ten thousand ids) is what lets it be broadcast.
    """
    rows = features.join(F.broadcast(sample), "doc_id").select("doc_id", "x", F.col(label).cast("double").alias("y")).toArrow().combine_chunks()
    x = np.asarray(rows["x"].combine_chunks().flatten(), np.float64).reshape(-1, width) if len(rows) else np.zeros((0, width))
    y, ids = np.asarray(rows["y"], float), np.asarray(rows["doc_id"], np.int64)
    order = np.lexsort((y, ids))  # the same model whatever order the rows come in
    x, y, ids = x[order], y[order], ids[order]
    weight = np.ones(len(y))
    for value, n in counts.items():
        here = y == float(value)
        weight[here] = n / max(here.sum(), 1)
    return x, y, weight / max(weight.mean(), 1e-9) if len(y) else weight, ids


def _score(model):
    def run(batches):
        trees = model.value
        for batch in batches:
            score = gbt.sigmoid(trees.raw(to_matrix(batch.column(1), len(NAMES))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, bound: int = FIT_ROWS, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    The trees are fitted on at most about `bound` labelled rows of each class,
    of documents whose crc32(doc_id) mod `modulus` is not `held`; only the text
    gives statistics.  Cases: a null or empty text has statistics of zero and
    is scored like any other; a null id is not held out and not learned from;
    without labels every score is 0.5; repeated rows give a row each; an empty
    table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = scratch.keep(rows.mapInArrow(_features, "doc_id long, x array<float>"), "features")
    sample, counts = sample_labels(labels.where(remainder("doc_id", modulus) != held), label, bound)
    x, y, weight, _ = training_rows(features, sample, label, counts, len(NAMES))
    model = spark.sparkContext.broadcast(gbt.fit(x, y, weight))
    held_out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out")
    return features.select("doc_id", "x", held_out).mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
