"""Repeated substrings of a given length, by prefix-free parsing.

A rolling hash triggers a parse: in each window of `length` bytes the place of
its least hash is a trigger, so each window holds one, and equal windows hold
theirs at the same place whatever stands around them.  Windows of one trigger
are dealt into phrases: a run of neighbouring windows at set distances from it.
Phrases are a dictionary with two keys each:

* the core, the bytes that all windows at these distances share.  A core that
  occurs once proves that none of its windows is repeated;
* the whole, the bytes of all its windows together.  A whole that occurs
  twice proves that all of them are.

Only where wholes of one core differ (at the ends of copied passages and around
edits) are windows compared one by one, and there each different whole but
once.  Since windows need equality to a depth of `length` only, classes of
equal keys stand for ranks in the suffix order; a full suffix array of the
corpus, several times its size, is never formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import BASE, BYTE_VALUE, U64, Scratch, byte_view, mix, small_batches

#: Bytes of the rolling hash, and distances from a trigger that share a phrase.
GRAM, STEP = 16, 128
#: Bytes of a document that are parsed at once; a longer one is parsed in overlapping parts.
PART_BYTES = 1 << 20
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
PLACE_BITS = U64(30)


class Rolling:
    """Hashes of any substring from prefix sums."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(BYTE_VALUE[raw] * np.cumprod(np.full(len(raw), BASE, U64)), out=self.sums[1:])
        self.back = np.cumprod(np.concatenate([[U64(1)], np.full(len(raw), INVERSE, U64)]))

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.back[start])


def _least_place(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of each `width` neighbours, the leftmost of equals."""
    held = (values >> PLACE_BITS << PLACE_BITS) | np.arange(len(values), dtype=U64)
    reach = 1
    while reach * 2 <= width:
        held = np.minimum(held[:-reach], held[reach:])
        reach *= 2
    if reach < width:
        held = np.minimum(held[: len(values) - width + 1], held[width - reach :])
    return (held & ((U64(1) << PLACE_BITS) - U64(1))).astype(np.int64)


def phrases(raw: np.ndarray, offsets: np.ndarray, length: int):
    """(row, first window, windows, core, whole) of every phrase; windows never leave their row."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(U64), none.astype(U64)
    roll = Rolling(raw)
    gram = min(GRAM, length)
    span = length - gram + 1
    trigger = _least_place(roll.of(np.arange(len(raw) - gram + 1), gram), span)
    window = np.arange(len(trigger))
    row = np.searchsorted(offsets, window, "right") - 1
    inside = window + length <= offsets[row + 1]
    window, trigger = window[inside], trigger[inside]
    if not len(window):
        return none, none, none, none.astype(U64), none.astype(U64)
    cut = np.flatnonzero((trigger[1:] != trigger[:-1]) | (window[1:] != window[:-1] + 1)) + 1
    first, last = window[np.concatenate([[0], cut])], window[np.concatenate([cut, [len(window)]]) - 1]
    at = trigger[np.concatenate([[0], cut])]
    near, far = at - last, at - first  # distances of the windows' starts to their trigger
    pieces = far // STEP - near // STEP + 1
    of = np.repeat(np.arange(len(at)), pieces)
    band = near[of] // STEP + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low, high = np.maximum(near[of], band * STEP), np.minimum(far[of], band * STEP + STEP - 1)
    at = at[of]
    # The core of a band: from its nearest start to the end of its farthest window.
    reach = min(STEP, span) - 1
    core_at, core_end = at - band * STEP, at - (band * STEP + reach) + length
    core_end = np.where(band * STEP + reach > span - 1, at - (span - 1) + length, core_end)
    whole_at = at - high
    core = mix(roll.of(core_at, core_end - core_at) + band.astype(U64))
    whole = mix(roll.of(whole_at, high - low + length) + low.astype(U64) * U64(977) + high.astype(U64) * U64(131071))
    return np.searchsorted(offsets, whole_at, "right") - 1, whole_at, high - low + 1, core, whole


def _parts(offsets: np.ndarray, length: int, part: int):
    """(first row, one beyond the last, skip, end) of stretches to parse: whole rows, or overlapping parts of a long one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > part:
            size = int(offsets[i + 1] - offsets[i])
            for a in range(0, size - length + 1, part):
                yield i, i + 1, a, min(size, a + part + length - 1)
            i += 1
            continue
        j = i
        while j < n and offsets[j + 1] - offsets[i] <= part:
            j += 1
        yield i, j, 0, int(offsets[j] - offsets[i])
        i = j


def _parse(length: int, part: int):
    def run(batches):
        for batch in batches:
            raw, offsets = byte_view(batch.column(2))
            for i, j, skip, end in _parts(offsets, length, part):
                start = offsets[i] + skip
                at = np.array([0, end - skip]) if j == i + 1 else offsets[i : j + 1] - offsets[i]
                row, first, count, core, whole = phrases(raw[start : offsets[i] + end], at, length)
                rows = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(first - at[row] + skip, pa.int64()), pa.array(count, pa.int64())],
                    names=["doc", "mark", "core", "whole", "start", "n"],
                )

    return run


def _windows(length: int, part: int):
    """Every window of the phrases listed with each text."""

    def run(batches):
        for batch in batches:
            raw, offsets = byte_view(batch.column(2))
            lists = batch.column(3)
            inner, bounds = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            start, n, core = (np.asarray(inner.field(k), np.int64) for k in range(3))
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                s, count, c = (x[bounds[i] : bounds[i + 1]] for x in (start, n, core))
                order = np.argsort(s, kind="stable")
                s, count, c = s[order], count[order], c[order]
                a = 0
                while a < len(s):  # neighbouring phrases together, within a stretch of bounded size
                    b = int(np.searchsorted(s, s[a] + part, "left"))
                    piece = text[s[a] : int((s[a:b] + count[a:b]).max()) + length - 1]
                    roll = Rolling(piece)
                    where = np.repeat(s[a:b] - s[a], count[a:b]) + np.arange(count[a:b].sum()) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
                    keys = roll.of(where, length).view(np.int64)
                    rows = pa.array(np.full(len(where), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.repeat(c[a:b], count[a:b])), pa.array(keys), pa.array(where + s[a])], names=["doc", "mark", "core", "key", "start"])
                    a = b

    return run


def _cut(batches):
    """What is left of each text without its runs."""
    for batch in batches:
        raw, offsets = byte_view(batch.column(1))
        lists = batch.column(2)
        inner, bounds = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        start, end = (np.asarray(inner.field(k), np.int64) for k in range(2))
        valid = np.asarray(lists.is_valid())
        removed, spans, left, runs = [], [], [], []
        for i in range(batch.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            found = []
            if valid[i] and bounds[i + 1] > bounds[i]:
                s, e = start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]]
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                found = list(zip(s[new].tolist(), e[np.concatenate([np.flatnonzero(new)[1:], [len(s)]]) - 1].tolist(), strict=True))
            keep = np.ones(len(text), bool)
            for a, b in found:
                keep[a:b] = False
            removed.append(len(text) - int(keep.sum()))
            spans.append(len(found))
            left.append(text[keep].tobytes())
            runs.append([{"start": a, "end": b} for a, b in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left, pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "runs"],
        )


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", part: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, runs), one row per input row.

    Removes each byte that a string of `length` bytes covers which also starts
    anywhere else, in the same text or another; kept has the bytes left, runs
    the maximal removed stretches (start, end).  Texts count as UTF-8 bytes and
    strings are judged on the input.  Cases: a null or empty text, or one
    shorter than length, loses nothing by itself; rows that repeat, ids that
    repeat and null ids (the smallest long counts as null) are rows of their own, so copies lose all that is long
    enough; an empty table gives no row; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    # A row is known by its id and a hash of its text; rows alike in both share their runs.
    rows = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.col(text_col).cast("string"), F.col(id_col).isNull()).alias("mark"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parsed = scratch.keep(rows.mapInArrow(_parse(length, part), "doc long, mark long, core long, whole long, start long, n long"), "phrases")
    # A table of its own, so that both sides of the join are shuffled for it and AQE can split a core that very many texts hold.
    cores = parsed.groupBy("core").agg(F.count("*").alias("seen"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("seen > 1").select("core", (F.col("a") == F.col("b")).alias("alike"))
    cores = scratch.keep(cores, "cores")
    alive = scratch.keep(parsed.join(cores, "core"), "alive")
    scratch.drop(parsed)
    differ = alive.where(~F.col("alike"))
    wholes = scratch.keep(differ.groupBy("core", "whole").agg(F.count("*").alias("seen"), F.min(F.struct("doc", "mark", "start", "n")).alias("one")), "wholes")
    repeated = alive.where("alike").select("doc", "mark", "start", "n").unionByName(differ.join(wholes.where("seen > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("doc", "mark", "start", "n"))
    single = scratch.keep(wholes.groupBy("core").agg(F.min("seen").alias("least")).where("least = 1").select("core"), "single")
    compared = wholes.join(single, "core", "left_semi").select("one.doc", "one.mark", F.struct(F.col("one.start").alias("start"), F.col("one.n").alias("n"), "core").alias("p")).groupBy("doc", "mark").agg(F.collect_list("p").alias("ps"))
    windows = rows.join(compared, ["doc", "mark"]).select("doc", "mark", "text", "ps").mapInArrow(_windows(length, part), "doc long, mark long, core long, key long, start long")
    windows = scratch.keep(windows, "windows")
    twice = windows.groupBy("core", "key").count().where("count > 1").select("core", "key")
    found = windows.join(twice, ["core", "key"], "left_semi").select("doc", "mark", "start", F.lit(1).cast("long").alias("n"))
    runs = repeated.unionByName(found).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") - 1 + length).alias("end"))).alias("runs"))
    ids = F.when(F.col("doc") != -(2**63), F.col("doc"))
    full = rows.join(runs, ["doc", "mark"], "left").select(ids.alias("doc_id"), "text", "runs")
    return full.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, runs array<struct<start:long,end:long>>")
