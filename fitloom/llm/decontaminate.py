"""Benchmark decontamination by greedy string tiling.

Shared runs of tokens seed candidate (document, item) pairs; for those, the
longest common runs that do not overlap are marked again and again, found by
Karp-Rabin hashes of falling length, and an item counts as contained when the
tiles cover enough of it, in whatever order they stand in the document.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import U64, WORDLIKE, byte_view, chunks, mix, released, small_batches, stream, word_hashes

#: Tokens of the shortest tile, and the share of an item's tokens that tiles must cover.
LEAST_TILE, COVERAGE = 5, 0.5
#: Benchmark text that is held by a task at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 8 << 20


def _tokens(raw: np.ndarray, offsets: np.ndarray):
    return word_hashes(raw, offsets, WORDLIKE, accents=True)


def _grams(tokens: np.ndarray, size: int) -> np.ndarray:
    keys = stream(61, size) | U64(1)
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = tokens[:n] * keys[0]
    for j in range(1, size):
        total = total + tokens[j : n + j] * keys[j]
    return mix(total)


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length) that greedy string tiling marks.

    Each round marks the longest runs of unmarked tokens common to both that
    are at least `size` long, longest first, then goes on to shorter ones.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text)))
    base = U64(0x9E3779B97F4A7C15)

    def hashes(tokens: np.ndarray, free: np.ndarray, n: int) -> np.ndarray:
        """Rolling hash of every window of n tokens, 0 where one is marked."""
        if len(tokens) < n:
            return np.zeros(0, U64)
        steps = np.concatenate([[U64(0)], np.cumsum(tokens * np.cumprod(np.full(len(tokens), base, U64)))])
        window = (steps[n:] - steps[:-n]) * np.cumprod(np.full(len(tokens) - n + 1, _inverse(base), U64))
        blocked = np.concatenate([[0], np.cumsum(~free)])
        return np.where(blocked[n:] == blocked[:-n], mix(window) | U64(1), U64(0))

    while size >= least:
        places = defaultdict(list)
        for p, h in enumerate(hashes(item, free_item, size).tolist()):
            if h:
                places[h].append(p)
        found = []
        if places:
            window = hashes(text, free_text, size)
            keys = np.sort(np.array(list(places), U64))
            near = keys[np.minimum(np.searchsorted(keys, window), len(keys) - 1)] == window
            for t in np.flatnonzero(near & (window != 0)).tolist():
                for p in places[int(window[t])]:
                    if not (item[p : p + size] == text[t : t + size]).all():
                        continue
                    n = size
                    while p + n < len(item) and t + n < len(text) and free_item[p + n] and free_text[t + n] and item[p + n] == text[t + n]:
                        n += 1
                    found.append((n, p, t))
        longest = max((n for n, _, _ in found), default=0)
        for n, p, t in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if n == longest and free_item[p : p + n].all() and free_text[t : t + n].all():
                free_item[p : p + n] = free_text[t : t + n] = False
                out.append((p, t, n))
        if longest <= size:  # no run of this length is left: the next shorter one that may be
            size = size // 2 if size >= 4 * least else size - 1
    return out


def _inverse(x: np.uint64) -> np.uint64:
    """The odd number that gives 1 with odd x, modulo 2 ** 64."""
    return U64(pow(int(x), -1, 1 << 64))


class Seeds:
    """The runs of tokens of a block of benchmark items, by hash."""

    def __init__(self, ids: list, texts: list[str], least: int):
        data = [t.encode() for t in texts]
        raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        words, row = _tokens(raw, offsets)
        self.ids, self.items = ids, [words[row == i] for i in range(len(ids))]
        by_size = defaultdict(list)
        for i, item in enumerate(self.items):
            if len(item):
                size = min(least, len(item))  # an item shorter than a tile must stand there whole
                by_size[size] += [(int(h), i, p) for p, h in enumerate(_grams(item, size).tolist())]
        self.by_size = {}
        for size, rows in by_size.items():
            rows.sort()
            self.by_size[size] = np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def contained(self, text: np.ndarray, coverage: float, least: int) -> list[tuple]:
        """(item id, tiles, tokens covered, tokens) of the items that text contains."""
        bounds: dict[int, set[int]] = defaultdict(set)
        for size, (keys, item, place) in self.by_size.items():
            grams = np.unique(_grams(text, size))
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            for g in grams[keys[at] == grams]:
                for k in range(int(np.searchsorted(keys, g)), int(np.searchsorted(keys, g, "right"))):
                    bounds[int(item[k])].update(range(int(place[k]), int(place[k]) + size))
        out = []
        for i, covered in sorted(bounds.items()):
            tokens = self.items[i]
            # Tiles lie within the seeds that were met, so these bound the coverage.
            if len(covered) < coverage * len(tokens):
                continue
            got = tiles(tokens, text, min(least, len(tokens)))
            total = sum(n for _, _, n in got)
            if total >= coverage * len(tokens):
                out.append((self.ids[i], len(got), total, len(tokens)))
        return out


def _each(block, coverage: float, least: int, text_at: int):
    """(batch, hits of each row) of every batch."""

    def run(batches):
        seeds = Seeds(*block.value, least)
        any_size = list(seeds.by_size.items())
        for batch in batches:
            raw, offsets = byte_view(batch.column(text_at))
            hits: list[list[tuple]] = []
            for a, b in chunks(offsets):
                words, row = _tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flagged = np.zeros(b - a, bool)
                for size, (keys, _, _) in any_size:
                    grams = _grams(words, size)
                    same = row[: len(grams)] == row[size - 1 :][: len(grams)]
                    hit = same & (keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams)
                    flagged[row[: len(grams)][hit]] = True
                lo, hi = np.searchsorted(row, np.arange(b - a)), np.searchsorted(row, np.arange(b - a), "right")
                hits += [seeds.contained(words[lo[i] : hi[i]], coverage, least) if flagged[i] else [] for i in range(b - a)]
            yield batch, hits

    return run


def _blocks(benchmark: DataFrame):
    """Broadcast blocks (ids, texts) of the benchmark, BLOCK_BYTES each at most or one item."""
    sc = benchmark.sparkSession.sparkContext
    ids, texts, held = [], [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        if ids and held + len(r.text) > BLOCK_BYTES:
            yield sc.broadcast((ids, texts))
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text)
    if ids:
        yield sc.broadcast((ids, texts))


def contained_items(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_TILE) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, item_tokens, coverage) of each benchmark item that a document contains.

    Tokens are runs of letters and digits, lower-cased.  The benchmark goes to
    the tasks in blocks of bounded size, with one pass over docs for each block.
    Cases: null or empty texts on either side contain and match nothing; an
    item shorter than `least` tokens must stand in the document whole; repeated
    documents give rows each, and so do repeated items; a null id is passed on.
    """

    def rows(block):
        def run(batches):
            for batch, hits in _each(block, coverage, least, 1)(batches):
                ids = batch.column(0).to_pylist()
                flat = [(d, *h, h[2] / h[3]) for d, found in zip(ids, hits, strict=True) for h in found]
                columns = list(zip(*flat, strict=True)) if flat else [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "n_tiles", "covered", "item_tokens", "coverage"])

        return run

    schema = "doc_id long, item_id long, n_tiles long, covered long, item_tokens long, coverage double"
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(_blocks(benchmark.withColumn("item_id", F.col("item_id").cast("long")))):
        found = source.mapInArrow(released(rows(block)), schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_TILE) -> DataFrame:
    """The rows of docs, with all their columns, that contain no benchmark item; nothing is shuffled."""

    def keep(block, at):
        def run(batches):
            for batch, hits in _each(block, coverage, least, at)(batches):
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        return run

    for block in _blocks(benchmark.withColumn("item_id", F.col("item_id").cast("long"))):
        docs = small_batches(docs).mapInArrow(released(keep(block, docs.columns.index("text"))), docs.schema)
    return docs
