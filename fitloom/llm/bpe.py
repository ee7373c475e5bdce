"""Byte-level BPE by corpus-level merge replay, and its decoding.

Each task treats the documents it reads as a corpus of blocks.  The distinct
pieces of a block are laid out as one chain of symbols, an inverted index maps
each mergeable pair to the positions where it stands, and merges are applied in
rank order over all positions at once; only the two neighbours of a merged
position are touched.  Pieces seen before in the task are looked up.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import byte_view, chunks, released, small_batches

#: Pieces that a worker remembers; beyond that it forgets those that one block alone had, which costs time only.
REMEMBERED = 300_000
#: The pattern of the public rank files, and one that splits texts of plain
#: characters alike but runs faster; texts with any other character take the first.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TWIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xc0-\u024f]").search
#: What this worker process has built and encoded, by rank file.
_WORKER: dict[int, tuple] = {}
#: Text whose pieces are merged together.
BLOCK_BYTES = 4 << 20


def read_ranks(blob: bytes) -> list[bytes]:
    """Token bytes by rank, from the text of a rank file."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in blob.splitlines() if line)}
    return [ranks[i] for i in range(len(ranks))]


class MergeReplay:
    """Applies the merges of a rank list to many pieces at once."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        get, size = self.rank.get, len(tokens)
        pairs = [(x * size + y, r) for r, t in enumerate(tokens) for k in range(1, len(t)) if (x := get(t[:k])) is not None and (y := get(t[k:])) is not None]
        keys, ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        self._index(size, keys, ranks)

    def _index(self, size: int, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Lay the pairs (first * size + second) out by their first symbol and by their second one."""
        first, second = keys // size, keys % size
        self.size, self.sides = size, []
        for one, other in ((first, second), (second, first)):
            order = np.lexsort((other, one))
            bounds = np.searchsorted(one[order], np.arange(size + 1))
            self.sides.append((bounds.tolist(), other[order].astype(np.int32), ranks[order]))
        # Pairs of two bytes, which every piece begins as, are read off a square.
        self.place = np.full(size, -1, np.int32)
        self.place[self.single] = np.arange(256, dtype=np.int32)
        self.square = np.full(1 << 16, -1, np.int32)
        bytes_ = (self.place[first] >= 0) & (self.place[second] >= 0)
        self.square[self.place[first[bytes_]] << 8 | self.place[second[bytes_]]] = ranks[bytes_]

    def _ranks(self, symbol: int, side: int, others: np.ndarray) -> np.ndarray:
        """Rank of the token that symbol makes with each of the others after it (side 0) or before it (side 1), -1 where it makes none."""
        bounds, other, ranks = self.sides[side]
        a, b = bounds[symbol], bounds[symbol + 1]
        if a == b:
            return np.full(len(others), -1, np.int32)
        at = np.minimum(np.searchsorted(other[a:b], others), b - a - 1) + a
        return np.where(other[at] == others, ranks[at], np.int32(-1))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each piece: repeatedly its pair of lowest rank, leftmost first."""
        whole = [self.rank.get(p, -1) for p in pieces]
        open_ = [i for i, r in enumerate(whole) if r < 0 and pieces[i]]
        lens = np.array([len(pieces[i]) for i in open_], np.int64)
        symbol = self.single[np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)] if open_ else np.zeros(0, np.int32)
        ends = np.cumsum(lens)
        owner = np.repeat(np.arange(len(open_), dtype=np.int32), lens)
        self._merge(symbol, ends, owner)
        alive = symbol >= 0
        left = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
        ids = symbol[alive].astype("<u4").tobytes()
        out = [np.uint32(r).tobytes() if r >= 0 else b"" for r in whole]
        for k, i in enumerate(open_):
            out[i] = ids[left[k] : left[k + 1]]
        return out

    def _merge(self, symbol: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> None:
        n = len(symbol)
        next_, prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        if not n:
            return
        next_[ends - 1] = -1
        prev[np.concatenate([[0], ends[:-1]])] = -1
        pair = np.full(n, -1, np.int32)  # rank of the pair that starts at each position
        at = np.flatnonzero(next_ >= 0)
        byte = self.place[symbol]
        pair[at] = self.square[byte[at] << 8 | byte[at + 1]]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            ranks = pair[places]
            good = ranks >= 0
            places, ranks = places[good], ranks[good]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cut.tolist(), len(ranks)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    r = int(ranks[a])
                    if r in index:
                        index[r].append(places[a:b])
                    else:
                        index[r] = [places[a:b]]
                        heapq.heappush(heap, r)

        note(at)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            p = np.sort(lists[0] if len(lists) == 1 else np.concatenate(lists))
            p = p[pair[p] == rank]
            if len(p) > 1:
                p = p[np.concatenate([[True], p[1:] != p[:-1]])]
                touch = np.concatenate([[False], next_[p[:-1]] == p[1:]])
                if touch.any():  # overlapping places: of each run every second one, from its left end
                    run = np.maximum.accumulate(np.where(touch, 0, np.arange(len(p))))
                    p = p[(np.arange(len(p)) - run) % 2 == 0]
            if not len(p):
                continue
            mate = next_[p]
            after, before = next_[mate], prev[p]
            chained = np.concatenate([[False], before[1:] == mate[:-1]])  # the symbol before is merged just now, too
            right = np.where(after >= 0, self._ranks(rank, 0, symbol[after]), -1)
            left = np.where(before >= 0, self._ranks(rank, 1, np.where(chained, np.int32(rank), symbol[before])), -1)
            low = ((right >= 0) & (right < rank)) | ((left >= 0) & (left < rank))
            if low.any():  # there a pair of lower rank comes next: later places of that piece wait
                own = owner[p]
                first = {}
                for k in np.flatnonzero(low):
                    first.setdefault(int(own[k]), k)
                stop = np.array([first.get(int(o), len(p)) for o in own])
                wait = np.arange(len(p)) > stop
                if wait.any():
                    index[rank] = [p[wait]]
                    heapq.heappush(heap, rank)
                    p, mate, after, before, chained, right, left = (x[~wait] for x in (p, mate, after, before, chained, right, left))
            symbol[p] = rank
            symbol[mate] = -1
            pair[mate] = -1
            next_[p] = after
            has = after >= 0
            prev[after[has]] = p[has]
            # The symbol after a place is as it was, unless it is merged just now, too: then the place makes what the next one has to its left.
            followed = np.flatnonzero(chained)
            right[followed - 1] = left[followed]
            pair[p] = right
            outer = (before >= 0) & ~chained
            q = before[outer]
            pair[q] = left[outer]
            note(np.concatenate([p, q]))


def _encode(blob, pattern: str):
    def run(batches):
        key = zlib.crc32(blob.value)
        if key not in _WORKER:
            _WORKER[key] = MergeReplay(read_ranks(blob.value)), {}, set()
        replay, known, again = _WORKER[key]
        exact = regex.compile(pattern).findall
        fast = TWIN.findall if pattern == PATTERN else exact
        for batch in batches:
            _, offsets = byte_view(batch.column(1))
            ids, counts = [], []
            for a, b in chunks(offsets, BLOCK_BYTES):
                texts = [(exact if UNUSUAL(t) else fast)(t) for t in batch.column(1).slice(a, b - a).fill_null("").to_pylist()]
                seen = set(chain.from_iterable(texts))
                held = seen & known.keys()
                again |= held
                if len(known) + len(seen) - len(held) > REMEMBERED:
                    kept = {p: known[p] for p in again} if 2 * len(again) <= REMEMBERED else {}
                    known.clear()
                    known.update(kept)
                    again.clear()
                missing = list(seen - known.keys())
                known.update(zip(missing, replay.encode([p.encode() for p in missing]), strict=True))
                joined = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
                ids += joined
                counts += [len(j) // 4 for j in joined]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(blob):
    def run(batches):
        tokens = read_ranks(blob.value)
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array([len(t) for t in tokens], np.int64)
        first = np.cumsum(size) - size
        for batch in batches:
            raw, offsets = byte_view(batch.column(2))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                ids = raw[a:b].copy().view("<u4").astype(np.int64)
                lens = size[ids]
                ends = np.cumsum(lens)
                at = np.repeat(first[ids] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
                out.append(flat[at].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def _blob(docs: DataFrame, path: str):
    """The rank file (under 1 MB, whatever the corpus), read by the driver for all tasks."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    Every match of pattern is encoded by itself; no special tokens.  Cases: a
    null or empty text has no ids; a text of one very long piece takes
    n log n; repeated rows give a row each; an empty table gives none; other
    columns are not read.
    """
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(_encode(_blob(docs, ranks_path), pattern)), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for; no ids give no bytes."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(released(_decode(_blob(encoded, ranks_path))), "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What decode(encode(docs)) gives, by one worker a task rather than two."""
    blob = _blob(docs, ranks_path)
    to_ids, to_bytes = _encode(blob, pattern), _decode(blob)
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(lambda batches: to_bytes(to_ids(batches))), "doc_id long, n_tokens long, ids binary, decoded binary")
