"""Token counts by the whole-token shortcut.

Which vocabulary strings come out of the merges as one token is proved once, by
replaying the merges of the vocabulary's own strings.  A pre-token that is such a
string then counts one, without merging; only the rest is merged.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.bpe import TWIN, UNUSUAL, MergeReplay
from fitloom.llm.common import byte_view, chunks, released, small_batches

#: Text whose rest is merged together, and pre-tokens that a worker remembers; it forgets all beyond that, which costs time only.
BLOCK_BYTES, REMEMBERED = 4 << 20, 400_000
_WORKER: dict[int, Counter] = {}


class ListedMerges(MergeReplay):
    """Merges of listed pairs only, in list order; the k-th makes symbol 256 + k, and bytes are symbols 0 to 255."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        made = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.rank = {t: i for i, t in enumerate(made)}
        if len(self.rank) != len(made):
            raise ValueError("two merges make one token: their pairs can't be told from their place in the list")
        self.single, self.tokens = np.arange(256, dtype=np.int32), made
        keys = np.array([self.rank[a] * len(made) + self.rank[b] for a, b in merges], np.int64)
        self._index(len(made), keys, np.arange(256, len(made), dtype=np.int32))

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each non-empty piece, first symbol of each): merges alone, whatever the vocabulary holds."""
        ends = np.cumsum([len(p) for p in pieces])
        symbol = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self._merge(symbol, ends, np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(ends, prepend=0)))
        return np.add.reduceat((symbol >= 0).astype(np.int64), first), symbol[first]

    def proved(self) -> list[bytes]:
        """The tokens that encode alone as themselves, by their own merges one at a time (tokens are short)."""
        bounds, second, ranks = self.sides[0]
        made = {(a, b): r for a, b, r in zip(np.repeat(np.arange(self.size), np.diff(bounds)).tolist(), second.tolist(), ranks.tolist(), strict=True)}
        good = []
        for number, token in enumerate(self.tokens):
            symbols = list(token)
            while len(symbols) > 1:
                pairs = [made.get(p, self.size) for p in zip(symbols, symbols[1:], strict=False)]
                least = min(pairs)
                if least == self.size:
                    break
                at = pairs.index(least)
                symbols[at : at + 2] = [least]
            if symbols == [number]:
                good.append(token)
        return good


def _spelling() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabulary files: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """A byte-level BPE vocabulary file: its merges and the special strings that it finds inside texts."""

    def __init__(self, blob: bytes):
        rules = json.loads(blob)
        model, split = rules["model"], rules["pre_tokenizer"] or {}
        wanted = [
            model.get("type") in (None, "BPE"), not model.get("dropout"), not model.get("ignore_merges"), not model.get("end_of_word_suffix"), not model.get("continuing_subword_prefix"),
            rules["normalizer"] is None, split.get("type") == "ByteLevel", not split.get("add_prefix_space"), split.get("use_regex", True),
            not any(t[k] for t in rules["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        ]
        if not all(wanted):
            raise ValueError("only byte-level BPE files without normaliser and with plain special strings are counted")
        spelled = _spelling()
        as_bytes = lambda s: bytes(spelled[c] for c in s)
        self.merges = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.special = sorted((t["content"] for t in rules["added_tokens"]), key=len, reverse=True)


class Counter:
    """What one worker process knows: proven strings, and counts of at most REMEMBERED other pre-tokens."""

    def __init__(self, blob: bytes, proved: bytes):
        from tokenizers import Tokenizer

        found = Vocabulary(blob)
        self.replay = ListedMerges(found.merges)
        good = np.unpackbits(np.frombuffer(proved, np.uint8))[: len(self.replay.tokens)]
        self.whole: dict[str, int] = {}
        for token in (t for t, g in zip(self.replay.tokens, good, strict=True) if g):
            try:
                self.whole[token.decode()] = 1
            except UnicodeDecodeError:  # part of a character: no pre-token is just that
                pass
        self.rest: dict[str, int] = {}
        self.library = Tokenizer.from_str(blob.decode()).pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, found.special))) if found.special else None

    def _pieces(self, text: str) -> list[str]:
        if UNUSUAL(text) is None:
            return TWIN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _split(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens between special strings, special strings) of a text."""
        if self.special is None or self.special.search(text) is None:
            return self._pieces(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self._pieces(part)], len(parts) - 1

    def counts(self, texts: list[str]) -> np.ndarray:
        split = [self._split(t) for t in texts]
        size = np.array([len(p) for p, _ in split], np.int64)
        flat = list(chain.from_iterable(p for p, _ in split))
        n = np.fromiter(map(self.whole.get, flat, repeat(0)), np.int64, len(flat))
        other = np.flatnonzero(n == 0)
        words = [flat[i] for i in other]
        new = [w for w in set(words) if w not in self.rest]
        if len(self.rest) + len(new) > REMEMBERED:
            self.rest.clear()
            new = list(set(words))
        if new:
            self.rest.update(zip(new, self.replay.symbols([w.encode() for w in new])[0].tolist(), strict=True))
        n[other] = np.fromiter(map(self.rest.__getitem__, words), np.int64, len(words))
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(size)
        return total[ends] - total[ends - size] + np.array([s for _, s in split], np.int64)


def _count(blob, proved):
    def run(batches):
        key = zlib.crc32(blob.value)
        if key not in _WORKER:
            _WORKER[key] = Counter(blob.value, proved.value)
        counter = _WORKER[key]
        for batch in batches:
            _, offsets = byte_view(batch.column(1))
            found = [counter.counts(batch.column(1).slice(a, b - a).fill_null("").to_pylist()) for a, b in chunks(offsets, BLOCK_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: as the tokenizers library counts, without added special tokens.

    One narrow pass: the vocabulary (a few MB, whatever the corpus) and a bit for
    each of its tokens go to the tasks; nothing is shuffled.  A special string
    inside a text counts one and ends the pre-tokens around it; characters
    beyond plain Latin are split by the library's own splitter, whose classes follow
    its own edition of Unicode.  Cases: a null or empty text has no bytes
    and no tokens; a text of one very long pre-token takes n log n; repeated
    rows and null ids give a row each; an empty table gives none; other columns are not read.
    """
    with open(vocabulary_path, "rb") as f:
        blob = f.read()
    replay = ListedMerges(Vocabulary(blob).merges)
    good = set(replay.proved())
    proved = np.packbits(np.array([t in good for t in replay.tokens], np.uint8)).tobytes()
    context = docs.sparkSession.sparkContext
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(released(_count(context.broadcast(blob), context.broadcast(proved))), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
