import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fitloom.llm import bpe, tokenfile
from fitloom.llm.queries import tokenizer_file

TEXTS = ["", None, "a", "The theatre's  THEME\n\n is 42,000 (forty-two)!! don't", "aaaaaaaaaaaaaaaaa abababababab", "naïve Ärger ß ½ ²x ٣ 漢字かな é İ ΣΑΣ.  x y\x1cz\x85q", "<|endoftext|> <|startoftext|>x", "x" * 5000, "word, word. Word! WORD? it's 'sting", "the ́x", "\U0001f600 emoji‍"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "again", "x"), (None, "null id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_bpe_equals_the_library(spark, docs):
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, path, bpe.PATTERN), path).collect()
    assert len(got) == len(TEXTS) + 2
    texts = {(i, t) for i, t in enumerate(TEXTS)} | {(3, "again"), (None, "null id")}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert any(d == r.doc_id and ids == lib.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode() and r.n_tokens == len(ids) for d, t in texts)
    assert bpe.encode(docs.limit(0), path, bpe.PATTERN).count() == 0
    rows = lambda df: sorted((repr(r.asDict()) for r in df.collect()))
    assert rows(bpe.round_trip(docs, path, bpe.PATTERN)) == rows(bpe.decode(bpe.encode(docs, path, bpe.PATTERN), path))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abehit no.!'1\né", max_size=60), max_size=5))
def test_merge_replay_on_small_alphabets(texts):
    import tiktoken

    blob = open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb").read()
    tokens = bpe.read_ranks(blob)
    replay = _cached(tokens)
    lib = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = replay.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=40), max_size=4), st.permutations(["ab", "bc", "abc", "ca", "aa", "aba", "bb", "cab", "bca", "abab", "aab"]))
def test_merge_replay_with_ranks_out_of_order(texts, order):
    """Ranks that no training gives, where a merge makes a pair of lower rank."""
    tokens = [bytes([b]) for b in range(256)] + [t.encode() for t in order]
    rank = {t: i for i, t in enumerate(tokens)}

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        if piece in rank:
            return [rank[piece]]
        while True:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
            if best is None:
                return [rank[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    got = bpe.MergeReplay(tokens).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t.encode()) for t in texts]


def test_pieces_that_come_again_are_merged_once(monkeypatch):
    """A full memory forgets the pieces of one block alone; those of several blocks stay, and no id changes."""
    import pyarrow as pa
    import tiktoken

    blob = open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb").read()
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(blob))}, special_tokens={})
    again = [f" zq{c}xvw" for c in "abcdefgh"]
    texts = ["".join(again) + "".join(f" qx{chr(97 + k)}{chr(97 + j)}zv" for j in range(20)) for k in range(20)]
    merged, plain = [], bpe.MergeReplay.encode
    monkeypatch.setattr(bpe.MergeReplay, "encode", lambda self, pieces: merged.extend(pieces) or plain(self, pieces))
    monkeypatch.setattr(bpe, "_WORKER", {})
    monkeypatch.setattr(bpe, "REMEMBERED", 80)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1)  # a block a text
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    (got,) = bpe._encode(type("Blob", (), {"value": blob}), bpe.PATTERN)([batch])
    assert [np.frombuffer(x, "<u4").tolist() for x in got.column(2).to_pylist()] == [lib.encode_ordinary(t) for t in texts]
    assert all(merged.count(p.encode()) == 1 for p in again) and len(merged) == 8 + 400
    ((_, known, _),) = bpe._WORKER.values()
    assert len(known) <= 80


_REPLAY = {}


def _cached(tokens):
    return _REPLAY.setdefault(0, bpe.MergeReplay(tokens))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=600), st.booleans())
def test_elias_fano_round_trip(steps, wide):
    values = np.cumsum(np.array(steps, np.int64) * (1_000_000_007 if wide else 1))
    code, _ = tokenfile.EliasFano.read(memoryview(tokenfile.EliasFano.of(values).to_bytes()), 0)
    assert [int(x) for block in code.blocks() for x in block] == values.tolist()
    for i in {0, len(values) // 2, len(values) - 1} if len(values) else ():
        assert code.select(i)[0] == values[i]
    assert code.directory.nbytes <= 4 * (len(values) // code.SAMPLE + 1)


def test_a_shard_is_read_by_select(monkeypatch):
    turn = np.random.default_rng(5)
    ids = [None, None, *sorted(turn.integers(-(2**63), 2**63 - 1, 3000).tolist())]
    lengths = turn.integers(1, 9, len(ids)).tolist()
    body = turn.integers(0, 60_000, sum(lengths)).astype("<u2")
    shard = tokenfile.Shard(tokenfile.pack_shard(ids, lengths, body.tobytes(), 2))
    ends = np.cumsum(lengths)
    for i in (0, 1, 2, 255, 256, 257, len(ids) - 1):
        assert shard.document(i) == (ids[i], ends[i] - lengths[i], ends[i])
    calls, plain = [], tokenfile.EliasFano.select
    monkeypatch.setattr(tokenfile.EliasFano, "select", lambda self, first, count=1: calls.append(count) or plain(self, first, count))
    got = [(d, int(a), int(b)) for docs, starts, stops in shard.documents() for d, a, b in zip(docs, starts, stops, strict=True)]
    assert got == [(d, b - n, b) for d, n, b in zip(ids, lengths, ends.tolist(), strict=True)]
    assert sum(calls) == len(ids) + len(ids) - 2 and max(calls) <= tokenfile.EliasFano.SAMPLE  # no boundary comes from elsewhere


def test_a_word_table_reads_its_rules_once(monkeypatch):
    """A worker's start costs one reading of the vocabulary file, and every Latin letter of two bytes is spelled as the library spells it."""
    from tokenizers import Tokenizer

    blob, read, plain = open(tokenizer_file("word_bpe_49k.json"), "rb").read(), [], tokenfile.json.loads
    monkeypatch.setattr(tokenfile.json, "loads", lambda text: read.append(len(text)) or plain(text))
    table = tokenfile.WordTable(blob, "<u2")
    assert len(read) == 1
    text = " ".join("xq" + chr(c) + "w" for c in range(0xC0, 0x100)) + " plain words"
    got = table.encode(np.frombuffer(text.encode(), np.uint8))[0]
    assert got.tolist() == Tokenizer.from_str(blob.decode()).encode(text, add_special_tokens=False).ids


WORDS = ["the", "Word,", "naïve", "ÀÉ", "don't", "x" * 50, "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "42", "foo,bar;", "e\u0301.", "ΑΣ", "İ.", "…,", "×÷", "漢字", "K", "s", "''re", "**bold**", "x's", "'twas", "a1b2", "£5", "\u00a0", "\x1c", "straße!", "ÿ?", "A.B.C."]


def test_word_table_equals_the_library(monkeypatch):
    table = tokenfile.WordTable(open(tokenizer_file("word_bpe_49k.json"), "rb").read(), "<u2")
    turn = random.Random(6)
    for piece in [7, 40, 1 << 20] * 60:
        texts = ["".join(turn.choice(WORDS) + turn.choice([" ", "\n", "\t ", "", "", ".", "'", "1"]) for _ in range(turn.randrange(14))) for _ in range(turn.randrange(7))]
        data = [t.encode() for t in texts]
        monkeypatch.setattr(tokenfile, "PIECE_BYTES", piece)
        got = []
        for _, sizes, ids in table.documents(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)):
            assert sum(sizes) == len(ids)
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [table.whole.encode(t, add_special_tokens=False).ids for t in texts]



def test_shards_hold_the_library_ids(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    tokenfile.write_tokens(docs, f"file://{tmp_path}/t", path)
    got = sorted(tokenfile.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0)) and len(got) == len(TEXTS) + 2
    texts = {(i, t) for i, t in enumerate(TEXTS)} | {(3, "again"), (None, "null id")}
    start = 0
    for r in got:
        assert r.start == start
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert any(d == r.doc_id and ids == [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts), r
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    tokenfile.write_tokens(docs.limit(0), f"file://{tmp_path}/e", path)
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_digests_of_query_nine(spark, docs):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    empty = [r for r in bpe.encode(docs, path, bpe.PATTERN).collect() if r.doc_id == 0][0]
    assert hashlib.sha256(bytes(empty.ids)).hexdigest() == hashlib.sha256(b"").hexdigest()
