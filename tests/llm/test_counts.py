import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fitloom.llm import counts
from fitloom.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
ODD = ["", None, "a", "it's don't we'll", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", " a  b \n\n c\t", "x" * 40_000, "naïve Ärger ß ½ ²x ٣ 漢字かな é İ", "\x1cz\x85q x y", "😀 emoji‍", "՘a ₏1 ꟎.", "a\x00b", "ab " * 5000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        blob = f.read()
    replay = counts.ListedMerges(counts.Vocabulary(blob).merges)
    good = set(replay.proved())
    import numpy as np

    return counts.Counter(blob, np.packbits(np.array([t in good for t in replay.tokens], np.uint8)).tobytes())


def test_equals_the_library_on_odd_rows(spark, library):
    rows = [(i, t, 0, "c") for i, t in enumerate(ODD)] + [(0, "again", 1, "c"), (None, "null id", 1, "c")]
    frame = spark.createDataFrame(rows, "Doc_id long, TEXT string, n_tokens int, over_limit string")
    got = sorted(map(tuple, counts.token_counts(frame, PATH, limit=4).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 4) for i, t, _, _ in rows]
    assert got == sorted(want, key=repr)
    assert counts.token_counts(frame.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from([" the", "<|endoftext|>", "'re", "  ", "\n", "Étion", "zzzz", "12345"])), max_size=12))
def test_equals_the_library_on_any_text(library, counter, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert counter.counts([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_every_proven_string_is_one_token_and_no_other_is(library, counter):
    model = type(library).from_file(PATH)
    words = [t.decode(errors="ignore") for t in counter.replay.tokens]
    turn = random.Random(4)
    for w in turn.sample(words, 4000):
        if w and [p for p, _ in model.pre_tokenizer.pre_tokenize_str(w)] and len(model.pre_tokenizer.pre_tokenize_str(w)) == 1:
            assert (len(model.encode(w, add_special_tokens=False).ids) == 1) == (w in counter.whole)


def test_forgetting_changes_nothing(library, counter, monkeypatch):
    monkeypatch.setattr(counts, "REMEMBERED", 3)
    texts = ["qzxv wqvj zzkq", "qzxv jjqq", "", "wqvj"]
    assert counter.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
