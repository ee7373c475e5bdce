import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fitloom.llm import decontaminate as dc


def plain_tiling(item, text, least):
    """Greedy string tiling by looking at every pair of places."""
    fi, ft, out = [True] * len(item), [True] * len(text), []
    while True:
        best, found = least - 1, []
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and fi[p + n] and ft[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, t)]
                elif n == best and n >= least:
                    found.append((p, t))
        if not found:
            return out
        for p, t in found:
            if all(fi[p : p + best]) and all(ft[t : t + best]):
                fi[p : p + best] = ft[t : t + best] = [False] * best
                out.append((p, t, best))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=40), st.integers(1, 5))
def test_tiles_equal_the_plain_method(item, text, least):
    got = dc.tiles(np.array(item, np.uint64), np.array(text, np.uint64), least)
    assert sorted(got) == sorted(plain_tiling(item, text, least))


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def tables(spark):
    passage = " ".join(WORDS)
    turned = " ".join(WORDS[10:] + ["between"] + WORDS[:10])
    docs = [(0, f"Before it. {passage.upper()}, and after."), (1, turned), (2, " ".join(WORDS[:6]) + " something else"), (3, None), (4, ""), (5, "clean words of its own"), (6, "x " * 20_000 + passage), (0, passage), (None, passage), (8, "Tiny Item"), (9, "ÉTÉ à la plage du nord")]
    items = [(1, passage), (2, None), (3, ""), (4, "tiny item"), (5, "été À la plage du Nord")]
    return spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


def test_contained_items(tables):
    docs, items = tables
    got = sorted(((r.doc_id, r.item_id, r.covered) for r in dc.contained_items(docs, items).collect()), key=str)
    assert got == sorted([(0, 1, 20), (0, 1, 20), (1, 1, 20), (6, 1, 20), (None, 1, 20), (8, 4, 2), (9, 5, 6)], key=str)
    assert dc.contained_items(docs.limit(0), items).count() == 0 and dc.contained_items(docs, items.limit(0)).count() == 0


def test_benchmark_in_blocks_and_removal(tables, monkeypatch):
    docs, items = tables
    whole = sorted(map(str, dc.contained_items(docs, items).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 10)
    assert sorted(map(str, dc.contained_items(docs, items).collect())) == whole
    left = dc.without_items(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, 4, 5}


def test_words_of_documents(tables):
    raw = np.frombuffer("Ä_b c×D 12-x".encode(), np.uint8)
    words, _ = dc._tokens(raw, np.array([0, len(raw)]))
    assert len(words) == len(re.findall(r"[0-9A-Za-z\u0080-￿]+", "Ä_b c×D 12-x"))
