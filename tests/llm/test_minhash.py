import random

import pytest

from fitloom.llm import minhash


def shingles(text, size):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {" ".join(words)} if words else set()


def brute(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


def corpus(seed):
    """Chains of edits, so that many members of a bucket are no neighbours of its hub."""
    turn = random.Random(seed)
    prose = lambda n: [turn.choice("abcdefghijklmnop") + turn.choice("qrstuvwxyz") * turn.randint(1, 3) for _ in range(n)]
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three", "\xa0x y z"]
    for _ in range(6):
        base = prose(turn.randint(4, 120))
        group = [base]
        for _ in range(25):
            words = list(turn.choice(group))
            for _ in range(turn.randint(0, max(1, len(words) // 25))):
                words[turn.randrange(len(words))] = turn.choice(prose(3))
            group.append(words)
        texts += [" ".join(w) for w in group]
    texts += [" ".join(prose(40)) for _ in range(20)]
    turn.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_components_equal_brute_force(spark, seed, size):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, bands string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size).collect())
    assert got == brute(texts, size, 80)


def test_odd_rows(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text), (3, text), (3, "other words stand here now"), (None, text), (None, None), (9, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5, 3, False), (3, 5, 3, True), (3, 2, 3, True), (None, 5, None, True), (None, 0, None, True), (9, 1, 9, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_rows_that_repeat_split_no_component(spark):
    """Every row twice, some thrice: the same components as of each row once."""
    texts = corpus(3)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows + rows[::3], "doc_id long, text string").repartition(3)
    got = sorted({(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()})
    assert got == brute(texts, 4, 80)
