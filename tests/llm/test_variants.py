import random
import re
import zlib
from collections import Counter

import pytest

from fitloom.llm import variants
from fitloom.llm.common import Scratch


def plain_counts(rows, length, least, slip):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, factor=5):
    out, form = [], {}
    near = {w: [x for x in counts if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def mutations(turn, word, alphabet):
    i, c = turn.randrange(len(word) + 1), turn.choice(alphabet)
    return turn.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


@pytest.fixture(scope="module")
def counted():
    turn = random.Random(3)
    alphabet = "abcdexyzéßÿ×"
    words = {"".join(turn.choice(alphabet) for _ in range(turn.randint(6, 11))) for _ in range(60)}
    for _ in range(3):
        words |= {m for w in sorted(words) if (m := mutations(turn, w, alphabet)) and len(m) >= 6}
    words |= {"aaaaaa" + c + d for c in "abcdefgh" for d in "abcdefgh"} | {"aaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaaaaaa"}
    return {w: turn.choice([5, 5, 6, 25, 30, 125, 700]) for w in sorted(words)}


@pytest.mark.parametrize("bucket", [256, 3, 1])
def test_groups_equal_brute_force(spark, counted, monkeypatch, bucket):
    monkeypatch.setattr(variants, "BUCKET", bucket)
    frame = spark.createDataFrame(list(counted.items()), "word string, n long")
    got = variants.variants(frame, Scratch(spark, "variants")).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(counted)


def test_whole_texts_and_odd_rows(spark):
    turn = random.Random(8)
    base = ["Spelling", "VARIANT", "Straße", "élégante", "ÉLÉGANTE", "short", "Missis×sippi", "spellings", "speling"]
    rows = [(i, " ".join(turn.choice(base) + turn.choice(["", ".", "2x", "—Ω"]) for _ in range(turn.randint(0, 90)))) for i in range(60)]
    rows += [(1, rows[1][1]), (None, "spelling " * 30), (70, None), (71, ""), (72, "variant" * 3000 + " " + "spelling " * 20_000)]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "Doc_ID long, TEXT string, n int, word string").repartition(3)
    counts = plain_counts(rows, 6, 5, 7)
    assert dict(map(tuple, variants.word_counts(frame, slip=7).select("word", "n").collect())) == counts
    assert sorted(map(tuple, variants.spelling_variants(frame, slip=7).collect()), key=repr) == plain(counts)
    assert variants.spelling_variants(frame.limit(0), slip=7).count() == 0


def test_an_edit_flips_two_bits_at_most(spark):
    turn = random.Random(1)
    pairs = [(w, mutations(turn, w, "abyzéÿÀ")) for w in ("".join(turn.choice("abcxyzéÀ") for _ in range(8)) for _ in range(200))]
    frame = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    assert all(r.f <= (1 if len(r.a) != len(r.b) else 2) for r in frame.select("a", "b", F.bit_count(variants.parity_mask(F.col("a")).bitwiseXOR(variants.parity_mask(F.col("b")))).alias("f")).collect())
