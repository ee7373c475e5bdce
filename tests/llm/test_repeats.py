import hashlib
import random
from collections import Counter

import pytest

from fitloom.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    turn = random.Random(seed)
    word = lambda: "".join(turn.choice("abcdeé") for _ in range(turn.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(200) for _ in range(4)]
    texts = [None, "", "short", "a" * 2000, "ab" * 900, "a" * 399, "a" * 700, "abc " * 50]
    for k in range(40):
        parts = []
        for _ in range(turn.randint(1, 5)):
            s = turn.choice(shared)
            a = turn.randint(0, len(s) - 1)
            b = turn.randint(a, len(s))
            piece = list(s[a:b])
            for _ in range(turn.randint(0, 2)):
                if piece:
                    piece[turn.randrange(len(piece))] = "#"
            parts += ["".join(piece), prose(turn.randint(0, 60))]
        texts.append(" ".join(parts))
    return texts + texts[10:14]


@pytest.mark.parametrize(("length", "part"), [(400, None), (60, None), (400, 1500)])
def test_equals_brute_force(spark, length, part):
    texts = corpus(length)
    docs = spark.createDataFrame([(i if i % 17 else i // 17, t, "clash") for i, t in enumerate(texts)] + [(None, texts[9], "x")], "doc_id long, text string, runs string").repartition(3)
    got = sorted(tuple(r)[1:5] for r in repeats.remove_repeats(docs, length, part=part or repeats.PART_BYTES).collect())
    assert got == sorted(brute([*texts, texts[9]], length))


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
