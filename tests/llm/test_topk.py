import numpy as np
import pytest

from fitloom.llm import topk


def brute(rows, k):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in good if i % 100 == 0}:
        qv = min((tuple(v) for i, v in rows if i == q and v is not None and all(x is not None and np.isfinite(x) for x in v)))
        qv = np.floor(1024 * np.array(qv)).astype(int)
        scores = sorted(((-int(qv @ v), i) for i, v in good if i != q and len(v) == len(qv)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("waves", [1, 3])
def test_equals_brute_force(spark, monkeypatch, waves):
    turn = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in turn.normal(size=12)]) for i in range(601)]
    rows += [(700, None), (701, [None] * 12), (702, [float("nan")] * 12), (703, [float("inf")] + [0.0] * 11), (704, []), (None, [1.0] * 12), (5, rows[5][1]), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (900, rows[100][1]), (901, rows[100][1]), (100, rows[100][1])]
    if waves > 1:
        monkeypatch.setattr(topk, "WAVE", 3)
        monkeypatch.setattr(topk, "BLOCK_C", 50)
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame).collect())
    assert got == brute(rows, 10)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_bounds_never_lie_below_scores():
    turn = np.random.default_rng(5)
    for d in (1, 3, 64):
        q, c = np.floor(turn.normal(size=(20, d)) * 1000), np.floor(turn.normal(size=(30, d)) * 1000)
        exact = q @ c.T
        last = None
        for a, b in zip(topk.Summary(q).level, topk.Summary(c).level):
            bound = a @ b.T
            assert (bound + 1 >= exact).all()
            assert last is None or (bound <= last + 1).all()
            last = bound


def frames(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").coalesce(2)


@pytest.mark.parametrize("case", ["negative", "constant", "mixed", "large", "ties"])
def test_hard_scores_equal_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(topk, "FIRST", 40)
    monkeypatch.setattr(topk, "BLOCK_C", 16)
    turn = np.random.default_rng(11)
    n, d = 240, 64
    x = {
        "negative": lambda: np.abs(turn.normal(20, 3, (n, d))) * np.where(np.arange(n) % 100 == 0, 1, -1)[:, None],
        "constant": lambda: np.where(np.arange(n) % 100 == 0, 100.0, -(100 + np.arange(n) / 1024))[:, None] * np.ones(d),
        "mixed": lambda: turn.normal(size=(n, d)) * turn.choice([1e-3, 1, 1e3], (n, 1)),
        "large": lambda: turn.normal(size=(n, d)) * 1e5 + turn.choice([-1e5, 0, 1e5], (n, 1)),
        "ties": lambda: turn.integers(-2, 3, (n, d)) * np.repeat(turn.choice([0.0, 1.0], (n // 12, 1)), 12, axis=0),
    }[case]()
    got = sorted(map(tuple, topk.top_k(frames(spark, x)).select("query_id", "rank", "vec_id", "score").collect()))
    whole = [[int(v) for v in np.floor(1024 * row)] for row in x]
    want = []
    for q in range(0, n, 100):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in range(n) if c != q)[:10]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    assert got == want


def test_tight_negative_bounds_keep_the_tenth(spark):
    rows = [(0, [100.0] * 64)] + [(i, [-(100 + i / 1024)] * 64) for i in range(1, 41)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(frame).orderBy("rank").collect()] == list(range(1, 11))


def test_huge_components_stay_exact():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**40, 0.0]])
    assert topk._exact(q, c).tolist() == [[2**60 + 3, 2**63 - 1]]
