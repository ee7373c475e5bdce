"""Held-out accuracy and odd rows of the language, toxicity and quality models."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.llm import gbt, language, quality, toxicity

ODD = [(900_001, None), (900_002, ""), (900_003, "1234 !!"), (900_004, "漢字"), (None, "the words of it"), (900_005, "the word and " * 30_000)]
WORDS = {"en": "the of and to in is that with for are this which have from".split(), "fr": "le la les des est une pour dans que avec sur pas".split(), "de": "der die das und ist nicht mit eine auf für den von".split(), "es": "el los las una para con que por del como más pero".split()}


def prose(turn, lang, n):
    return " ".join(turn.choice(WORDS[lang]) + turn.choice(["", "", turn.choice("abcdefgh")]) for _ in range(n))


def held(i, modulus, r):
    return zlib.crc32(str(i).encode()) % modulus == r


def test_language(spark):
    turn = random.Random(4)
    rows = [(i, prose(turn, lang, turn.randint(5, 60)), lang) for i, lang in enumerate(list(WORDS) * 100)]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in rows] + [(i, t, None, 2) for i, t in ODD] + [(3, rows[3][1], rows[3][2], 3)], "doc_id long, text string, lang string, held_out int")
    got = language.identify(docs).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    by = {r.doc_id: r for r in got}
    test = [(i, lang) for i, _, lang in rows if held(i, 3, 1)]
    assert all(by[i].held_out == held(i, 3, 1) for i, _, _ in rows)
    assert np.mean([by[i].lang_pred == lang for i, lang in test]) > 0.97
    for i in (900_001, 900_002, 900_003):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[900_004].lang_pred in WORDS and by[900_005].lang_pred == "en" and not by[None].held_out
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_with_clashing_columns_and_many_labels(spark):
    turn = random.Random(5)
    rows = [(i, prose(turn, lang, 30), lang) for i, lang in enumerate(list(WORDS) * 40)] + [(500 + i, prose(turn, "en", 20), f"junk{i}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, lang, 1, "c", 0.5, 7) for i, t, lang in rows], "doc_id long, text string, lang string, count int, lang_pred string, score double, n int")
    got = language.recognised(docs, least=0.0)
    assert got.columns == docs.columns and got.count() == len(rows)
    assert language.identify(docs).count() == len(rows)


def test_rarest_of_seventy_languages_is_predicted(spark):
    turn = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(turn.choice(letters) for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = [(lang, " ".join(turn.choice(ws) for _ in range(25))) for lang, ws in words.items() for _ in range(3 if lang == "l69" else 8)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.learn(docs, modulus=1, held=1)
    assert sorted(c for names in model.languages.values() for c in names) == sorted(words)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, modulus=1, held=1).collect()}
    rare = [i for i, (lang, _) in enumerate(rows) if lang == "l69"]
    assert all(got[i] == "l69" for i in rare)


def test_language_votes_equal_a_plain_version(spark):
    """n-gram counts, duels and votes, written out per document."""
    turn = random.Random(11)
    texts = [prose(turn, lang, turn.randint(3, 40)) for lang in list(WORDS) * 15] + ["Ünïté ÉCOLE 12!! x", "a", "straße"]
    langs = [lang for lang in list(WORDS) * 15] + ["fr", "en", "de"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x = language.ngrams(raw, offsets)
    for row, text in zip(x, texts, strict=True):
        folded, data = [], text.encode()
        for k, b in enumerate(data):
            b = b + 32 if 65 <= b <= 90 or (k and data[k - 1] == 0xC3 and 0x80 <= b <= 0x9E) else b
            b = b if 97 <= b <= 122 or b >= 128 else 32
            if b != 32 or not folded or folded[-1] != 32 or k == 0:
                folded.append(b)
        count = np.zeros(language.DIMENSIONS)
        for n in range(1, 5):
            for k in range(len(folded) - n + 1):
                code = int.from_bytes(bytes(folded[k : k + n]), "big")
                code = (((code + n) * 2654435761 & 0xFFFFFFFF) ^ code >> 7) * 2246822519 & 0xFFFFFFFF
                count[code >> 20] += 1
        plain = np.sqrt(count)
        assert np.allclose(row, plain / max(np.linalg.norm(plain), 1e-12))
    model = language.Hierarchy.fit(language.Rows.of(x), langs)
    names, scores = model.predict(x)

    def duel(row, level, classes):
        wins, total, least = [0] * len(classes), [0.0] * len(classes), [20.0] * len(classes)
        for i, j, k in model.pairs[level]:
            m = float(row.astype(np.float32) @ model.weights[k] + model.bias[k])
            wins[i if m > 0 else j] += 1
            total[i], total[j] = total[i] + m, total[j] - m
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(range(len(classes)), key=lambda c: (wins[c], total[c]))
        return classes[best], 1 / (1 + np.exp(-3 * least[best]))

    for row, name, score in zip(x, names, scores, strict=True):
        family, sure = duel(row, "", model.families)
        got, inner = duel(row, family, model.languages[family])
        assert got == name and abs(sure * inner - score) < 1e-4
    assert np.mean([a == b for a, b in zip(names, langs, strict=True)]) > 0.9


def test_tree_traversal_equals_a_plain_walk():
    turn = np.random.default_rng(3)
    x = turn.normal(size=(600, 5))
    trees = gbt.fit(x[:400], (x[:400, 0] * x[:400, 1] > 0).astype(float), np.ones(400))
    assert np.allclose(trees.raw(x[400:]), [plain_walk(trees, row) for row in x[400:]])


def labelled(spark):
    turn = random.Random(9)
    rows, labels = [], []
    for i in range(700):
        toxic, good = int(turn.random() < 0.25), int(turn.random() < 0.7)
        words = prose(turn, "en", turn.randint(15, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(turn.randrange(len(words)), turn.choice(["grubling", "foulmark", "grubness"]))
        text = " ".join(words)
        rows.append((i, text if good else "!! ".join(text.upper().split())))
        labels.append((i, good, toxic))
    docs = spark.createDataFrame([(i, t, "en", 0.0) for i, t in rows] + [(i, t, None, 0.5) for i, t in ODD] + [(5, rows[5][1], "en", 0.0)], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame(labels + [(5, *labels[5][1:]), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("model", "modulus", "rest", "at"), [(toxicity, 5, 0, 2), (quality, 3, 1, 1)])
def test_classifier(spark, model, modulus, rest, at):
    docs, labels, truth = labelled(spark)
    got = model.classify(docs, labels).collect()
    assert len(got) == 700 + len(ODD) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    test = [row for row in truth if held(row[0], modulus, rest)]
    assert all(by[i].held_out == held(i, modulus, rest) for i, _, _ in truth)
    assert np.mean([by[row[0]].predicted == row[at] for row in test]) > 0.93
    assert model.classify(docs.limit(0), labels).count() == 0
    assert model.classify(docs.limit(20), labels.limit(0)).count() == 20


def test_trees_learn_and_isotonic_never_falls():
    turn = np.random.default_rng(2)
    x = turn.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = gbt.fit(x[:1500], y[:1500], np.ones(1500))
    raw = trees.raw(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.95
    knots, values = gbt.isotonic(raw, y[1500:], np.ones(500))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    flat = gbt.fit(np.zeros((0, 3)), np.zeros(0), np.zeros(0))
    assert flat.raw(x[:5]).tolist() == [0.0] * 5


def plain_walk(trees, row):
    total = trees.start
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return total
