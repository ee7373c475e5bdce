import hashlib
import random

import numpy as np

import corpus_pipeline as cp


def test_stages_on_a_small_corpus(spark, tmp_path):
    turn = random.Random(1)
    word = {"en": "the of and to in is that with for are this".split(), "fr": "le la les des est une pour dans que avec".split(), "de": "der die das und ist nicht mit eine auf für".split()}
    prose = lambda lang, n: " ".join(turn.choice(word[lang]) + turn.choice("abcdefghij") * turn.randint(0, 2) for _ in range(n))
    rows = [(i, prose(lang, 80), lang) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    passage = prose("en", 40)
    rows += [(100, rows[0][1], "en"), (101, rows[0][1] + " more", "en"), (102, "1234 5678", "en"), (103, None, None), (104, "", "en"), (105, passage + " and " + prose("en", 30), "en")]
    rows += [(106, prose("en", 30) + " token = \"0123456789abcdef0123456789abcdef\" end", None), (7, rows[7][1], rows[7][2]), (None, prose("de", 40), "de")]
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or ""), "clash", 1.5) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(sorted((r.doc_id for r in now.collect()), key=str))
    ids = sorted([i for i, t, _ in rows if i not in (102, 103, 104)], key=str)
    assert seen[0] == ids
    ids.remove(100), ids.remove(101), ids.remove(7)
    assert seen[1] == ids
    ids.remove(105)
    assert seen[2] == ids and seen[3] == ids
    changed = [r for r in now.collect() if r.doc_id == 106][0]
    assert "[secret]" in changed.text and changed.n_chars == len(changed.text)
    last = {r.doc_id: r for r in cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()}
    for r in now.collect():
        assert last[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and len(np.frombuffer(last[r.doc_id].ids, "<u4")) == last[r.doc_id].n_tokens
    whole = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in cp.run(spark, str(tmp_path)).collect()}
    assert whole == {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in last.values()}


def test_stages_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
