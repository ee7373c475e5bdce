"""Queries that apply the training-data operators to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm import bpe, conversations, counts, decontaminate, language, quality, repeats, secrets, tokenfile, topk, toxicity, variants
from fitloom.llm.common import Scratch, table
from fitloom.llm.minhash import near_duplicates


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("text_hash")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of op2's three patterns alone, which SQL can find, too."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), [0] * len(secrets.ALPHABET) ** 2)
    return found.select("doc_id", secrets.as_text(F.col("base")).alias("base"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "tokens").path("shards")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_tokens(spark, folder).drop("ids")


def op9_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, bpe.PATTERN).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "runs")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), slip=199)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_id_output": op8_token_id_output,
    "op9_byte_bpe_round_trip": op9_byte_bpe_round_trip,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_counts": op13_token_counts,
    "secret_base_spans": secret_base_spans,
}


def _base_sql() -> str:
    kinds = [
        ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""len(regexp_extract(m, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""),
        ("access", "AKIA[A-Z0-9]+", "len(m) >= 20"), ("hex", "[0-9a-f]+", "len(m) >= 24"),
    ]
    parts = []
    for order, (kind, pattern, good) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, m, sum(len(g) + coalesce(len(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, {good} AS good FROM (
          SELECT doc_id, unnest(regexp_split_to_array(t, '{quoted}')) AS g, unnest(regexp_extract_all(t, '{quoted}')) AS m, generate_subscripts(regexp_split_to_array(t, '{quoted}'), 1) AS i FROM d) x""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, coalesce(string_agg(kind || ':' || (stop - len(m))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - len(m), o) FILTER (WHERE good), '') AS base FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


#: crc32 of the UTF-8 bytes of column k, one table entry a byte; the table follows from the reversed polynomial.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY b) AS tab FROM (
  SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(b)))"""


def _crc(k: str) -> str:
    bytes_ = f"list_transform(range(octet_length(encode({k}))), lambda i: ('0x' || substr(hex(encode({k})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_REPAIR_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
cut AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc('k')} % 20 AS c FROM keyed, crc_table),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM cut)),
numbered AS (
  SELECT *, coalesce(conv_id, -1) AS cid, row_number() OVER w AS i, left(role, 1) AS ini,
    lag(left(role, 1)) OVER w AS before, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS is_cut
  FROM rows_after WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
judged AS (SELECT *, CASE WHEN is_blank THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN is_cut THEN 'truncated' ELSE '' END AS fault FROM numbered),
nexts(q, ini, q2) AS (VALUES ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
inserts(p, q, k) AS (VALUES ('e', 'e', 0), ('e', 'u', 1), ('e', 'a', 2), ('s', 's', 0), ('s', 'u', 1), ('s', 'a', 2), ('u', 'u', 0), ('u', 'a', 1), ('a', 'a', 0), ('a', 'u', 1)),
moves AS (
  SELECT q, 'D' AS letter, q AS q2, NULL AS ini, 4 AS price FROM (VALUES ('e'), ('s'), ('u'), ('a')) t(q)
  UNION ALL SELECT q, 'K', q2, ini, 0 FROM nexts UNION ALL SELECT q, 'R', q2, NULL, 3 FROM nexts WHERE ini <> 's'),
dp(cid, i, state, best) AS (
  SELECT cid, 0::BIGINT, 'e', {{'cost': 0::BIGINT, 'audit': ''}} FROM (SELECT DISTINCT coalesce(conv_id, -1) AS cid FROM conversations)
  UNION ALL
  SELECT cid, i, state, min(best) FROM (
    SELECT d.cid, j.i, m.q2 AS state, {{'cost': (d.best.cost + 3 * n.k + m.price + CASE WHEN m.letter <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END)::BIGINT, 'audit': d.best.audit || repeat('I', n.k) || m.letter}} AS best
    FROM dp d JOIN judged j ON j.cid = d.cid AND j.i = d.i + 1 JOIN inserts n ON n.p = d.state JOIN moves m ON m.q = n.q
    WHERE m.letter = 'D' OR (j.fault NOT IN ('blank', 'duplicate') AND (m.letter = 'R' OR m.ini = j.ini))) GROUP BY cid, i, state),
lengths AS (SELECT cid, max(i) AS n FROM dp GROUP BY cid),
done AS (
  SELECT d.cid, min({{'cost': d.best.cost + 3 * n.k, 'audit': d.best.audit || repeat('I', n.k)}}) AS best
  FROM dp d JOIN lengths l ON l.cid = d.cid AND l.n = d.i JOIN inserts n ON n.p = d.state AND n.q IN ('e', 'a') GROUP BY d.cid),
letters AS (
  SELECT cid, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS pos FROM done WHERE best.audit <> ''),
placed AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY pos) AS i, row_number() OVER (PARTITION BY cid, letter = 'D' ORDER BY pos) AS o FROM letters),
said AS (
  SELECT p.cid, p.pos, p.letter, p.o, CASE WHEN p.letter = 'I' THEN '' ELSE j.text END AS text, j.role,
    max(CASE WHEN p.o = 1 AND p.letter = 'K' AND j.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.cid) AS shift
  FROM placed p LEFT JOIN judged j ON j.cid = p.cid AND j.i = p.i AND p.letter <> 'I' WHERE p.letter <> 'D'),
repaired AS (SELECT cid, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS text FROM said GROUP BY cid),
counts AS (
  SELECT cid, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY cid)
SELECT nullif(d.cid, -1) AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM done d LEFT JOIN counts c USING (cid) LEFT JOIN repaired r USING (cid)"""


_VARIANTS_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY ALL),
keyed AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM runs),
summed AS (SELECT w, c, {_crc('k')} AS h FROM keyed, crc_table),
said AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM summed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, b.n_near, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n, CASE WHEN b.most >= 5 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.other_n = b.most) END AS form
  FROM words w LEFT JOIN best b USING (word)),
walk(word, here, steps) AS (SELECT word, word, 0 FROM words UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)"""


ORACLE = {
    "op11_spelling_variants": _VARIANTS_SQL,
    "op12_conversation_repair": _REPAIR_SQL,
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM words)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 80 * (x.n + y.n - p.i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "secret_base_spans": _base_sql(),
}
