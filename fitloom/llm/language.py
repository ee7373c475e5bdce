"""Language identification: the family first, then one-versus-one linear support
vector machines between the languages of that family."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.llm.common import byte_view, chunks, give_back, released, small_batches
from fitloom.llm.labelled import remainder

#: Hashed n-gram dimensions, and labelled rows of each language to learn from, at most.
DIMENSIONS, FIT_ROWS = 4096, 500
#: Documents whose counts are held at once.
BLOCK = 256

# Families of related languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, DIMENSIONS) of the whole texts: square roots of hashed counts of 1 to 4 bytes of lower-cased letters, of length 1."""
    n = len(offsets) - 1
    low = _FOLD[raw]
    accent = np.concatenate([[False], (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)])[: len(raw)]
    low[accent] += 32
    row = np.repeat(np.arange(n), np.diff(offsets))
    # Runs of other characters count as one space.
    keep = (low != 32) | np.concatenate([[True], low[:-1] != 32])[: len(low)]
    low, row = low[keep].astype(np.uint32), row[keep]
    out = np.zeros(n * DIMENSIONS)
    code = np.zeros(len(low), np.uint32)
    for k in range(1, 5):
        size = len(low) - k + 1
        if size <= 0:
            break
        code = code[:size] * np.uint32(256) + low[k - 1 :] if k > 1 else low.copy()
        same = row[:size] == row[k - 1 :]
        hashed = ((code + np.uint32(k)) * np.uint32(2654435761) ^ (code >> np.uint32(7))) * np.uint32(2246822519) >> np.uint32(20)
        out += np.bincount(row[:size][same] * DIMENSIONS + hashed[same].astype(np.int64), minlength=n * DIMENSIONS)
    x = np.sqrt(out.reshape(n, DIMENSIONS))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Rows:
    """Sparse vectors: of row i the dimensions at[ends[i]:ends[i + 1]] and what stands there."""

    def __init__(self, ends: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.ends, self.at, self.value = ends, at, value

    def __len__(self) -> int:
        return len(self.ends) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[i], self.ends[i + 1]
        return self.at[a:b], self.value[a:b]

    @classmethod
    def of(cls, x: np.ndarray) -> Rows:
        row, at = np.nonzero(x)
        return cls(np.searchsorted(row, np.arange(len(x) + 1)), at, x[row, at])


def fit_svm(x: Rows, which: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine (weights, bias) of the rows `which`, labelled -1 and 1, by dual coordinate descent on the hinge loss."""
    rows = [x.row(int(i)) for i in which]
    alpha, w, bias = np.zeros(len(rows)), np.zeros(DIMENSIONS), 0.0
    norm = [float(v @ v) + 1.0 for _, v in rows]
    turn = np.random.default_rng(7)
    for _ in range(rounds):
        moved = False
        for i in turn.permutation(len(rows)):
            at, value = rows[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ value + bias) - 1) / norm[i], 0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * value
                bias += step
                alpha[i], moved = new, True
        if not moved:
            break
    return w, float(bias)


@dataclass
class Hierarchy:
    """Machines between families, and between the languages of each family."""

    families: list[str]
    languages: dict[str, list[str]]
    weights: np.ndarray  # (machines, DIMENSIONS)
    bias: np.ndarray
    pairs: dict[str, list[tuple[int, int, int]]]  # level ('' or a family): class, class, machine

    @classmethod
    def fit(cls, x: Rows, languages: list[str], fit_all=None) -> Hierarchy:
        """fit_all(x, duels) gives (weights, bias) of each duel, which is rows and their sides; by default one after the other."""
        of = np.array([family_of(c) for c in languages], object)
        lang = np.array(languages, object)
        families = sorted(set(of))
        members = {f: sorted(set(lang[of == f])) for f in families}
        duels, pairs = [], {}
        for level, names, target in [("", families, of), *((f, members[f], lang) for f in families)]:
            pairs[level] = []
            for i, a in enumerate(names):
                for j in range(i + 1, len(names)):
                    here = np.flatnonzero((target == a) | (target == names[j]))
                    pairs[level].append((i, j, len(duels)))
                    duels.append((here, np.where(target[here] == a, 1.0, -1.0)))
        found = (fit_all or (lambda x, duels: [fit_svm(x, *d) for d in duels]))(x, duels)
        return cls(families, members, np.array([w for w, _ in found], np.float32).reshape(len(found), DIMENSIONS), np.array([b for _, b in found], np.float32), pairs)

    def _decide(self, margins: np.ndarray, level: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Class of most wins (then of the largest margins), and how sure its closest duel is."""
        wins, total, least = (np.full((len(margins), size), v) for v in (0.0, 0.0, 20.0))
        for i, j, k in self.pairs[level]:
            m = margins[:, k]
            wins[:, i] += m > 0
            wins[:, j] += m <= 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = (wins * 1e6 + total).argmax(1)
        return best, 1 / (1 + np.exp(-3 * least[np.arange(len(margins)), best]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = (x.astype(np.float32) @ self.weights.T + self.bias).astype(float)
        family, sure = self._decide(margins, "", len(self.families))
        out, score = np.empty(len(x), object), sure.copy()
        for f, name in enumerate(self.families):
            here = np.flatnonzero(family == f)
            best, inner = self._decide(margins[here], name, len(self.languages[name]))
            out[here] = np.array(self.languages[name], object)[best]
            score[here] *= inner
        return out.tolist(), score


def _blocks(offsets: np.ndarray):
    for a, b in chunks(offsets):
        for k in range(a, b, BLOCK):
            yield k, min(k + BLOCK, b)


def _vectors(batches):
    for batch in batches:
        raw, offsets = byte_view(batch.column(1))
        for a, b in _blocks(offsets):
            x = Rows.of(ngrams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            ends = pa.array(x.ends, pa.int32())
            columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(x.at, pa.int16())), pa.ListArray.from_arrays(ends, pa.array(x.value, pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "at", "value"])


def _verdicts(model, text_at: int):
    """(batch, languages, scores) of every batch."""

    def run(batches):
        tree = model.value
        for batch in batches:
            texts = batch.column(text_at)
            raw, offsets = byte_view(texts)
            names: list[str] = []
            scores: list[np.ndarray] = []
            for a, b in _blocks(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                letter = ((part >= 65) & (part <= 90)) | ((part >= 97) & (part <= 122))
                total = np.concatenate([[0], np.cumsum(letter)])
                plain = total[at[1:]] > total[at[:-1]]
                for i in np.flatnonzero(~plain):  # no letter of A to Z: look at its characters
                    plain[i] = any(c.isalpha() for c in texts[a + int(i)].as_py() or "")
                if tree is None:
                    got, score = ["und"] * (b - a), np.zeros(b - a)
                else:
                    got, score = tree.predict(ngrams(part, at))
                names += [g if ok else "und" for g, ok in zip(got, plain, strict=True)]
                scores.append(np.where(plain, score, 0.0))
            yield batch, names, np.concatenate(scores) if scores else np.zeros(0)

    return run


def _predict(model):
    def run(batches):
        for batch, names, scores in _verdicts(model, 2)(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _fit_in_tasks(spark: SparkSession):
    """Machines fitted by Spark, a duel to a task; the sample goes to the tasks as it is."""

    def fit_all(x: Rows, duels: list) -> list[tuple[np.ndarray, float]]:
        held = spark.sparkContext.broadcast((x, duels))

        def run(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    w, b = fit_svm(held.value[0], *held.value[1][k])
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([w.astype("<f4").tobytes()]), pa.array([b])], names=["duel", "weights", "bias"])

        if not duels:
            return []
        got = spark.range(0, len(duels), 1, min(len(duels), 1000)).mapInArrow(released(run), "duel long, weights binary, bias double").toArrow().sort_by("duel")
        held.unpersist()
        return [(np.frombuffer(w, "<f4"), b) for w, b in zip(got["weights"].to_pylist(), got["bias"].to_pylist(), strict=True)]

    return fit_all


def learn(docs: DataFrame, modulus: int = 3, held: int = 1, bound: int = FIT_ROWS):
    """A Hierarchy from text and non-null lang of documents whose crc32(doc_id) mod `modulus` is not `held`.

    About `bound` labelled rows of each language at most, picked by a hash of the
    id, are learned from; every value of lang is learned.  The driver holds these
    sparse rows and the machines' weights, 16 KB each; tasks fit the machines.  Returns None where there is no
    labelled row.
    """
    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = plain.where((remainder("doc_id", modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(F.broadcast(counts), "lang").where(draw < F.lit(float(bound)) / F.col("n")).select("doc_id", "text", "lang")
    got = chosen.mapInArrow(_vectors, "doc_id long, lang string, at array<smallint>, value array<float>").toArrow()
    if not len(got):
        return None
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")]).combine_chunks()  # the same model whatever order the rows come in
    at, value = got["at"].combine_chunks(), got["value"].combine_chunks()
    x = Rows(np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(at), np.int64))]), np.asarray(at.flatten(), np.int64), np.asarray(value.flatten(), float))
    model = Hierarchy.fit(x, got["lang"].to_pylist(), _fit_in_tasks(docs.sparkSession))
    del got, at, value, x
    give_back()
    return model


def identify(docs: DataFrame, modulus: int = 3, held: int = 1, bound: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs, from its whole text alone.

    Cases: a null text, or one without any letter, is `und` with score 0; a null id
    is not held out and not learned from; with no labelled row all are `und`;
    with one language all others are it; repeated rows give a row each; an
    empty table gives none; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, modulus, held, bound))
    held_out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(_predict(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, least: float = 0.26, modulus: int = 3, held: int = 1, bound: int = FIT_ROWS) -> DataFrame:
    """docs with all columns, without rows that are `und` or scored below `least`; nothing is shuffled.

    Two machines that are wholly undecided give 0.25.  With no labelled row to learn
    from, texts that have a letter stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, modulus, held, bound))
    unlearned = model.value is None
    at = docs.columns.index("text")

    def keep(batches):
        for batch, names, scores in _verdicts(model, at)(batches):
            good = [any(c.isalpha() for c in t.as_py() or "") for t in batch.column(at)] if unlearned else [n != "und" and s >= least for n, s in zip(names, scores.tolist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(released(keep), docs.schema)
