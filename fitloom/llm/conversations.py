"""Repair of conversations so that their roles read (s?(ua)+)?, by a DP that signatures share along a trie.

A conversation's signature has one character for each row: what its role and its
fault leave possible.  Distinct signatures are sorted, so each shares a prefix
with the one before it: a task walks their prefix trie depth first, holds
one layer for each node of the current path, computes a layer once per shared
prefix and reads the cheapest edits off where a signature ends.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import Scratch, small_batches

#: Costs of a new role, a deletion, an insertion, and of keeping a truncated text.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, system last, user last, assistant last; those in which a conversation may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FINAL = {EMPTY, ASSISTANT}
#: A user or, after one, an assistant comes next.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Where a kept row of each role initial may stand, and the state after it.
KEPT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Turns whose rows are ordered together.
SPAN = 4_096
WHITE = " \t\n\x0b\f\r"


def _after_inserts(state: int):
    """(state, insertions) reachable by none, one or two insertions; more come back to a state at a higher cost."""
    for k in range(3):
        yield state, k
        state = NEXT[state]


class Layer:
    """After a prefix of rows: for each state the least cost above the layer's least, and the order of the states' edits.

    Edits are compared as text among equal costs.  Those of one layer end in the
    same row's letter, so none begins another and their order decides whatever
    follows; insertions are counted with the row after them.
    """

    _known: dict[tuple, Layer] = {}

    def __init__(self, states: tuple):
        self.states, self.steps = states, {}

    @classmethod
    def of(cls, states: tuple) -> Layer:
        return cls._known.setdefault(states, cls(states))

    def step(self, symbol: str) -> tuple[Layer, int, tuple]:
        """(layer after a row, its least cost above this one's, for each state where its edits come from)."""
        if symbol not in self.steps:
            self.steps[symbol] = self._step(symbol)
        return self.steps[symbol]

    def _step(self, symbol: str) -> tuple[Layer, int, tuple]:
        best: dict[int, tuple] = {}
        held = TRUNCATED if symbol.isupper() else 0
        for before, (cost, order) in ((s, x) for s, x in enumerate(self.states) if x):
            for at, k in _after_inserts(before):
                choices = [("D", at, DELETE)]
                if symbol != "x":
                    choices.append(("R", NEXT[at], REROLE + held))
                    if (symbol.lower(), at) in KEPT:
                        choices.append(("K", KEPT[symbol.lower(), at], held))
                for letter, after, price in choices:
                    found = cost + INSERT * k + price, order, "I" * k + letter, before
                    best[after] = min(best.get(after, found), found)
        least = min(x[0] for x in best.values())
        order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        states = tuple((best[s][0] - least, order[s]) if s in best else None for s in range(4))
        return Layer.of(states), least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))

    def end(self) -> tuple[int, int, str]:
        """(cost above the layer's least, state, insertions) of the cheapest way to end here."""
        ways = [(cost + INSERT * k, order, "I" * k, s) for s, x in enumerate(self.states) if x for cost, order in [x] for at, k in _after_inserts(s) if at in FINAL]
        cost, _, inserts, state = min(ways)
        return cost, state, inserts


class Walk:
    """The path of a prefix trie from its root to the signature taken last."""

    def __init__(self):
        self.path, self.signature = [(Layer.of(((0, 0), None, None, None)), 0, None)], ""

    def take(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; the layers of the prefix it shares with the one before stay."""
        shared = len(os.path.commonprefix([self.signature, signature]))
        del self.path[shared + 1 :]
        layer, cost, _ = self.path[-1]
        for symbol in signature[shared:]:
            layer, more, back = layer.step(symbol)
            cost += more
            self.path.append((layer, cost, back))
        self.signature = signature
        more, state, letters = layer.end()
        edits = [letters]
        for _, _, back in reversed(self.path[1:]):
            state, letters = back[state]
            edits.append(letters)
        return cost + more, "".join(reversed(edits))


def _answers(batches):
    walk = Walk()
    for batch in batches:
        found = [walk.take(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([e for _, e in found], pa.string())], names=["signature", "cost", "audit"])


class Repair:
    """The repaired rows of one conversation, hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.hash, self.any = audit, 0, "", hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any, self.last = True, role[:1]

    def _next(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._say(self._next(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._say(role if letter == "K" else self._next(), text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def _hashes(batches):
    """Rows arrive by conversation: what is known of it first, then its rows in order."""

    def told(done: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
        fields = [*fields, pa.field("repaired_sha256", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), fields, strict=True)], names=[f.name for f in fields])

    head, now, fields = (), None, []
    for batch in batches:
        known, copies, role, text = (batch.column(batch.schema.get_field_index(c)) for c in ("known", "copies", "role", "text"))
        fields, done = list(known.type), []
        for h, n, r, t in zip(known.to_pylist(), copies.to_pylist(), role.to_pylist(), text.to_pylist(), strict=True):
            if h is None:
                for _ in range(n):
                    now.row(r, t)
                continue
            if now is not None:
                done.append((*head, now.digest()))
            head, now = tuple(h[f.name] for f in fields), Repair(h["audit"])
        if done:
            yield told(done, fields)
    if now is not None:
        yield told([(*head, now.digest())], fields)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32(conv_id:turn) % 20.

    0 drops the row (copies = 0), 1 empties its text, 2 removes its [.!?], 3
    repeats it (copies = 2), 4 sets its role to user.  Null ids and turns stand in that
    sum as one space; a null role or text is one space.
    """
    cut = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(cut == 4, "user").otherwise(role).alias("role"),
        F.when(cut == 1, "").when(cut == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(cut == 0, 0).when(cut == 3, 2).otherwise(1).alias("copies"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of every id of damaged rows.

    A row's character is its role's initial (s, u, a, or o for any other), a capital
    where its text is truncated, or x where it must go.  Texts stay behind: only
    digests are shuffled.  Equal rows meet as counts, first
    occurrences as minima, and turns are ordered SPAN at a time, so that
    a long conversation reaches one task as a few strings only.
    """
    id_, turn = ["id_null", "id"], ["turn_null", "turn_key"]
    bare = F.rtrim("text", F.lit(WHITE))
    slim = rows.select(
        F.col("conv_id").isNull().alias("id_null"), F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("turn").isNull().alias("turn_null"), F.coalesce("turn", F.lit(0)).alias("turn_key"), "role",
        F.unhex(F.sha2("text", 256)).alias("digest"), (bare == "").alias("is_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_cut"), "copies",
    )
    cells = slim.groupBy(*id_, *turn, "role", "digest").agg(F.sum("copies").alias("n"), F.first("is_blank").alias("is_blank"), F.first("is_cut").alias("is_cut"))
    firsts = slim.where("copies > 0").groupBy(*id_, "role", "digest").agg(F.min(F.struct((~F.col("turn_null")).alias("dated"), "turn_key")).alias("f"))
    firsts = firsts.select(*id_, (~F.col("f")["dated"]).alias("turn_null"), F.col("f")["turn_key"].alias("turn_key"), "role", "digest", F.lit(1).alias("leads"))
    letter = F.left("role", F.lit(1))
    letter = F.when(letter.isin("s", "u", "a"), letter).otherwise("o")
    n, leads = F.col("n"), F.coalesce("leads", F.lit(0))
    live = ~F.col("is_blank") & (leads == 1) & (n > 0)
    own = cells.join(firsts, [*id_, *turn, "role", "digest"], "left").select(
        *id_, *turn, "n",
        F.struct("turn_key", "role", "digest", F.when(live, F.concat(F.when(F.col("is_cut"), F.upper(letter)).otherwise(letter), F.repeat(F.lit("x"), (n - 1).cast("int")))).otherwise(F.repeat(F.lit("x"), n.cast("int"))).alias("s"), F.repeat(letter, n.cast("int")).alias("r"), (n > 0).alias("there")).alias("cell"),
        F.when(F.col("is_blank"), n).otherwise(0).alias("blank"), F.when(F.col("is_blank"), 0).otherwise(n - F.when(live, 1).otherwise(0)).alias("duplicate"), F.when(live & F.col("is_cut"), 1).otherwise(0).alias("truncated"),
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    there = F.filter("cells", lambda c: c["there"])
    dated = F.when(~F.col("turn_null"), F.transform(there, lambda c: c["turn_key"]))
    spans = (
        own.groupBy(*id_, "turn_null", F.expr(f"floor(turn_key / {SPAN})").alias("span")).agg(F.array_sort(F.collect_list("cell")).alias("cells"), *sums)
        .select(*id_, F.struct((~F.col("turn_null")).alias("dated"), "span", F.array_join(F.transform("cells", lambda c: c["s"]), "").alias("s"), F.array_join(F.transform("cells", lambda c: c["r"]), "").alias("r")).alias("part"),
                F.array_min(dated).alias("low"), F.array_max(dated).alias("high"), F.size(F.array_distinct(F.coalesce(dated, F.array().cast("array<bigint>")))).alias("turns"), "blank", "duplicate", "truncated")
    )
    whole = spans.groupBy(*id_).agg(F.array_sort(F.collect_list("part")).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"), *sums)
    initials = F.array_join(F.transform("parts", lambda p: p["r"]), "")
    wide = "decimal(38,0)"
    gaps = F.coalesce(F.expr(f"try_cast(cast(high as {wide}) - cast(low as {wide}) + 1 - turns as bigint)"), F.when(F.col("low").isNull(), F.lit(0)))
    legal = sum(F.length("initials") - F.length(F.replace("initials", F.lit(pair), F.lit(pair[:1]))) for pair in ("su", "ua", "au"))
    return whole.withColumn("initials", initials).select(
        F.when(~F.col("id_null"), F.col("id")).alias("conv_id"), F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("signature"), gaps.alias("gaps"),
        *[F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")], (F.greatest(F.length("initials") - 1, F.lit(0)) - legal).cast("long").alias("illegal"),
    )


def edits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature, by ranges of sorted signatures: one walk of a trie a task."""
    distinct = small_batches(signed).select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return distinct.mapInArrow(_answers, "signature string, cost long, audit string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: its faults after damage, the cheapest edits and the digest of what they leave.

    conversations: conv_id, turn, role, text; other columns are not read.  Faults
    of a row, the first that holds: blank, duplicate of an earlier row of
    its conversation, truncated.  Edits by row: K keep, R new role, D delete, I an inserted
    row; among the cheapest the least text.  The digest takes
    the repaired rows role:text, joined by newlines.

    A digest is a chain, so a conversation's rows pass one task in order; they are
    sorted by Spark, read as a stream, and never held together.  The edits themselves
    are found from signatures of a byte a row.

    Cases: a null id is a conversation of its own; rows without a turn come first; rows of one turn stand by role, then
    by the SHA-256 of their text; repeated rows are duplicates; a null or empty role has an initial that fits nowhere; a
    null or empty text is blank; very long texts are only hashed; gaps is null where
    turns lie more than 2^63 apart; an id whose rows are all dropped has zeros, no edits and the digest of no
    bytes; an empty table gives no row.  Needs spark.checkpoint.dir outside local mode.
    """
    scratch = Scratch(conversations.sparkSession, "conversations")
    rows = damaged(conversations)
    signed = scratch.keep(signatures(rows), "signatures")
    heads = signed.join(edits(signed), "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    known = F.struct(*heads.columns)
    kept = heads.columns
    heads = heads.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), known.alias("known"))
    rows = rows.where("copies > 0").withColumn("known", F.lit(None).cast(heads.schema["known"].dataType))
    both = heads.unionByName(rows).withColumn("digest", F.sha2("text", 256))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("known").isNull(), F.col("turn").asc_nulls_first(), "role", "digest").drop("digest")
    types = {f.name: f.dataType.simpleString() for f in signed.schema.fields} | {"cost": "bigint", "audit": "string"}
    return ordered.mapInArrow(_hashes, ", ".join(f"{c} {types[c]}" for c in kept) + ", repaired_sha256 string")
