"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded
buckets, star-shaped candidate edges, exact confirmation on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fitloom.llm.common import U64, Scratch, byte_view, chunks, free_name, mix, released, shingle_sets, small_batches, stream
from fitloom.llm.components import components

#: A pair of Jaccard 0.8 shares none of 40 bands of 5 rows with probability 1.3e-7.
BANDS, ROWS = 40, 5


def _probes(bins: int, tries: int = 2048) -> np.ndarray:
    """For each bin the bins that it asks in turn when empty, by a hash of (bin, try)."""
    return (stream(37, bins * tries) % U64(bins)).astype(np.int32).reshape(bins, tries)


def signature(hashes: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """One-permutation minima of sorted hashes; empty bins copy by optimal densification."""
    bin_of = ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
    source = np.full(bins, -1, np.int64)
    source[bin_of[first]] = first
    open_ = np.flatnonzero(source < 0)
    at = 0
    held = source >= 0
    for step in (8, 32, 128, 512, probes.shape[1]):
        if not len(open_) or at >= probes.shape[1]:
            break
        asked = probes[open_, at : at + step]
        hit = held[asked]
        found = hit.any(1)
        source[open_[found]] = source[asked[found, hit[found].argmax(1)]]
        open_, at = open_[~found], at + step
    source[open_] = 0
    return hashes[source]


def _describe(size: int, bands: int, rows: int):
    def run(batches):
        probes = _probes(bands * rows)
        keys, salt = stream(41, rows) | U64(1), stream(43, bands)
        for batch in batches:
            raw, offsets = byte_view(batch.column(1))
            counts, ids, flat, lens = [], [], [], [0]
            for a, b in chunks(offsets):
                for got in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size):
                    counts.append(len(got))
                    ids.append(hashlib.blake2b(got.tobytes(), digest_size=16).digest() if len(got) else None)
                    if len(got):
                        sig = signature(got, bands * rows, probes).reshape(bands, rows)
                        flat.append(mix((sig * keys).sum(1) + salt))
                    lens.append(lens[-1] + bands * bool(len(got)))
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(values))],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            raw, offsets = byte_view(batch.column(1))
            out = [got.tobytes() for a, b in chunks(offsets) for got in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            (left, lo), (right, ro) = byte_view(batch.column(2)), byte_view(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = left[lo[i] : lo[i + 1]].copy().view(U64), right[ro[i] : ro[i + 1]].copy().view(U64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _listed(batches):
    """One row for each shingle of each set."""
    for batch in batches:
        raw, offsets = byte_view(batch.column(1))
        sizes = np.diff(offsets) // 8
        nodes = np.repeat(np.asarray(batch.column(0), np.int64), sizes)
        n = np.repeat(sizes, sizes)
        values = raw.copy().view(np.int64)
        for k in range(0, len(nodes), 1 << 16):
            c = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[c]), pa.array(n[c]), pa.array(values[c])], names=["node", "n", "shingle"])


def _fits(x, y, percent: int):
    """False for sizes too unequal to reach the threshold."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: (doc_id, n_shingles, component_id, kept, text_hash), one row per input row.

    Documents whose shingle sets have 100 * intersection >= percent * union
    are linked; a component is all that links reach.  Documents of equal sets
    are first taken as one node.  Nodes sharing a band's bucket are candidates:
    the bucket's smallest node is its hub and is confirmed against each other
    member (star edges), so a bucket costs its size.  Where members of a bucket
    still lie in several components, links between two non-hub members may be
    missing; `_between` finds those exactly without forming the bucket's pairs.

    Cases: a null or wordless text has n_shingles 0, is linked with nothing and
    is its own component; a null id stays unlinked, with null component and
    kept true; rows repeating an id are linked each by its own text; an empty
    table gives no row.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    signed = scratch.keep(hashed.mapInArrow(released(_describe(shingle, bands, rows)), "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>"), "signatures")
    named = signed.where("set_key is not null and doc_id is not null")
    classes = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select("r.doc_id", "r.n_shingles", "r.bands")
    slots = classes.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("hub")).where("size > 1").select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = scratch.keep(slots.join(shared, "bucket"), "members")
    pairs = members.where("node <> hub").where(_fits(F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = scratch.keep(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(released(_sets(shingle)), "node long, shingles binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(released(_confirm(percent)), "a long, b long")

    labels = scratch.keep(components(confirmed(pairs), scratch), "labels")
    sure, maybe = _between(members, sets, labels, percent, scratch)
    more = confirmed(maybe).unionByName(sure)
    at = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    bridges = scratch.keep(more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "bridges")
    if not bridges.isEmpty():
        joined = components(bridges, scratch).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        lone = bridges.select(F.col("a").alias("node")).unionByName(bridges.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node"))
        parts = labels.unionByName(lone).distinct()
        labels = scratch.keep(parts.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "labels")

    reps = named.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_key").join(reps, "set_key", "left").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def _between(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sure links, candidate pairs) between nodes of different components that share a bucket; exact.

    A group is a component of hubs with all nodes that meet one of them in a
    bucket; two nodes of one bucket are in one group.  In a group each node x is told
    by its difference D(x) from the shingles that more than half of the group
    hold.  With n shingles and p percent let
        A(x) = (100 + p) |D(x)| - (100 - p) n(x);
    x and y reach the threshold just when D(x) and D(y) have at least
    (A(x) + A(y)) / (2 (100 + p)) elements in common.  So

    * if A(x) + A(y) <= 0 they surely do, and a star around the node m of least A joins all such;
    * any other pair of two components has a member x with A(x) > -A(m), a far one, and must share so many
      elements that a prefix of each D, rare shingles first, has one in
      common.  Edits that no two copies share keep such prefixes apart, so that copies
      around one text do not meet in pairs.
    """
    full, gap = 100 + percent, 100 - percent
    tag = labels.select(F.col("node").alias("hub"), F.col("component").alias("group"))
    star = members.select("hub", "node").distinct().join(tag, "hub", "left").select(F.coalesce("group", "hub").alias("group"), "node").distinct()
    named = star.join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"))
    # A hub and one other node have met already.
    mixed = named.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("group", "size")
    nodes = scratch.keep(named.join(mixed, "group"), "groups")
    listed = sets.join(nodes.select("node").distinct(), "node", "left_semi").mapInArrow(_listed, "node long, n long, shingle long").join(nodes, "node")
    listed = scratch.keep(listed.select("group", "size", "node", "n", "component", "shingle"), "listed")
    often = listed.groupBy("group", "shingle").agg(F.count("*").alias("often"), F.first("size").alias("of"))
    # A shingle of one node alone: rare, and in no other's prefix, so it takes a place but is not joined.
    counted = listed.join(often.drop("of"), ["group", "shingle"])
    held = F.col("often") * 2 > F.col("size")
    own = counted.groupBy("group", "node", "component").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(~held & (F.col("often") > 1), F.struct("often", "shingle")))).alias("extra"), F.count_if(F.col("often") == 1).alias("alone"), F.collect_list(F.when(held, F.col("shingle"))).alias("kept")
    )
    # Only majority shingles meet by group (at most twice a text's own number); tables let AQE split a large group in the joins.
    center = scratch.keep(often.where("often * 2 > of").groupBy("group").agg(F.array_sort(F.collect_list("shingle")).alias("center")), "centers")
    told = own.join(center, "group", "left").withColumn("center", F.coalesce("center", F.array().cast("array<long>"))).withColumn("missing", F.array_sort(F.array_except("center", "kept")))
    told = told.withColumn("d", (F.size("extra") + F.col("alone") + F.size("missing")).cast("long")).withColumn("far", F.lit(full) * F.col("d") - F.lit(gap) * F.col("n"))
    elements = F.concat(F.transform("extra", lambda e: F.struct(F.lit(1).alias("sign"), e["shingle"].alias("shingle"))), F.transform("missing", lambda e: F.struct(F.lit(-1).alias("sign"), e.alias("shingle"))))
    told = scratch.keep(told.select("group", "node", "component", "n", "d", "far", "alone", F.size("center").cast("long").alias("c"), elements.alias("elements")), "told")

    least = scratch.keep(told.groupBy("group").agg(F.min(F.struct("far", "node", "component")).alias("m")), "least")
    near = told.join(least, "group").withColumn("outer", F.col("far") + F.col("m.far") > 0)
    sure = near.where(~F.col("outer") & (F.col("component") != F.col("m.component"))).select(F.col("m.node").alias("a"), F.col("node").alias("b"))
    # What A is at least for any partner of a fitting size.
    size = F.least(F.greatest("c", F.ceil(F.col("n") * percent / 100)), F.floor(F.col("n") * 100 / percent))
    of_size = F.lit(full) * F.abs(size - F.col("c")) - F.lit(gap) * size
    shared = lambda least_far: F.greatest(F.lit(1), F.ceil((F.col("far") + least_far) / (2 * full)))
    prefix = lambda least_far: F.greatest(F.lit(0), F.col("d") - shared(least_far) + 1 - F.col("alone")).cast("int")
    short, long_ = prefix(F.greatest("m.far", 1 - F.col("m.far"), of_size)), prefix(F.greatest("m.far", of_size))
    row = lambda n: near.select("group", "node", "n", "component", "outer", F.explode(F.slice("elements", F.lit(1), n)).alias("e"))
    brief = row(short)
    other = brief.select("group", "e", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("component").alias("bc"), F.col("outer").alias("bo"))
    apart = (F.col("component") != F.col("bc")) & _fits(F.col("n"), F.col("bn"), percent)
    both = brief.where("outer").join(other.where("bo"), ["group", "e"]).where(apart & (F.col("node") < F.col("b")))
    one = row(long_).where("outer").join(other.where("not bo"), ["group", "e"]).where(apart)
    return sure, both.unionByName(one).select(F.col("node").alias("a"), "b").distinct()


def without_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with all columns, but of each near-duplicate group only the document of the smallest id.

    Of rows that repeat an id and a text one stays; rows of a null id all stay.
    Ids meet texts in one join on (id, text hash), which also serves the
    choice among repeated rows.
    """
    groups = near_duplicates(docs, shingle, percent)
    stay = groups.where("kept and doc_id is not null").select("doc_id", "text_hash").distinct()
    mark, turn = free_name("text_hash", docs), free_name("turn", docs)
    named = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    known = named.join(stay.select(F.col("doc_id").alias("doc_id"), F.col("text_hash").alias(mark)), ["doc_id", mark], "left_semi")
    first = known.withColumn(turn, F.row_number().over(W.partitionBy("doc_id", mark).orderBy(F.lit(1)))).where(F.col(turn) == 1).drop(turn, mark)
    return first.select(docs.columns).unionByName(docs.where("doc_id is null"))
