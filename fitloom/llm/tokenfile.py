"""Token-id shards: a concatenated id array with Elias-Fano document boundaries.

A shard file is a header, the Elias-Fano code of its document ids (ascending),
the Elias-Fano code of its document ends, then the ids as 16- or 32-bit
little-endian integers.  Documents of a shard, and shards by their number, are
in ascending doc_id order.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fitloom.llm.common import BASE, BYTE_VALUE, LOWER, SPACE, U64, byte_view, mix, released, small_batches

MAGIC, VERSION = b"FLTK", 2
HEAD = struct.Struct("<4sHHqqqq")  # magic, version, bytes an id, documents, null ids, smallest id, ids
#: A shard is closed at this many ids; one document is never split.
SHARD_IDS = 4_000_000
#: Bytes of text that are cut into words at once, and of the table of known words; a full table is emptied, which costs time only.
PIECE_BYTES, TABLE_BYTES = 1 << 20, 48 << 20
_WORKER: dict[int, tuple] = {}


class EliasFano:
    """A non-decreasing sequence of n numbers below a bound in n * (2 + log2(bound / n)) bits or so.

    High parts are a bit string with a one for each number, low parts stand side by
    side.  The directory has the place of every SAMPLE-th one in 32 bits (an
    eighth of a bit a number); select starts there and passes SAMPLE ones at most.
    """

    SAMPLE = 256

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) + 1 if n else 0) + 1, np.uint8)
        bits[high] = 1
        low = np.zeros((n, low_bits), np.uint8)
        for k in range(low_bits):
            low[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(low.reshape(-1), bitorder="little"), np.packbits(bits, bitorder="little"), high[:: cls.SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<qqqq", self.n, self.low_bits, len(self.low), len(self.high)) + self.directory.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, nl, nh = struct.unpack_from("<qqqq", data, at)
        at += 32
        nd = -(-n // cls.SAMPLE)
        directory = np.frombuffer(data, "<u4", nd, at)
        at += 4 * nd
        low, high = np.frombuffer(data, np.uint8, nl, at), np.frombuffer(data, np.uint8, nh, at + nl)
        return cls(n, low_bits, low, high, directory), at + nl + nh

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """The numbers first .. first + count - 1, all of which lie under one entry of the directory."""
        k = first // self.SAMPLE
        at, end = int(self.directory[k]), int(self.directory[k + 1]) if k + 1 < len(self.directory) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8 : (end + 7) // 8], bitorder="little")[at % 8 :])[first - k * self.SAMPLE :][:count]
        high = ones + at - np.arange(first, first + count)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].reshape(count, self.low_bits)
        low = np.zeros(count, np.int64)
        for j in range(self.low_bits):
            low |= bits[:, j].astype(np.int64) << j
        return high << self.low_bits | low

    def blocks(self):
        """All numbers in order, as many at a time as lie under one entry of the directory."""
        for a in range(0, self.n, self.SAMPLE):
            yield self.select(a, min(self.SAMPLE, self.n - a))


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """One shard of documents in ascending order (null ids first); ids are of `width` bytes each."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum(np.array(lengths, np.int64)) if lengths else np.zeros(0, np.int64)
    head = HEAD.pack(MAGIC, VERSION, width, len(doc_ids), len(doc_ids) - len(known), least, int(ends[-1]) if len(ends) else 0)
    body = head + EliasFano.of((known.astype(object) - least).astype(np.uint64) if len(known) else known).to_bytes() + EliasFano.of(ends).to_bytes()
    return body + b"\0" * (-len(body) % 4) + ids


class Shard:
    """An opened shard: any document's id, offsets and ids by select; nothing is expanded on opening."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, version, width, self.n, self.nulls, self.least, total = HEAD.unpack_from(view)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        self.known, at = EliasFano.read(view, HEAD.size)
        self.ends, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", total, at + -at % 4)

    def document(self, i: int) -> tuple[int | None, int, int]:
        """(id, start, end) of the i-th document; start and end count the shard's ids."""
        start = int(self.ends.select(i - 1)[0]) if i else 0
        return (None if i < self.nulls else int(self.known.select(i - self.nulls)[0]) % 2**64 + self.least), start, int(self.ends.select(i)[0])

    def documents(self):
        """(ids, starts, ends) of all documents in order, a block of the boundaries at a time."""
        last, i = 0, 0
        held, known = np.zeros(0, np.int64), self.known.blocks()
        for ends in self.ends.blocks():
            nulls = min(max(self.nulls - i, 0), len(ends))
            while len(held) < len(ends) - nulls:
                held = np.concatenate([held, next(known)])
            yield [None] * nulls + [int(x) % 2**64 + self.least for x in held[: len(ends) - nulls]], np.concatenate([[last], ends[:-1]]), ends
            held, last, i = held[len(ends) - nulls :], int(ends[-1]), i + len(ends)


class WordTable:
    """Whole texts through a tokenizer that lower-cases, drops white space and ends words at tokens in </w>; each different word is encoded once.

    Such a tokenizer first splits text at ASCII white space and wherever a run of
    letters begins or ends (but for letters after an apostrophe, 's, which are left
    with it, and for signs that special tokens contain), so a text's ids are
    those of its pieces between these.  Known pieces are a sorted array of 64-bit hashes beside the places of
    their ids.  Runs of small Latin letters are what normalising and splitting
    leave alone, so they go through the tokenizer's merges without those steps.
    """

    def __init__(self, blob: bytes, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        rules = json.loads(blob)
        self.whole, self.dtype = Tokenizer.from_str(blob.decode()), dtype
        # The merges alone: words come apart at spaces, bytes are spelled as the tokenizer spells them, and no word comes twice.
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in rules["model"]["merges"]]
        self.merges = Tokenizer(models.BPE(vocab=rules["model"]["vocab"], merges=pairs, cache_capacity=0, end_of_word_suffix=rules["model"]["end_of_word_suffix"]))
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.spell = np.arange(256, dtype="<u4")
        for k, b in enumerate(b for b in range(256) if b not in plain):
            self.spell[b] = 256 + k if b >= 128 else b
        self.last = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(self.whole.get_vocab_size())])
        # Of each byte: 1 an ASCII letter, 2 any but white space, 4 a sign where a run of letters ends, 8 one after which a run begins.
        special = {c for t in rules.get("added_tokens", []) for c in t["content"]}
        signs = [b for b in range(33, 127) if not chr(b).isalpha() and chr(b) not in special]
        self.kind = np.where(SPACE, 0, 2).astype(np.uint8)
        self.kind[[b for b in range(128) if chr(b).isalpha()]] |= 1
        self.kind[signs] |= 4
        self.kind[[b for b in signs if b != ord("'")]] |= 8
        self._empty()

    def _empty(self) -> None:
        self.keys, self.at, self.count, self.ids = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def _learn(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each piece's, how many) of the new pieces low[start:stop]; plain marks runs of small Latin letters."""
        count, begin, ids, runs = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32), [], np.flatnonzero(plain)
        if len(runs):
            size = stop[runs] - start[runs] + 1
            upto = np.cumsum(size)
            joined = low[np.minimum(np.repeat(start[runs] - upto + size, size) + np.arange(int(upto[-1])), len(low) - 1)]
            joined[upto - 1] = 32
            got = np.array(self.merges.encode_batch_fast([np.take(self.spell, joined).tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(runs):
                raise AssertionError("the tokenizer did not keep words apart")
            begin[runs] = np.concatenate([[0], ends[:-1]])
            count[runs] = ends - begin[runs]
            ids.append(got)
        odd = np.flatnonzero(~plain)
        words = [low[a:b].tobytes().decode() for a, b in zip(start[odd].tolist(), stop[odd].tolist(), strict=True)]
        found = [x.ids for x in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        count[odd] = [len(x) for x in found]
        begin[odd] = int(count[runs].sum()) + np.cumsum(count[odd]) - count[odd]
        ids.append(np.array([x for one in found for x in one], self.dtype))
        return np.concatenate(ids), begin, count

    def encode(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each piece in raw, ids of each piece)."""
        n = len(raw)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, kind = np.take(LOWER, raw), np.take(self.kind, raw)
        solid, letter = kind != 0, kind & 1 != 0
        if (raw == 0xC3).any():  # Latin letters of two bytes
            lead = np.zeros(n, bool)
            lead[:-1] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            trail = np.concatenate([[False], lead[:-1]])
            low[trail & (low >= 0x80) & (low <= 0x9E)] += 32
            letter |= lead | trail
        start = solid.copy()
        start[1:] &= ~solid[:-1] | (kind[1:] & 4 != 0) & letter[:-1] | (kind[:-1] & 8 != 0) & letter[1:]
        at = np.flatnonzero(start)
        if not len(at):
            return np.zeros(0, self.dtype), at, at
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | start[1:]
        stop = np.flatnonzero(stop) + 1
        plain = np.bitwise_and.reduceat(letter | ~solid, at)
        # Only runs of letters are lower-cased here; special tokens, which the library finds in any word, have a case.
        large = np.flatnonzero(low != raw)
        large = large[~plain[np.searchsorted(at, large, "right") - 1]]
        low[large] = raw[large]
        place = np.arange(n, dtype=np.int32)
        place[at[0] :] -= np.repeat(at.astype(np.int32), np.diff(np.append(at, n)))
        value = np.take(BYTE_VALUE, low) * np.take(np.cumprod(np.concatenate([[U64(1)], np.full(int(place.max()), BASE, U64)])), place)
        value[~solid] = 0
        hashed = mix(np.add.reduceat(value, at))
        keys, which = np.unique(hashed, return_inverse=True)
        if self.ids.nbytes + 16 * len(self.keys) > TABLE_BYTES:
            self._empty()
        slot = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(slot, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            first = np.zeros(len(keys), np.int64)
            first[which[::-1]] = np.arange(len(at) - 1, -1, -1)
            first = first[new]
            got, begin, count = self._learn(low, at[first], stop[first], plain[first])
            self.keys, self.at, self.count = (np.insert(old, slot[new], x) for old, x in ((self.keys, keys[new]), (self.at, begin + np.int32(len(self.ids))), (self.count, count)))
            self.ids = np.concatenate([self.ids, got])
            slot = np.searchsorted(self.keys, keys)
        count = self.count[slot][which].astype(np.int64)
        upto = np.cumsum(count)
        return self.ids[np.repeat(self.at[slot][which].astype(np.int64) - upto + count, count) + np.arange(int(upto[-1]))], at, count

    def documents(self, raw: np.ndarray, offsets: np.ndarray):
        """(first row, lengths, ids) of neighbouring documents, a piece of the text at a time; a document of several pieces is put together."""
        n, i = len(offsets) - 1, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
            text = raw[offsets[i] : offsets[j]]
            if j > i + 1 or len(text) <= PIECE_BYTES:
                # A space between neighbours, so that no word goes on in the next text.
                gaps = offsets[i + 1 : j] - offsets[i]
                ids, at, count = self.encode(np.insert(text, gaps, 32))
                upto = np.concatenate([[0], np.cumsum(count)])
                yield i, np.diff(upto[np.searchsorted(at, np.append(offsets[i:j] - offsets[i] + np.arange(j - i), len(text) + j - i))]), ids
            else:
                parts, a = [], 0
                while a < len(text):
                    b = a + PIECE_BYTES
                    if b < len(text):  # end at white space
                        spaces = np.flatnonzero(SPACE[text[a:b]])
                        if len(spaces):
                            b = a + int(spaces[-1]) + 1
                        else:
                            later = np.flatnonzero(SPACE[text[b:]])
                            b = b + int(later[0]) if len(later) else len(text)
                    parts.append(self.encode(text[a:b])[0])
                    a = b
                ids = np.concatenate(parts)
                yield i, np.array([len(ids)]), ids
            i = j


def _write(blob, folder: str, end_id: int):
    def run(batches):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        key = zlib.crc32(blob.value)
        if key not in _WORKER:
            from tokenizers import Tokenizer

            width = 2 if Tokenizer.from_str(blob.value.decode()).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
            _WORKER[key] = WordTable(blob.value, f"<u{width}"), width
        cache, width = _WORKER[key]
        docs, lengths, held, total, number, made = [], [], [], 0, 0, []

        def close():
            nonlocal docs, lengths, held, total, number
            name = f"shard-{part:06d}-{number:05d}.tok"
            aside = f"{root}/.{name}.{uuid.uuid4().hex}"  # readers pass over it; a lost task leaves no half shard
            with fs.open_output_stream(aside) as f:
                f.write(pack_shard(docs, lengths, b"".join(held), width))
            fs.move(aside, f"{root}/{name}")
            made.append((name, part, number, len(docs), total))
            docs, lengths, held, total, number = [], [], [], 0, number + 1

        for batch in batches:
            raw, offsets = byte_view(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, sizes, ids in cache.documents(raw, offsets):
                upto = np.cumsum(sizes)
                data, known = np.insert(ids, upto, end_id).tobytes(), (upto + np.arange(1, len(upto) + 1)).tolist()
                a = 0
                for k, b in enumerate(known):
                    docs.append(names[i + k])
                    lengths.append(b - a)
                    held.append(data[a * width : b * width])
                    total, a = total + b - a, b
                    if total >= SHARD_IDS:
                        close()
        if docs:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["name", "part", "number", "n_docs", "n_ids"])

    return run


def _read(batches):
    for batch in batches:
        content, offsets = byte_view(batch.column(0))
        for i, base in enumerate(batch.column(1).to_pylist()):
            shard = Shard(content[offsets[i] : offsets[i + 1]].tobytes())
            for docs, starts, ends in shard.documents():
                ids = [shard.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise documents into shards under folder (a URI that all executors reach).

    Runs at once; gives the list of shards (name, part, number, n_docs, n_ids)
    as a table beside them.  Documents are dealt by ranges of doc_id, so
    that shards follow one another in ascending order; end_id closes each
    document.  Cases: a null or empty text is end_id alone; null ids come
    first; rows that repeat an id stay side by side; an empty table gives no
    shard; other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:  # a few MB, whatever the corpus
        blob = spark.sparkContext.broadcast(f.read())
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(released(_write(blob, folder, end_id)), "name string, part int, number int, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in folder, from its shards.

    start counts the ids of all documents before it: those in earlier shards,
    from the list of shards, and those before it in its own, by select on the
    shard's boundaries.  Running sums go over the shards of a part and over
    parts, so no task sees more rows than there are of either.
    """
    manifest = spark.read.parquet(f"{folder}/_manifest")
    earlier = lambda by, *order: F.coalesce(F.sum("n_ids").over((W.partitionBy(*by) if by else W).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier((), "part").alias("before"))
    bases = manifest.withColumn("inner", earlier(("part",), "number")).join(parts, "part").select("name", (F.col("before") + F.col("inner")).alias("base"))
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.tok").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(bases, "name").select("content", "base").mapInArrow(released(_read), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
