"""Token ids in directly addressable codes.

Ids are split into chunks of a few bits. Level k holds the k-th chunk of every
id that has one; a bitmap beside it says which of them go on in level k + 1,
and a rank directory counts the ones before each block of the bitmap. The id at
any position is read with one chunk and one rank per level; no block is decoded.

Documents are range-partitioned by id; each task writes its range as segments
(binary values of a Parquet table, committed by Spark on any store).

Segment, little-endian: ``RLDC``, u32 version, u32 levels, u32 chunk bits, u64
documents, u64 tokens; i64 doc ids, u8 id-is-null flags, u64 token offsets
(documents + 1); per level u64 entries, the chunks (u8), then except in the
last level the bitmap (bit i of byte i // 8, padded to BLOCK bits) and u64 ranks.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices
from .scratch import Scratch

MAGIC = b"RLDC"
BLOCK = 512
CHUNK_BITS = 8
SEGMENT_TOKENS = 2_000_000
#: Units that a worker holds in a dict (about 150 bytes each), and how many such dicts it keeps packed (about 50 bytes a unit).
CACHED_UNITS = 250_000
PACKED_RUNS = 6
#: Bytes of text for a task, at most about.
TASK_BYTES = 64 << 20
END_ID = 0
#: Where a text has no two blanks together, every space and line feed begins a new piece for the tokenizer.
TWO_BLANKS = re.compile(r"[\s\x1c-\x1f][\s\x1c-\x1f]")
#: Marks that are a piece of their own between a letter or digit and a blank.
FINAL_MARKS = frozenset(".,;:!?")


class PackedUnits:
    """Units and their ids in four flat columns, in order of the units' hashes."""

    def __init__(self, units: dict[str, bytes]):
        words = list(units)
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        order = np.argsort(hashes)
        self.hashes, places = hashes[order], pa.array(order)
        self.words = pa.array(words, pa.large_string()).take(places)
        self.ids = pa.array(units.values(), pa.large_binary(), size=len(words)).take(places)

    def recall(self, words: np.ndarray, hashes: np.ndarray, into: dict[str, bytes]) -> np.ndarray:
        """Put those of ``words`` that are here ``into`` a dict; marks them. A hash finds a place, the spelling decides."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        places = pa.array(at[found])
        spelt, ids = (c.take(places).to_numpy(zero_copy_only=False) for c in (self.words, self.ids))
        same = spelt == words[found]
        found[found] = same
        into.update(zip(spelt[same].tolist(), ids[same].tolist(), strict=True))
        return found


class UnitEncoder:
    """Ids of whole texts as the tokenizers library gives them, each distinct unit encoded once.

    A byte-level BPE that splits at blanks never joins a character other than a
    blank with a blank that follows. So a text without two blanks together can
    be cut before each space and line feed, and the units' ids are remembered
    between texts and tasks. All other texts, and all texts under other kinds
    of tokenizers, are encoded whole.
    """

    def __init__(self, spec: bytes, max_units: int = CACHED_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer, self.max_units = Tokenizer.from_buffer(spec), max_units
        self.units: dict[str, bytes] = {}
        self.packed: list[PackedUnits] = []
        kind = json.loads(spec)
        pre = kind.get("pre_tokenizer") or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])) for t in kind.get("added_tokens", []))
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not kind.get("normalizer") and plain
        if self.cuts:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.marks = dict(zip(FINAL_MARKS, self.whole(list(FINAL_MARKS)), strict=True))
            self.leads = np.zeros(max(vocab.values()) + 1, bool)
            self.leads[[i for t, i in vocab.items() if t[0] in "ĠĊ"]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Remember the ids of units: a word that follows a space, or a line feed and a word.

        A final mark is put after the ids of the word before it. Many words are
        encoded at once and told apart by the ids that begin with a blank.
        """
        ends = {w for w in words if len(w) > 1 and w[-1] in FINAL_MARKS and w[-2].isalpha()}
        plain = list((words - ends) | {b for b in (w[:-1] for w in ends) if b not in self.units})
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            spelt = [w if w[:1] == "\n" else " " + w for w in some]
            ids = np.asarray(self.tokenizer.encode("".join(spelt), add_special_tokens=False).ids, "<u4")
            starts = np.flatnonzero(self.leads[ids]).tolist()
            if len(starts) == len(some) and starts[0] == 0:
                raw = ids.tobytes()
                cuts = [4 * x for x in [*starts[1:], len(ids)]]
                self.units.update((w, raw[4 * a : b]) for w, a, b in zip(some, starts, cuts, strict=True))
            else:
                self.units.update(zip(some, self.whole(spelt), strict=True))
        self.units.update((w, self.units[w[:-1]] + self.marks[w[-1]]) for w in ends)

    def recall(self, words: set[str]) -> set[str]:
        """Remember packed units again; returns the words that none of the runs has."""
        if not self.packed:
            return words
        rest = np.array(list(words), object)
        hashes = np.fromiter(map(hash, rest), np.int64, len(rest))
        order = np.argsort(hashes)  # neighbours are looked up one after the other
        rest, hashes = rest[order], hashes[order]
        for run in self.packed:
            left = ~run.recall(rest, hashes, self.units)
            rest, hashes = rest[left], hashes[left]
        return set(rest.tolist())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if not self.cuts or TWO_BLANKS.search(t)]
        out = dict(zip(whole, self.whole([texts[i] for i in whole]), strict=True))
        cut = [(i, t.replace("\n", " \n").split(" ")) for i, t in enumerate(texts) if i not in out]
        heads = self.whole([parts[0] for _, parts in cut])
        wanted = set()
        for _, parts in cut:
            wanted.update(parts[1:])
        new = {w for w in wanted if w not in self.units}
        if len(self.units) + len(new) > self.max_units:
            # What is asked for again comes back from the packed units, the latest first.
            self.packed = [PackedUnits(self.units), *self.packed][:PACKED_RUNS] if self.units else self.packed
            self.units, new = {}, wanted
        self.learn(self.recall(new))
        known = self.units.__getitem__
        for (i, parts), head in zip(cut, heads, strict=True):
            out[i] = head + b"".join(map(known, parts[1:]))
        return [np.frombuffer(out[i], "<u4") for i in range(len(texts))]


_ENCODERS: dict[int, UnitEncoder] = {}


def _encoder(spec: bytes) -> UnitEncoder:
    """The worker's encoder: its units stay from task to task."""
    key = zlib.crc32(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = UnitEncoder(spec)
    return _ENCODERS[key]


def pack_segment(doc_ids: list[int | None], docs: list[np.ndarray], chunk_bits: int = CHUNK_BITS) -> bytes:
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    levels, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = (rest >> np.uint32(chunk_bits)) > 0
        levels.append(((rest & np.uint32((1 << chunk_bits) - 1)).astype(np.uint8), goes_on))
        if not goes_on.any():
            break
        rest = rest[goes_on] >> np.uint32(chunk_bits)
    head = MAGIC + struct.pack("<IIIQQ", 1, len(levels), chunk_bits, len(docs), len(ids))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    out = [head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), offsets.tobytes()]
    for k, (chunks, goes_on) in enumerate(levels):
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes()]
        if k + 1 < len(levels):
            bits = np.zeros(-(-len(chunks) // BLOCK) * BLOCK, bool)
            bits[: len(chunks)] = goes_on
            ones = bits.reshape(-1, BLOCK).sum(1)
            out += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
    return b"".join(out)


class Segment:
    """Random and sequential access to one segment."""

    def __init__(self, raw: bytes):
        version, n_levels, self.bits, self.n_docs, self.n_tokens = struct.unpack_from("<IIIQQ", raw, 4)
        if raw[:4] != MAGIC or version != 1:
            raise ValueError("not a token segment")
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, n, at)
            at += x.nbytes
            return x

        self._ids, nulls = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(self._ids, nulls, strict=True)]
        self.offsets = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for k in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks, blocks = take("u1", n), -(-n // BLOCK)
            last = k + 1 == n_levels
            self.levels.append((chunks, None if last else take("u1", blocks * BLOCK // 8), None if last else take("<u8", blocks)))

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            before = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i, shift = int(ranks[block]) + int(before.sum()), shift + self.bits
        raise ValueError("truncated segment")

    def all(self) -> np.ndarray:
        """All ids, from the last level up."""
        ids = None
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if bitmap is not None:
                here[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= ids << np.uint32(self.bits)
            ids = here
        return ids

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, read at their positions."""
        return np.array([self[i] for i in range(self.offsets[k], self.offsets[k + 1])], np.uint32)


SEGMENTS = "shard int, segment int, n_docs bigint, n_tokens bigint, payload binary"
_SEGMENTS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
_DOCS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encode all ``docs`` (doc_id, text) in ascending doc_id order into segments under ``path``.

    Null text has no ids but the end id; null doc_ids come first; rows with the
    same doc_id follow each other in the order of a hash of their texts. A hot
    doc_id is spread by that hash. An empty table gives no segment; a text of any
    length is encoded whole; other columns are not read. A task gets about
    ``TASK_BYTES`` of text, however much there is.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def encode(batches):
        encoder, shard, segment = _encoder(spec.value), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        end, count = np.array([end_id], np.uint32), 0

        def flush():
            columns = [[shard], [segment], [len(ids)], [count], [pack_segment(ids, held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SEGMENTS.types, strict=True)], schema=_SEGMENTS)

        for rows in slices(batches, rows=500):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            for doc_id, x in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids.append(doc_id)
                held.append(np.concatenate([x, end]))
                count += len(x) + 1
                if count >= segment_tokens:
                    yield flush()
                    ids, held, count, segment = [], [], 0, segment + 1
        if ids:
            yield flush()

    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(encode, SEGMENTS).write.mode("overwrite").parquet(path)
    return spark.read.schema(SEGMENTS).parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: one row per document, from the segments alone."""

    def decode(batches):
        for batch in batches:
            for shard, segment, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "payload")), strict=True):
                seg = Segment(raw)
                ids = seg.all().astype("<u4")
                bounds = seg.offsets
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                n = seg.n_docs
                columns = [[shard] * n, [segment] * n, list(range(n)), seg.doc_ids, bounds[:-1].tolist(), np.diff(bounds).tolist(), crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DOCS.types, strict=True)], schema=_DOCS)

    found = segments.select("shard", "segment", "payload").mapInArrow(decode, "shard int, segment int, place bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # Tokens before each shard (one row a shard, a window over all), and before each segment of a shard.
    small = segments.select("shard", "segment", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = small.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("base"))
    starts = small.withColumn("inner", before(Window.partitionBy("shard").orderBy("segment"))).join(shards, "shard")
    starts = starts.select("shard", "segment", (F.col("base") + F.col("inner")).alias("base"))
    return found.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Write ``docs`` to the shared folder and return what the written segments say of each document."""
    return read_tokens(write_tokens(docs, Scratch(docs.sparkSession, "tokens").path("segments"), tokenizer_file, **options))
