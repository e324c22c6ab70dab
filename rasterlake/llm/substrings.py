"""Substring deduplication: words in windows that already start earlier are removed.

Each window is counted at its least gram (``GRAM`` words), which equal windows
share at the same place, so a counter is never below the number of equal windows.

Pass 1: a task's sketches are sparse, a list of gram keys for each block of the
count-min sketch. A block's lists meet in one task, which merges their counters,
and the same lists are answered with marks: estimated repeated, and hot. Marks go
back to the chunks of documents that asked and become bits of each document; the
sketch itself never leaves its blocks.

Pass 2 hashes only the windows whose counters say they repeat, and groups them
exactly; the windows of a hot gram are dealt by their own hashes. Pass 3 removes
the words. The texts are shuffled once, for both joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .scratch import Scratch
from .words import WordHashes, blank_words, mix64

WINDOW, GRAM = 20, 11
#: Rows of counters of a block, and counters for each gram.
DEPTH, CELLS = 2, 4
#: Grams of a block of the sketch, and of a chunk of documents.
BLOCK_GRAMS = 1_000_000
CHUNK_GRAMS = 1_000_000
#: Bytes of text for each counted gram, to size the blocks by.
BYTES_PER_GRAM = 30
#: A gram counted so often has its windows dealt by their own hashes.
HOT_GRAM = 5_000
FLUSH_WINDOWS = 2_000_000
GROUP_BYTES = 16_000_000
NO_ID = -(1 << 63)

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_FLAG = np.uint32(1 << 31)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(x) for x in arrays], "<u8").tobytes(), *(x.tobytes() for x in arrays)])


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, np.frombuffer(raw, "<u8", len(kinds)).tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _A + (right ^ (right >> _U(31))) * _B
    return h ^ (h >> _U(29))


def run_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values, put together from runs of powers of two."""
    power, n, out, done = x, 1, None, 0
    while True:
        if size & n:
            out = power[: len(power)] if out is None else _joined(out[: len(x) - done - n + 1], power[done:])
            done += n
        if done == size:
            return out[: max(0, len(x) - size + 1)]
        power = _joined(power[: max(0, len(power) - n)], power[n:])
        n *= 2


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """The pick (minimum, maximum) of all runs of ``size``."""
    n = 1
    while 2 * n <= size:
        x, n = pick(x[:-n], x[n:]), 2 * n
    rest = size - n
    return pick(x[:-rest], x[rest:]) if rest else x


class Batch:
    """Word hashes of several texts in one row, and what their windows need."""

    def __init__(self, hashes: WordHashes, texts: list[str | None]):
        rows = [hashes.of(blank_words(t)) for t in texts]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.x = np.concatenate(rows) if rows else np.empty(0, np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = len(self.x) - WINDOW + 1
        self.least = self.valid = self.grams = None
        if n > 0:
            last = np.repeat(self.starts + self.lengths - WINDOW, self.lengths)[:n]
            self.valid = np.arange(n) <= last
            self.grams = mix64(run_hashes(self.x, GRAM) * _A)
            self.least = _slide(self.grams, WINDOW - GRAM + 1, np.minimum)

    def places(self) -> np.ndarray:
        """Where the grams begin that are least in some window."""
        if self.least is None or not self.valid.any():
            return np.empty(0, np.int64)
        reach = WINDOW - GRAM
        pad = np.zeros(reach, np.uint64)
        most = _slide(np.concatenate([pad, np.where(self.valid, self.least, _U(0)), pad]), reach + 1, np.maximum)
        return np.flatnonzero(most == self.grams)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The grams that are least in some window, once for each place, and how many each text has."""
        at = self.places()
        return (self.grams[at] if len(at) else np.empty(0, np.uint64)), np.bincount(np.searchsorted(self.starts + self.lengths, at, "right"), minlength=len(self.lengths))


def block_of(mixed: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each mixed gram; in sorted order, blocks are too."""
    return ((mixed >> _U(32)) * _U(blocks)) >> _U(32)


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each 31-bit key in a row of its block."""
    return (mix64(keys.astype(np.uint64) + _U((row + 1) * int(_B) % 2**64)) >> _U(64 - bits)).astype(np.uint32)


def repeated(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Count-min: which keys all rows of counters hold to be 2 or more, with counters that stop at 2."""
    out = np.ones(len(keys), bool)
    for row in range(DEPTH):
        at = cells(keys, row, bits)
        twice = np.zeros(1 << bits, bool)
        twice[at[counts > 1]] = True
        ordered = np.sort(at)
        twice[ordered[1:][ordered[1:] == ordered[:-1]]] = True
        out &= twice[at]
    return out


_PIECES = "part bigint, chunk bigint, payload binary"


def _pieces(part, chunk, payload) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(chunk, pa.int64()), pa.array(payload, pa.binary())], names=["part", "chunk", "payload"])


def marks(docs: DataFrame, blocks: int, bits: int) -> DataFrame:
    """(d, th, marks): bit 2 i of ``marks`` says that a document's i-th counted gram is estimated repeated, bit 2 i + 1 that it is hot.

    Documents without a repeated gram are left out. Rows with equal (d, th) are one document.
    """

    def build(batches):
        hashes, held, chunk, size = WordHashes(), [], TaskContext.get().partitionId() << 24, 0

        def flush():
            grams, counts, d, th = (np.concatenate(c) for c in zip(*held, strict=True))
            mixed = mix64(grams + _A)
            order = np.argsort(mixed, kind="stable")
            first = np.ones(len(order), bool)
            first[1:] = mixed[order[1:]] != mixed[order[:-1]]
            heads = np.flatnonzero(first)
            ordinal = np.empty(len(order), np.uint32)
            ordinal[order] = np.cumsum(first) - 1
            yield _pieces([-1 - chunk], [chunk], [pack(d.astype("<i8"), th.astype("<i8"), counts.astype("<u4"), ordinal.astype("<u4"))])
            single, times = mixed[order[heads]], np.diff(np.append(heads, len(order)))
            block = block_of(single, blocks)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1]) if len(block) else np.empty(0, np.int64)
            parts, payloads = [], []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)], strict=False):
                more = times[a:b] > 1
                keys = (single[a:b] & _U(0x7FFFFFFF)).astype(np.uint32) | (more * _FLAG)
                parts.append(int(block[a]))
                payloads.append(pack(np.array([a], "<u8"), keys.astype("<u4"), times[a:b][more].astype("<u4")))
            for at in range(0, len(parts), 2000):
                yield _pieces(parts[at : at + 2000], [chunk] * len(parts[at : at + 2000]), payloads[at : at + 2000])

        for some in slices(batches):
            grams, counts = Batch(hashes, some.column("text").to_pylist()).counted()
            has = counts > 0
            d, th = (some.column(c).to_numpy(zero_copy_only=False)[has] for c in ("d", "th"))
            held.append((grams, counts[has], d, th))
            size += len(grams)
            if size >= CHUNK_GRAMS:
                yield from flush()
                held, size, chunk = [], 0, chunk + 1
        if size:
            yield from flush()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, lists = [], []
        for batch in batches:
            if key[0].as_py() < 0:
                yield batch
                continue
            chunks += batch.column("chunk").to_pylist()
            lists += [unpack(raw, "<u8", "<u4", "<u4") for raw in batch.column("payload").to_pylist()]
        if not lists:
            return
        keys = np.concatenate([x[1] for x in lists])
        counts = np.ones(len(keys), np.uint32)
        counts[keys >= _FLAG] = np.concatenate([x[2] for x in lists])
        keys &= _FLAG - np.uint32(1)
        twice = repeated(keys, counts, bits)
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
        total = np.add.reduceat(counts[order].astype(np.uint64), heads)
        hot = np.zeros(len(keys), bool)
        hot[order] = np.repeat(total >= HOT_GRAM, np.diff(np.append(heads, len(keys))))
        ends = np.cumsum([len(x[1]) for x in lists])
        answers = [pack(x[0], np.array([b - a], "<u8"), np.packbits(np.stack([twice[a:b], hot[a:b]], 1))) for x, a, b in zip(lists, (ends - [len(x[1]) for x in lists]).tolist(), ends.tolist(), strict=True)]
        for at in range(0, len(chunks), 2000):
            yield _pieces([0] * len(chunks[at : at + 2000]), chunks[at : at + 2000], answers[at : at + 2000])

    def assemble(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, answers = None, []
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if part < 0:
                    directory = unpack(raw, "<i8", "<i8", "<u4", "<u4")
                else:
                    answers.append(unpack(raw, "<u8", "<u8", "u1"))
        d, th, counts, ordinal = directory
        said = np.zeros((int(ordinal.max()) + 1, 2), bool)
        for at, n, raw in answers:
            said[int(at[0]) : int(at[0]) + int(n[0])] = np.unpackbits(raw, count=2 * int(n[0])).reshape(-1, 2)
        said = said[ordinal]
        ends = np.cumsum(counts.astype(np.int64))
        out = [(int(i), int(t), np.packbits(said[a:b]).tobytes()) for i, t, a, b in zip(d, th, (ends - counts).tolist(), ends.tolist(), strict=True) if said[a:b, 0].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["d", "th", "marks"])

    built = docs.select("d", "th", "text").mapInArrow(build, _PIECES)
    answered = built.groupBy("part").applyInArrow(merge, _PIECES)
    per_doc = answered.groupBy("chunk").applyInArrow(assemble, "d bigint, th bigint, marks binary")
    return per_doc.groupBy("d", "th").agg(F.max("marks").alias("marks"))


_FOUND = "part bigint, payload binary"


def _found(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "payload"])


def _later(order: np.ndarray, keys: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
    """In sorted ``order``, which entries repeat the keys of an earlier one at another place."""
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order[1:]] == k[order[:-1]]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    moved = np.zeros(len(order), bool)
    for p in place:
        moved |= p[order] != p[order[head]]
    return same & moved


def _by_target(d: np.ndarray, th: np.ndarray, pos: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """(-1 - target, starts of its documents): a document's starts all go to one target."""
    if not len(d):
        return []
    target = (mix64(d.astype(np.uint64) * _A + th.astype(np.uint64)) % _U(parts)).astype(np.int64)
    order = np.lexsort((pos, th, d, target))
    d, th, pos, target = d[order], th[order], pos[order], target[order]
    cuts = np.flatnonzero(np.diff(target)) + 1
    return [(-1 - int(target[some[0]]), pack(*_runs(d[some], th[some]), pos[some].astype("<u4"))) for some in np.split(np.arange(len(d)), cuts)]


def _runs(d: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents of sorted entries, and how many entries each has."""
    heads = np.concatenate([[0], np.flatnonzero((np.diff(d) != 0) | (np.diff(th) != 0)) + 1])
    return d[heads].astype("<i8"), th[heads].astype("<i8"), np.diff(np.append(heads, len(d))).astype("<u4")


def repeated_starts(marked: DataFrame, parts: int) -> DataFrame:
    """(part, payload) of ``marked`` (d, th, doc_id, text, marks): windows still to be grouped; with a negative part, starts known to repeat earlier ones.

    A task compares its own windows first: of equal ones only the earliest goes
    on, so a window found everywhere is one entry per flush.
    """

    def run(batches):
        hashes, held, size = WordHashes(), [], 0

        def flush():
            part, h1, h2, d, th, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((pos, th, d, h2, h1))
            later = _later(order, [h1, h2], [d, th, pos])
            gone = order[later]
            rows = _by_target(d[gone], th[gone], pos[gone], parts)
            keep = order[~later]
            keep = keep[np.lexsort((pos[keep], th[keep], d[keep], part[keep]))]
            cuts = np.flatnonzero(np.diff(part[keep])) + 1
            for some in np.split(keep, cuts) if len(keep) else []:
                payload = pack(*_runs(d[some], th[some]), h1[some].astype("<u8"), h2[some].astype("<u4"), pos[some].astype("<u4"))
                rows.append((int(part[some[0]]), payload))
            for at in range(0, len(rows), 1000):
                yield _found(rows[at : at + 1000])

        for some in slices(batches):
            b = Batch(hashes, some.column("text").to_pylist())
            at = b.places()
            if not len(at):
                continue
            counts = np.bincount(np.searchsorted(b.starts + b.lengths, at, "right"), minlength=len(b.lengths))
            said = np.concatenate([np.unpackbits(np.frombuffer(m, "u1"), count=2 * n) for m, n in zip(some.column("marks").to_pylist(), counts.tolist(), strict=True)]).reshape(-1, 2).astype(bool)
            j = np.flatnonzero(b.valid & np.isin(b.least, b.grams[at[said[:, 0]]]))
            if not len(j):
                continue
            row = np.repeat(np.arange(len(b.lengths)), b.lengths)[j]
            h1, h2 = mix64(run_hashes(b.x, WINDOW)[j]), (run_hashes(mix64(b.x), WINDOW)[j] >> _U(32)).astype(np.uint32)
            hot = np.isin(b.least[j], b.grams[at[said[:, 1]]])
            part = np.where(hot, mix64(h1 + _A), b.least[j]) % _U(parts)
            d, th = (some.column(c).to_numpy(zero_copy_only=False) for c in ("d", "th"))
            held.append((part.astype(np.int64), h1, h2, d[row], th[row], (j - b.starts[row]).astype(np.uint32)))
            size += len(j)
            if size >= FLUSH_WINDOWS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return marked.select("d", "th", "doc_id", "text", "marks").mapInArrow(run, _FOUND)


def _grouped(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Which windows of a part repeat an earlier one, by target; what has a target already goes through."""
    columns = [[], [], [], [], []]
    for batch in batches:
        if key[0].as_py() < 0:
            yield batch
            continue
        for raw in batch.column("payload").to_pylist():
            d, th, each, h1, h2, pos = unpack(raw, "<i8", "<i8", "<u4", "<u8", "<u4", "<u4")
            for c, v in zip(columns, (np.repeat(d, each), np.repeat(th, each), h1, h2, pos), strict=True):
                c.append(v)
    if not columns[0]:
        return
    d, th, h1, h2, pos = (np.concatenate(c) for c in columns)
    order = np.lexsort((pos, th, d, h2, h1))
    gone = order[_later(order, [h1, h2], [d, th, pos])]
    yield _found(_by_target(d[gone], th[gone], pos[gone], parts))


def _gathered(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, th, starts) of a target's documents."""
    columns = [[], [], []]
    for batch in batches:
        for raw in batch.column("payload").to_pylist():
            d, th, each, pos = unpack(raw, "<i8", "<i8", "<u4", "<u4")
            for c, v in zip(columns, (np.repeat(d, each), np.repeat(th, each), pos), strict=True):
                c.append(v)
    d, th, pos = (np.concatenate(c) for c in columns)
    order = np.lexsort((pos, th, d))
    d, th, each = _runs(d[order], th[order])
    starts = [p.tobytes() for p in np.split(pos[order].astype("<u4"), np.cumsum(each)[:-1])]
    for at in range(0, len(d), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(d[at : at + 2000]), pa.array(th[at : at + 2000]), pa.array(starts[at : at + 2000], pa.binary())], names=["d", "th", "starts"])


def covered(n_words: int, starts: bytes) -> np.ndarray:
    """Which words lie in a window with one of the starts."""
    edges, s = np.zeros(n_words + 1, np.int64), np.unique(np.frombuffer(starts, "<u4").astype(np.int64))
    edges[s] += 1
    edges[s + WINDOW] -= 1
    return np.cumsum(edges)[:n_words] > 0


def _removed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with ``starts``: the window starts to remove (null: none)."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), "doc_id", "text")
    n_bytes = keyed.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_grams = n_bytes // BYTES_PER_GRAM
    blocks = max(least, -(-n_grams // BLOCK_GRAMS))
    bits = max(10, (CELLS * n_grams // blocks).bit_length())
    parts = max(least, n_bytes // GROUP_BYTES)
    marked = scratch.save(marks(keyed, blocks, bits), "marks").select(F.col("d").alias("_d"), F.col("th").alias("_t"), "marks")
    asked = keyed.join(marked.hint("merge"), (keyed["d"] == F.col("_d")) & (keyed["th"] == F.col("_t")))

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grouped(key, batches, parts)

    grouped = repeated_starts(asked, parts).groupBy("part").applyInArrow(group, _FOUND)
    starts = grouped.groupBy("part").applyInArrow(_gathered, "d bigint, th bigint, starts binary")
    starts = starts.select(F.col("d").alias("_d"), F.col("th").alias("_t"), "starts")
    # Both joins hash the same columns of the same rows, so Spark shuffles the texts once for both.
    return keyed.join(starts.hint("merge"), (keyed["d"] == F.col("_d")) & (keyed["th"] == F.col("_t")), "left").drop("d", "th", "_d", "_t")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``docs`` (doc_id, text).

    * Words are runs without blanks, unchanged; null and empty texts have none,
      and the digest of what is kept is that of the empty string.
    * A word goes if a window of ``WINDOW`` words over it, read in the input,
      also starts earlier: in a smaller doc_id (null before all), or earlier in
      the same document. Rows with equal doc_id are in order of a hash of their
      texts; rows equal in both are one document and share the answer.
    * An empty table gives an empty result; other columns are not read.

    Windows are equal if a 64-bit and a 32-bit hash of their words are. Texts may
    be of any length; a task holds bounded pieces of its texts.
    """

    def run(batches):
        for batch in slices(batches):
            out = [[], [], []]
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = blank_words(text)
                gone = covered(len(words), starts or b"")
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if starts else words
                for col, v in zip(out, (len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = _removed(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "substrings"))
    return marked.select("doc_id", "text", "starts").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def drop_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, text): ``docs`` with the removed words gone and the kept ones joined by one space.

    One row per row, as in ``substring_dedup``; a text that loses nothing, null
    and empty ones included, stays as it is.
    """

    def run(batches):
        for batch in slices(batches):
            texts = []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = blank_words(text) if starts else []
                texts.append(b" ".join(w for w, g in zip(words, covered(len(words), starts).tolist(), strict=True) if not g).decode() if starts else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    marked = _removed(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "substrings"))
    return marked.select("doc_id", "text", "starts").mapInArrow(run, "doc_id bigint, text string")
