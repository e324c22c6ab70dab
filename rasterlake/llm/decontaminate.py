"""Benchmark decontamination with a distributed positional inverted index.

Which terms occur how often is counted over all documents. Of each window of an
item (``WINDOW`` consecutive words) only the ``RAREST`` rarest places are looked
up: the corpus postings (term, document, position) of those terms are stored,
shifted by the term's place in the item, and lists that meet on the same
(document, item, shift) are intersected. What is left is compared word by word
on the documents themselves; proximity matches come from the same postings.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .scratch import Scratch, small_side
from .words import alnum_words as words_of

WINDOW = 10
RAREST = 3
#: Terms (and their bytes) that are sent to every task; beyond this they are joined by shuffle.
BROADCAST_TERMS = 500_000
BROADCAST_BYTES = 32 << 20
#: Words of an item in one row.
CHUNK_WORDS = 5000
COUNTED_TERMS = 300_000


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_ITEMS = pa.schema([("item", pa.int64()), ("item_id", pa.string()), ("words", pa.binary())])
_ITEM_TERMS = pa.schema([("item", pa.int64()), ("ipos", pa.int32()), ("term", pa.binary())])
_STATS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("term", pa.binary()), ("n", pa.int64())])
_POSTINGS = pa.schema([("term", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32())])
_HITS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "bigint", "int32": "int", "binary": "binary", "string": "string", "list<item: string>": "array<string>", "list<item: int32>": "array<int>"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def split_items(items: DataFrame) -> DataFrame:
    """(item, item_id, words): one row per distinct (item_id, text) that has words; ``words`` are joined by one space."""

    def run(batches):
        for part in slices(batches):
            words = [b" ".join(words_of(t)) for t in part.column("text").to_pylist()]
            made = _rows(_ITEMS, part.column("item").to_pylist(), part.column("item_id").to_pylist(), words)
            yield made.filter(pa.array([bool(w) for w in words], pa.bool_()))

    keyed = items.select(F.xxhash64("item_id", "text").alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return keyed.dropDuplicates(["item"]).mapInArrow(run, _ddl(_ITEMS))


def explode_items(items: DataFrame) -> DataFrame:
    """(item, ipos, term): a row per word of each of ``split_items``."""

    def run(batches):
        for part in slices(batches, "words"):
            for item, joined in zip(part.column("item").to_pylist(), part.column("words").to_pylist(), strict=True):
                words = joined.split(b" ")
                for at in range(0, len(words), CHUNK_WORDS):
                    some = words[at : at + CHUNK_WORDS]
                    yield _rows(_ITEM_TERMS, [item] * len(some), range(at, at + len(some)), some)

    return items.mapInArrow(run, _ddl(_ITEM_TERMS))


def places_of(words: list[bytes], counts: list[int], window: int, rarest: int) -> list[int]:
    """The places to look up, so that each window has its ``rarest`` rarest among them.

    A window whose words are those of an earlier one of the item needs none: it
    is found wherever the earlier one is.
    """
    size, seen, places = min(window, len(words)), set(), set()
    for a in range(len(words) - size + 1):
        run = tuple(words[a : a + size])
        if run not in seen:
            seen.add(run)
            places.update(sorted(range(a, a + size), key=lambda i: (counts[i], i))[:rarest])
    return sorted(places)


def rarest_places(item_terms: DataFrame, frequency: DataFrame, window: int, rarest: int) -> DataFrame:
    """(item, ipos, term, need): the places to look up; an item's words meet in one row."""
    ranked = item_terms.select("item", "ipos", "term").join(frequency, "term", "left").select("item", F.struct("ipos", "term", F.coalesce("n", F.lit(0)).alias("n")).alias("w"))
    lists = ranked.groupBy("item").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    lists = lists.select("item", F.col("ws.term").alias("terms"), F.col("ws.n").alias("counts"))

    def run(batches):
        for batch in batches:
            for item, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("item", "terms", "counts")), strict=True):
                at = places_of(terms, counts, window, rarest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([terms[i] for i in at], pa.binary()), pa.array([min(rarest, window, len(terms))] * len(at), pa.int32())],
                    names=["item", "ipos", "term", "need"],
                )

    return lists.mapInArrow(run, "item bigint, ipos int, term binary, need int")


class PositionalIndex:
    """Postings of the rarest benchmark terms over all of ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST):
        self.spark, self.window = docs.sparkSession, window
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
        self.scratch = Scratch(self.spark, "decontaminate")
        self.sent = []
        self.items = self.scratch.save(split_items(items), "items")
        self.item_terms = self.scratch.save(explode_items(self.items), "item_terms")
        terms = self.item_terms.select("term").distinct()
        stats = self.scratch.save(self._count(terms), "stats")
        self.lengths = stats.filter("n_words is not null").select("doc_id", "th", "n_words")
        frequency = stats.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
        self.places = self.scratch.save(rarest_places(self.item_terms, frequency, window, rarest), "places")
        self.postings = self.scratch.save(self._post(self.places.select("term").distinct()), "postings")
        for sent in self.sent:
            sent.unpersist()

    def _wanted(self, terms: DataFrame):
        """The terms as a set for every task where there are few of them, else None."""
        n, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
        if n > BROADCAST_TERMS or size > BROADCAST_BYTES:
            return None
        self.sent.append(self.spark.sparkContext.broadcast(frozenset(bytes(r.term) for r in terms.toLocalIterator())))
        return self.sent[-1]

    def _count(self, terms: DataFrame) -> DataFrame:
        wanted = self._wanted(terms)

        def run(batches):
            total, keep = Counter(), wanted and wanted.value
            for batch in slices(batches):
                lengths = []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    lengths.append(len(words))
                    total.update(words if keep is None else filter(keep.__contains__, words))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(lengths, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=_STATS)
                if len(total) > COUNTED_TERMS:
                    yield _rows(_STATS, *[[None] * len(total)] * 3, list(total), list(total.values()))
                    total = Counter()
            yield _rows(_STATS, *[[None] * len(total)] * 3, list(total), list(total.values()))

        counted = self.docs.mapInArrow(run, _ddl(_STATS))
        return counted if wanted else counted.join(terms, "term", "left_semi").unionByName(counted.filter("term is null"))

    def _post(self, terms: DataFrame) -> DataFrame:
        wanted = self._wanted(terms)

        def run(batches):
            keep = wanted and wanted.value
            for part in slices(batches):
                out = [[], [], [], []]
                for doc_id, th, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                    words = words_of(text)
                    if keep is not None and keep.isdisjoint(words):
                        continue
                    for i, w in enumerate(words):
                        if keep is None or w in keep:
                            out[0].append(w)
                            out[1].append(doc_id)
                            out[2].append(th)
                            out[3].append(i)
                yield _rows(_POSTINGS, *out)

        posted = self.docs.mapInArrow(run, _ddl(_POSTINGS))
        return posted if wanted else posted.join(terms, "term", "left_semi")

    def shifted(self) -> DataFrame:
        """(doc_id, th, item, ipos, pos, shift, need): postings shifted by their place in each item."""
        return self.postings.join(self.places, "term").select("doc_id", "th", "item", "ipos", "pos", "need", (F.col("pos") - F.col("ipos")).alias("shift"))

    def candidates(self) -> DataFrame:
        """(doc_id, th, item, shift) where the lists of the rarest places meet."""
        met = self.shifted().groupBy("doc_id", "th", "item", "shift").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
        return met.filter("n >= need").select("doc_id", "th", "item", "shift")

    def proximity(self, slop: int) -> DataFrame:
        """(doc_id, th, item_id): the rarest places of an item within ``slop`` words of their shifts, in any order of gaps.

        Shifts are cut twice into overlapping spans of 2 * slop, so any two that
        differ by at most slop share one.
        """
        span = 2 * slop
        spans = F.explode(F.array(F.floor(F.col("shift") / span) * 2, F.floor((F.col("shift") + slop) / span) * 2 + 1)).alias("span")
        near = self.shifted().select("doc_id", "th", "item", "ipos", "need", spans)
        near = near.groupBy("doc_id", "th", "item", "span").agg(F.count_distinct("ipos").alias("n"), F.max("need").alias("need")).filter("n >= need")
        names = self.items.select("item", "item_id")
        return near.select("doc_id", "th", "item").distinct().join(names, "item").select("doc_id", "th", "item_id")

    def phrases(self) -> DataFrame:
        """(doc_id, th, n_hit, items, starts, ends): exact matches, with word spans, of documents that have any.

        A document's text comes first, then its items, one row each; a task
        holds one document and one item at a time.
        """
        shifts = self.candidates().groupBy("doc_id", "th", "item").agg(F.collect_list("shift").alias("shifts"))
        found = self.scratch.save(shifts, "candidates")
        places = found.join(self.items, "item").select("doc_id", "th", "item_id", F.lit(None).cast("string").alias("text"), "words", "shifts")
        keys = found.select(F.xxhash64("doc_id", "th").alias("k")).distinct()
        texts = self.docs.withColumn("k", F.xxhash64("doc_id", "th")).join(small_side(keys), "k", "left_semi").dropDuplicates(["doc_id", "th"])
        texts = texts.select("doc_id", "th", F.lit(None).cast("string").alias("item_id"), "text", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("array<int>").alias("shifts"))
        ordered = texts.unionByName(places).repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", F.col("text").isNull(), "item_id")
        window = self.window

        def run(batches):
            key = doc = None
            for part in slices(batches, "words"):
                out = []
                for doc_id, th, item_id, text, words, at in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "item_id", "text", "words", "shifts")), strict=True):
                    if key != (doc_id, th):
                        out += doc.row(*key) if doc else []
                        key, doc = (doc_id, th), None
                    if text is not None:
                        doc = Matches(words_of(text), window)
                    elif doc:
                        doc.add(item_id, words.split(b" "), at)
                yield _rows(_HITS, *(zip(*out, strict=True) if out else [[]] * len(_HITS)))
            last = doc.row(*key) if doc else []
            yield _rows(_HITS, *(zip(*last, strict=True) if last else [[]] * len(_HITS)))

        return ordered.mapInArrow(run, _ddl(_HITS))


class Matches:
    """Which words of one document lie in windows of items."""

    def __init__(self, words: list[bytes], window: int):
        self.window, self.code = window, {}
        self.words = np.array([self.code.setdefault(w, len(self.code)) for w in words], np.int32)
        self.hit, self.items = np.zeros(len(words) + 1, bool), set()

    def add(self, item_id: str, item: list[bytes], shifts: list[int]) -> None:
        """Compare an item's words, laid over the document at each of the shifts."""
        codes, size = np.array([self.code.get(w, -1) for w in item], np.int32), min(self.window, len(item))
        for shift in shifts:
            low, high = max(0, -shift), min(len(item), len(self.words) - shift)
            if high - low < size:
                continue
            same = np.zeros(high - low + 2, bool)
            same[1:-1] = codes[low:high] == self.words[shift + low : shift + high]
            for a, b in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
                if b - a >= size:
                    self.hit[shift + low + a : shift + low + b] = True
                    self.items.add(item_id)

    def row(self, doc_id: int | None, th: int) -> list[tuple]:
        """The document's row of ``PositionalIndex.phrases``, or none."""
        starts, ends = np.flatnonzero(np.diff(np.concatenate([[False], self.hit]).astype(np.int8))).reshape(-1, 2).T.tolist()
        return [(doc_id, th, sum(ends) - sum(starts), sorted(self.items), starts, ends)] if starts else []


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs`` (doc_id, text).

    * Null and empty texts have no words; items without words match nothing; an
      empty benchmark hits nothing; an empty corpus gives an empty result.
    * An item shorter than ``window`` is one window; repeated items count once,
      a null item_id as the empty string.
    * Rows that repeat (doc_id, text) are judged alike; other columns are not read.
    * Texts and items may be of any length: a task holds one document and one
      item at a time.
    """
    index = PositionalIndex(docs, items, window)
    hits = index.scratch.save(index.phrases(), "hits")
    index.scratch.drop("item_terms", "places", "postings", "candidates")
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "n_hit", "items")
    rows = index.lengths.join(hits, index.lengths["doc_id"].eqNullSafe(F.col("_d")) & index.lengths["th"].eqNullSafe(F.col("_t")), "left")
    names = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "th",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all its columns, without the rows that hold a window of an item.

    Rows without words and rows of an empty corpus or benchmark stay as they
    are; rows that repeat (doc_id, text) stay or go together; rows that share a
    doc_id only are judged each by its text.
    """
    index = PositionalIndex(docs, items, window)
    hits = index.scratch.save(index.phrases().select(F.col("doc_id").alias("__leak_id"), F.col("th").alias("__leak_hash")), "hits")
    index.scratch.drop("item_terms", "places", "postings", "candidates", "stats")
    same = docs["doc_id"].eqNullSafe(F.col("__leak_id")) & (F.xxhash64(docs["text"]) == F.col("__leak_hash"))
    return docs.join(small_side(hits), same, "left_anti")
