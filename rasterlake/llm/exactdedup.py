"""Exact deduplication with a log-structured merge index of text digests.

Rows fall into a few memtables by a hash of their id. Each memtable is flushed as
a run: one entry per digest, sorted by it, with a filter (one bit per hashed
digest, in blocks). ``FAN_IN`` runs of a level are compacted into one of the next:
an entry that the filters of the other runs rule out moves on as it is, the others
are merged, and the best row of each digest stays. In the last run, every digest
that more than one row hit is verified on the bytes of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: The characters of [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
MEMTABLES, FAN_IN = 8, 4
#: Bits of a filter for each entry of its run, and of a block of it (what Spark's bitmap functions hold).
FILTER_BITS, BLOCK_BITS = 8, 32768
#: Digests that are sent to all tasks as 8-byte keys; beyond this the texts are joined by shuffle.
BROADCAST_DIGESTS = 1_000_000


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class DigestIndex:
    """A log of entries (memtable, sha, digest, doc_id, n_chars, copies) and levels of sorted runs in shared storage.

    A level is one table (run, digest, group_size, best) and its filters (run,
    block, bits). ``best`` orders rows: most code points, then the smallest id.
    """

    def __init__(self, spark: SparkSession, digest_bytes: int = 32, memtables: int = MEMTABLES, fan_in: int = FAN_IN):
        self.spark, self.digest_bytes, self.memtables, self.fan_in = spark, digest_bytes, memtables, fan_in
        self.scratch = Scratch(spark, "lsm")
        self.flushed = 0
        self.levels: list[tuple[DataFrame, DataFrame, int]] = []

    def digest(self, sha: Column) -> Column:
        return F.substring(sha, 1, self.digest_bytes)

    def flush(self, docs: DataFrame) -> None:
        """Add ``docs`` (doc_id, text) to the log, and a run of level 0 for each memtable.

        Equal (digest, id, length) entries are counted, not repeated.
        """
        text = F.coalesce("text", F.lit(""))
        sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
        entries = docs.select(sha.alias("sha"), "doc_id", F.length(text).alias("n_chars"))
        entries = entries.groupBy("sha", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("copies"))
        memtable = (F.pmod(F.xxhash64("doc_id"), F.lit(self.memtables)) + self.flushed * self.memtables).cast("int")
        self.scratch.save(entries.withColumn("digest", self.digest(F.col("sha"))).withColumn("memtable", memtable), f"log{self.flushed}")
        self.flushed += 1
        runs = self.merge(self.entries().withColumnRenamed("memtable", "run"), "run", "digest")
        self.levels = [self._level(runs, 0)]

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(*(self.scratch.path(f"log{k}") for k in range(self.flushed)))

    def merge(self, entries: DataFrame, *keys: str) -> DataFrame:
        """One row per key of log entries: the number of rows and the best one."""
        best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("inverse_id")))
        return entries.groupBy(*keys).agg(F.sum("copies").alias("group_size"), best.alias("best"))

    def _level(self, runs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
        """Write the runs, each sorted by digest, and their filters."""
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}
        runs = self.scratch.save(runs.sortWithinPartitions("run", "digest"), f"level{k}", **bloom)
        longest = runs.groupBy("run").count().agg(F.max("count")).first()[0] or 0
        blocks = -(-longest * FILTER_BITS // BLOCK_BITS) or 1
        marked = runs.select("run", *self._place(blocks))
        filters = marked.groupBy("run", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        return runs, self.scratch.save(filters, f"filter{k}"), blocks

    @staticmethod
    def _place(blocks: int) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64("digest"), F.lit(blocks * BLOCK_BITS))
        return F.floor(at / BLOCK_BITS).alias("block"), (at % BLOCK_BITS).alias("bit")

    @staticmethod
    def _set(bits: Column, bit: Column) -> Column:
        """Whether a bit of a filter's block is set."""
        byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (bit % 8).cast("int")) == 1

    def compact(self) -> DataFrame:
        """Merge level after level; the last run: (digest, group_size, best)."""
        while len(self.levels) < 64:
            runs, filters, blocks = self.levels[-1]
            top = runs.agg(F.max("run")).first()[0] or 0
            if not top:
                break
            target = lambda c: F.floor(F.col(c) / self.fan_in).cast("int")
            mine = filters.select(F.col("run").alias("own"), F.col("block").alias("own_block")).withColumn("to", target("own"))
            theirs = filters.withColumn("near", target("run"))
            # What the other runs of the same merge hold; a block of a run meets fan_in - 1 others.
            met = mine.join(theirs, (F.col("to") == F.col("near")) & (F.col("own_block") == F.col("block")) & (F.col("own") != F.col("run")))
            others = met.groupBy("own", "own_block").agg(F.bitmap_or_agg("bits").alias("bits"))
            placed = runs.select("*", *self._place(blocks))
            asked = placed.join(others, (F.col("run") == F.col("own")) & (F.col("block") == F.col("own_block")), "left")
            asked = asked.select(target("run").alias("run"), "digest", "group_size", "best", F.coalesce(self._set(F.col("bits"), F.col("bit")), F.lit(False)).alias("hit"))
            asked = self.scratch.save(asked, f"asked{len(self.levels)}")
            merged = asked.filter("hit").groupBy("run", "digest").agg(F.sum("group_size").alias("group_size"), F.max("best").alias("best"))
            moved = asked.filter(~F.col("hit")).select("run", "digest", "group_size", "best")
            self.levels.append(self._level(moved.unionByName(merged), len(self.levels)))
            self.scratch.drop(f"asked{len(self.levels) - 1}")
        return self.levels[-1][0].select("digest", "group_size", "best")

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Log entries of a few digests, from memtables whose filters may hold them; row groups are skipped by range and Bloom filter."""
        runs, filters, blocks = self.levels[0]
        wanted = self.spark.createDataFrame([(bytearray(x),) for x in digests], "digest binary").select("digest", *self._place(blocks))
        may = wanted.withColumnRenamed("block", "at").join(filters, F.col("at") == F.col("block")).filter(self._set(F.col("bits"), F.col("bit")))
        found = runs.filter(F.col("digest").isin([bytearray(x) for x in digests])).join(F.broadcast(may.select("run", F.col("digest").alias("d"))), ["run"]).filter("d = digest")
        hit = found.select(F.col("run").alias("memtable"), "digest").distinct()
        return self.entries().join(F.broadcast(hit), ["memtable", "digest"])


def colliding(docs: DataFrame, index: DigestIndex, shared: DataFrame, n_shared: int) -> DataFrame:
    """Digests under which the bytes of the normalised texts differ.

    Only texts with a shared digest are compared; each task reduces a digest
    to its smallest and greatest text first, so that a hot digest is no hot task.
    """
    norm = normalised(F.col("text"))
    texts = docs.select(norm.alias("norm")).withColumn("digest", index.digest(F.unhex(F.sha2("norm", 256))))
    if n_shared <= BROADCAST_DIGESTS:
        keys = F.broadcast(shared.select(F.xxhash64("digest").alias("k")).distinct())
        texts = texts.withColumn("k", F.xxhash64("digest")).join(keys, "k", "left_semi")
    texts = texts.join(F.broadcast(shared.select("digest")) if n_shared <= BROADCAST_DIGESTS // 10 else shared.select("digest"), "digest", "left_semi")
    ends = texts.groupBy("digest").agg(F.min("norm").alias("first"), F.max("norm").alias("last"))
    return ends.filter("first <> last").select("digest")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs`` (doc_id, text, ...).

    * Texts are equal when their bytes are, after deleting blanks; null counts as empty, all empty texts are one group.
    * The row with the most code points stays, then the smallest doc_id; null ids come last.
    * Of fully repeated rows (same id, same length) exactly one is kept.
    * An empty table gives an empty result; other columns are not read; texts may
      be of any length.
    * ``digest_bytes`` below 32 makes digests collide; verification then splits
      the group by the texts themselves.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    index = DigestIndex(spark, digest_bytes)
    index.flush(docs)
    entries = index.entries()
    shared = index.compact().filter("group_size > 1")
    bad = index.scratch.save(colliding(docs, index, shared, shared.count()), "colliding")
    if bad.isEmpty():
        keyed, groups = entries.withColumn("key", F.col("digest")), shared.withColumnRenamed("digest", "key")
    else:
        text = F.coalesce("text", F.lit(""))
        norm = docs.select("doc_id", F.length(text).alias("n_chars"), normalised(F.col("text")).alias("norm"))
        norm = norm.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", index.digest(F.col("sha")))
        split = norm.join(bad, "digest", "left_semi").groupBy("sha", "doc_id", "n_chars", "norm").agg(F.count(F.lit(1)).alias("copies"))
        split = split.withColumn("key", F.concat(F.lit(b"text:"), F.encode("norm", "UTF-8")))
        plain = entries.join(bad, "digest", "left_anti").withColumn("key", F.concat(F.lit(b"hash:"), F.col("digest")))
        columns = ["key", "sha", "doc_id", "n_chars", "copies"]
        keyed = index.scratch.save(plain.select(columns).unionByName(split.select(columns)), "split")
        groups = index.merge(keyed, "key").filter("group_size > 1")
    rows = keyed.join(groups, "key", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.bitwise_not("best.inverse_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.bitwise_not("best.inverse_id")) & (F.col("n_chars") == F.col("best.n_chars")))).alias("stays"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
    )
    return rows.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")
