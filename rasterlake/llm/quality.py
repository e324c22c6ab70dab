"""Quality classifier: document evidence and hierarchical empirical Bayes over sites.

Two logistic models, fitted on a bounded sample of labelled documents, give each
document the chance that it is good (quality 1 and not toxic). Sites are hosts
(``source``) and paths in them (``source``, ``lang``): grouped sums over all
documents give each host a posterior that is shrunk to the global rate, and
each path one that is shrunk to its host's, with prior strengths estimated from
the spread between sites. A document's log-odds are moved by its path's.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .linear import fit_logistic, sigmoid
from .scratch import Scratch, small_side
from .words import alnum_words, blank_words

MAX_TRAIN_ROWS = 8000
MAX_WORDS = 800
WORD_BUCKETS = 1 << 18
THRESHOLD = 0.5
#: Sites whose posteriors are sent to all tasks; beyond this they are joined by shuffle.
BROADCAST_SITES = 100_000
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6


def style(text: str) -> list[float]:
    """Shares of character classes, repetition and lengths of the whole text."""
    raw, words = text.encode(), blank_words(text)
    n, k = max(1, len(raw)), max(1, len(words))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    lines = text.split("\n")
    return [
        float(seen[65:91].sum()), float(seen[97:123].sum()), float(seen[48:58].sum()), float(seen[128:].sum()), float(seen[33]), float(seen[124]),
        float(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()), float(seen[10]),
        len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        np.log1p(len(words)), len(raw) / k / 10, len(set(lines)) / len(lines), float(seen[37] + seen[35] + seen[42] + seen[36]),
    ]


def buckets(text: str) -> set[int]:
    return {zlib.crc32(w) & (WORD_BUCKETS - 1) for w in set(alnum_words(text))}


class QualityModel:
    """Chances of low quality and of toxicity from style and the presence of telling words."""

    def __init__(self, rows: list[tuple[int, int, list[float], np.ndarray]]):
        low = np.array([not r[0] for r in rows], float)
        toxic = np.array([bool(r[1]) for r in rows], float)
        dense = np.array([r[2] for r in rows], float).reshape(len(rows), -1)
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        dense = np.clip((dense - self.mean) / self.scale, -8, 8)
        self.heads = []
        for y in (low, toxic):
            words = self._telling(rows, y)
            place = {b: j for j, b in enumerate(words)}
            x = np.zeros((len(rows), len(words)), np.float32)
            for i, r in enumerate(rows):
                x[i, [place[b] for b in r[3].tolist() if b in place]] = 1
            self.heads.append((place, fit_logistic(np.hstack([dense.astype(np.float32), x]), y.astype(np.float32), 1e-4)))

    @staticmethod
    def _telling(rows, y: np.ndarray) -> list[int]:
        """Buckets whose presence goes with y, by the z-score of the difference of shares."""
        n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for r, v in zip(rows, y, strict=True):
            seen[int(v)].update(r[3].tolist())
        z = {}
        for b, c in seen[1].items():
            p1, p0 = c / n1, seen[0][b] / n0
            p = (c + seen[0][b]) / (n1 + n0)
            z[b] = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        return sorted((b for b in z if z[b] > 4 and seen[1][b] >= 3), key=lambda b: (-z[b], b))[:MAX_WORDS]

    def good(self, texts: list[str]) -> np.ndarray:
        """The chance that each text is good; the words of one text at a time are held."""
        dense = np.clip((np.array([style(t) for t in texts]) - self.mean) / self.scale, -8, 8)
        k = dense.shape[1]
        z = np.stack([dense @ w[:k] + w[-1] for _, w in self.heads])
        for i, t in enumerate(texts):
            found = buckets(t)
            for h, (place, w) in enumerate(self.heads):
                z[h, i] += sum(w[k + place[b]] for b in sorted(found & place.keys()))
        return np.prod(1 - sigmoid(z), 0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> QualityModel | None:
    """A model from about ``max_rows`` labelled rows at most, equally many of each (quality, toxic); None without labels.

    Rows are taken by a hash of their id up to the share that their group's count allows.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")).filter("doc_id is not null and quality is not null")
    counts = marked.groupBy("quality", "toxic").count().collect()
    if not counts:
        return None
    each = max_rows // len(counts)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(v) for r in counts for v in (f"{r.quality}/{r.toxic}", min(1.0, each / r["count"]))))
    taken = marked.filter(draw < share[F.concat("quality", F.lit("/"), "toxic")]).dropDuplicates(["doc_id"]).limit(2 * max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("doc_id", "quality", "toxic", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for batch in slices(batches):
            t = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), batch.column("toxic"), pa.array([style(x) for x in t], pa.list_(pa.float64())), pa.array([np.array(sorted(buckets(x)), "<u4").tobytes() for x in t], pa.binary())],
                names=["doc_id", "quality", "toxic", "style", "buckets"],
            )

    got = texts.mapInArrow(run, "doc_id bigint, quality int, toxic int, style array<double>, buckets binary").limit(4 * max_rows).collect()
    rows = sorted(((r.doc_id, r.quality, r.toxic, list(r.style), bytes(r.buckets)) for r in got))
    return QualityModel([(q, t, s, np.frombuffer(b, "<u4")) for _, q, t, s, b in rows]) if rows else None


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def posterior(good, n, strength: float, prior: Column) -> Column:
    """The rate of a site with ``good`` of ``n``, shrunk to ``prior``, which counts as ``strength`` documents."""
    good, n = (F.col(c) if isinstance(c, str) else c for c in (good, n))
    return (good + strength * prior) / (n + strength)


def _strength(sites: DataFrame, parent: Column) -> float:
    """How many documents the prior counts for: rate spread between sites against that of documents within one.

    Method of moments for beta-distributed site rates: with v the
    weighted mean square of (rate - parent) less its sampling part, it is
    m (1 - m) / v - 1.
    """
    rate = F.col("good") / F.col("n")
    r = sites.agg(
        F.sum(F.col("n") * (rate - parent) * (rate - parent)).alias("between"), F.sum(F.col("n")).alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("square") - F.col("n") * rate * rate).alias("within"), (F.sum("good") / F.sum("n")).alias("m"),
    ).first()
    if not r.n or r.k < 2 or r.n <= r.k:
        return MAX_STRENGTH
    v = (r.between - (r.k - 1) * r.within / (r.n - r.k)) / r.n
    return float(min(MAX_STRENGTH, max(MIN_STRENGTH, r.m * (1 - r.m) / v - 1))) if v > 1e-12 else MAX_STRENGTH


def evidence(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The columns of ``docs`` without text, and ``doc_good``: what the text alone says (0.5 without labels)."""
    spark = docs.sparkSession
    fitted = fit(docs, labels, max_train_rows)
    model = spark.sparkContext.broadcast(fitted)
    keys = docs.select("doc_id", "source", "lang", F.xxhash64("doc_id", "text", "source", "lang", F.col("doc_id").isNull()).alias("key"), "text")

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            p = np.full(len(texts), 0.5) if model.value is None else model.value.good(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "key")), pa.array(p, pa.float64())], names=["doc_id", "source", "lang", "key", "doc_good"])

    return keys.mapInArrow(run, "doc_id bigint, source string, lang string, key bigint, doc_good double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, doc_good, host_good, path_good, quality, kept, key: one row per row of ``docs``.

    * ``labels``: doc_id, quality (0/1), toxic (0/1, null: 0); null doc_id or
      quality is ignored, of repeated labels one counts. Without labels every
      document scores 0.5 and is kept.
    * Null text counts as empty; null source or lang is a site of its own; an
      empty table gives an empty result.
    * Equal texts on one path get equal scores. ``host_good`` and ``path_good``
      leave the document itself out: one alone on its path has its host's, one
      alone on its host the global rate.
    * Texts of any length are scored whole, one at a time where they are long;
      other columns are not read.

    Sums are partial per task, so a hot host costs one row per task and path.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    seen = scratch.save(evidence(docs, labels, max_train_rows), "evidence")
    sums = [F.sum("good").alias("good"), F.sum("square").alias("square"), F.sum("n").alias("n")]
    paths = seen.groupBy("source", "lang").agg(
        F.sum(F.round("doc_good", 6).cast("decimal(20,6)")).cast("double").alias("good"),
        F.sum(F.round(F.col("doc_good") * F.col("doc_good"), 6).cast("decimal(20,6)")).cast("double").alias("square"), F.count(F.lit(1)).alias("n"),
    )  # decimals: the order of the sums doesn't show
    paths = scratch.save(paths, "paths")
    hosts = paths.groupBy("source").agg(*sums)
    total = hosts.agg(*sums).first()
    base = float(total.good / total.n) if total.n else 0.5
    host_k = _strength(hosts, F.lit(base))
    hosts = hosts.select(F.col("source").alias("_s"), F.col("good").alias("host_sum"), F.col("n").alias("host_n"), posterior("good", "n", host_k, F.lit(base)).alias("host_rate"))
    hosts = scratch.save(hosts, "hosts")
    paths = paths.join(hosts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    path_k = _strength(paths, F.col("host_rate"))
    sites = scratch.save(paths.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), "host_sum", "host_n", F.col("good").alias("path_sum"), F.col("n").alias("path_n")), "sites")
    side = F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites
    joined = seen.join(side, seen["source"].eqNullSafe(F.col("_s")) & seen["lang"].eqNullSafe(F.col("_l")))
    own = F.round("doc_good", 6)
    joined = joined.withColumn("host_good", posterior(F.col("host_sum") - own, F.col("host_n") - 1, host_k, F.lit(base)))
    joined = joined.withColumn("path_good", posterior(F.col("path_sum") - own, F.col("path_n") - 1, path_k, F.col("host_good")))
    score = 1 / (1 + F.exp(-(_logit(F.col("doc_good")) + _logit(F.col("path_good")) - _logit(F.lit(base)))))
    scored = joined.withColumn("quality", score)
    return scored.select("doc_id", "doc_good", "host_good", "path_good", "quality", (F.col("quality") >= threshold - 1e-9).alias("kept"), "key")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs``, all its columns, without the rows that the classifier rejects.

    Rows equal in doc_id, text, source and lang stay or go together; null and
    empty texts are judged as empty; without labels all rows stay, and an empty
    table stays empty.
    """
    bad = quality_scores(docs, labels, **options).filter(~F.col("kept")).select(F.col("key").alias("__rejected")).distinct()
    bad = Scratch(docs.sparkSession, "rejected").save(bad, "keys")
    key = F.xxhash64(docs["doc_id"], docs["text"], docs["source"], docs["lang"], docs["doc_id"].isNull())
    return docs.join(small_side(bad), key == F.col("__rejected"), "left_anti")
