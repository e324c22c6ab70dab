"""Hierarchical language identification.

A text's language family is predicted first (one-versus-rest over families);
then one-versus-one linear support vector machines tell the languages of that
family apart. Features are hashed 1- to 3-byte sequences of the whole text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices
from .linear import fit_logistic, fit_svm, sigmoid

#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
MAX_TRAIN_ROWS = 4000
UNDETERMINED = "und"
HELD_OUT = 2
_BIGRAMS, _TRIGRAMS = 2048, 4096
N_FEATURES = 256 + _BIGRAMS + _TRIGRAMS
#: A letter (Unicode categories L*) for Spark's expressions.
LETTERS = r"\p{L}"
SLICE_ROWS = 500


def has_letter(text: str | None) -> bool:
    """Whether a character is of the Unicode categories L*: numerals such as a Roman one or a fraction are not."""
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """Square roots of sequence frequencies, so that each length of sequence has norm 1."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    out = np.zeros(N_FEATURES, np.float32)
    at = 0
    for n, size in ((1, 256), (2, _BIGRAMS), (3, _TRIGRAMS)):
        if len(b) >= n:
            code = b if n == 1 else b[:-1] << 8 | b[1:] if n == 2 else (b[:-2] << 16 | b[1:-1] << 8 | b[2:])
            if n > 1:
                code = (code * np.uint32(2654435761)) >> np.uint32(32 - size.bit_length() + 1)
            out[at : at + size] = np.sqrt(np.bincount(code, minlength=size) / len(code))
        at += size
    return out


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == HELD_OUT


def training_sample(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, list[str]]:
    """Features and languages of labelled rows: about ``max_rows``, equally many of each language, and of every language one at least.

    Rows are taken by a hash of their id up to the share that their language's
    count allows, and the least hash of each language always; ties are bounded by
    twice a language's rows.
    """
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40)) / float(1 << 40)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", draw.alias("draw"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("text").rlike(LETTERS), F.col("draw"))).alias("least")).collect()
    if not counts:
        return np.zeros((0, N_FEATURES), np.float32), []
    each = max(1, max_rows // len(counts))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], each / r["n"], r["least"]) for r in counts], "lang string, share double, least double")
    drawn = labelled.join(F.broadcast(bounds), "lang").filter(((F.col("draw") < F.col("share")) | (F.col("draw") == F.col("least"))) & F.col("text").rlike(LETTERS))
    order = Window.partitionBy("lang").orderBy("draw", "text")
    taken = drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2 * each).select("lang", "text")

    def run(batches):
        for batch in slices(batches):
            rows = [(lang, features(t).astype(np.float16).tobytes()) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in taken.mapInArrow(run, "lang string, x binary").collect())
    x = np.array([np.frombuffer(b, np.float16) for _, b in rows], np.float32).reshape(len(rows), N_FEATURES)
    return x, [lang for lang, _ in rows]


class LanguageModel:
    """Families, then languages. ``family_of`` gives the family of a language; one without is its own."""

    def __init__(self, x: np.ndarray, langs: list[str], family_of: dict[str, str] = FAMILY_OF):
        names = np.array([family_of.get(lang, lang) for lang in langs], object)
        langs = np.array(langs, object)
        self.families = sorted(set(names))
        self.members = {f: sorted(set(langs[names == f])) for f in self.families}
        one = len(self.families) == 1
        self.family_w = np.array([np.zeros(N_FEATURES + 1) if one else fit_logistic(x, (names == f).astype(np.float32), 1e-5, 120) for f in self.families], np.float32)
        self.pairs = [(a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        self.pair_w = []
        for a, b in self.pairs:
            both = (langs == a) | (langs == b)
            self.pair_w.append(fit_svm(x[both], (langs[both] == a).astype(np.float32), 1e-5))
        self.pair_w = np.array(self.pair_w, np.float32).reshape(len(self.pairs), N_FEATURES + 1)

    def predict(self, x: np.ndarray) -> list[tuple[str, str, float]]:
        """(language, family, score) of each row: the family's chance times the mean chance of the language's duels."""
        if not self.families:
            return [(UNDETERMINED, UNDETERMINED, 0.0)] * len(x)
        families = sigmoid(x @ self.family_w[:, :-1].T + self.family_w[:, -1])
        families = families / families.sum(1, keepdims=True)
        duels = sigmoid(4 * (x @ self.pair_w[:, :-1].T + self.pair_w[:, -1])) if self.pairs else np.zeros((len(x), 0))
        out = []
        for p, d in zip(families, duels, strict=True):
            family = self.families[int(p.argmax())]
            members = self.members[family]
            won, chance = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
            for (a, b), v in zip(self.pairs, d, strict=True):
                if a in won:
                    won[a if v >= 0.5 else b] += 1
                    chance[a] += v
                    chance[b] += 1 - v
            best = max(members, key=lambda m: (won[m], chance[m]))  # of equals the first by name
            inner = chance[best] / (len(members) - 1) if len(members) > 1 else 1.0
            out.append((best, family, float(min(1.0, max(0.0, p.max() * inner)))))
        return out


def identify(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, family: one row per row of ``docs`` (doc_id, text, lang).

    * Null text, empty text and text without a letter: ``und`` with score 0; so
      is every text if there is nothing to learn from.
    * A null doc_id counts as the empty string for ``held_out``.
    * Letters are characters of the Unicode categories L*.
    * Whole texts of any length are used; repeated rows get equal predictions;
      of two languages that tie the first by name is taken; an empty table gives
      an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(LanguageModel(*training_sample(docs, max_train_rows)))

    def run(batches):
        for rows in slices(batches, rows=SLICE_ROWS):
            texts = rows.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            out = [(UNDETERMINED, UNDETERMINED, 0.0)] * len(texts)
            if known:
                for i, y in zip(known, model.value.predict(np.array([features(texts[i]) for i in known])), strict=True):
                    out[i] = y
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array([y[0] for y in out], pa.string()), pa.array([y[2] for y in out], pa.float64()), pa.array([y[1] for y in out], pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "family"],
            )

    seen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return seen.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, family string")
