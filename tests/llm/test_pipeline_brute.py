"""The pipeline's stages, each on its own input, against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_exact_and_near import shingles
from test_mix_chat_tokens import brute_targets
from test_models_and_pipeline import brute_posteriors

import corpus_pipeline
from rasterlake.llm import quality, queries
from rasterlake.llm.words import alnum_words, blank_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output rows) of every stage."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = queries.table(spark, SF, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        after = spark.read.parquet(str(folder / str(k)))
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_quality_stage(spark, stages):
    """What the texts say is the model's; what sites make of it, and who goes, is worked out by hand."""
    before, after = stages[0]
    docs = queries.table(spark, SF, "documents")
    said = {r.doc_id: r.doc_good for r in quality.evidence(docs, queries.table(spark, SF, "labels")).collect()}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in before]
    want = [r[0] for r in brute_posteriors(rows, [said[r.doc_id] for r in before]) if r[3] >= quality.THRESHOLD - 1e-9]
    assert sorted(r.doc_id for r in after) == sorted(want) and 0 < len(want) < len(before)


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    sets, parent = {r.doc_id: shingles(r.text, 5) for r in before}, {r.doc_id: r.doc_id for r in before}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after) == sorted(i for i in sets if root(i) == i)
    assert len(after) < len(before)


def test_decontamination_stage(spark, stages):
    before, after = stages[2]
    windows = {}
    for r in queries.table(spark, SF, "benchmark").collect():
        words = alnum_words(r.text)
        k = min(10, len(words))
        for i in range(len(words) - k + 1) if k else ():
            windows.setdefault(k, set()).add(tuple(words[i : i + k]))

    def leaks(text):
        words = alnum_words(text)
        return any(tuple(words[i : i + k]) in some for k, some in windows.items() for i in range(len(words) - k + 1))

    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not leaks(r.text))
    assert len(after) < len(before)


def test_mixing_stage(stages):
    before, after = stages[3]
    size, sizes, taken, copies = {}, Counter(), Counter(), Counter(r.doc_id for r in after)
    for r in before:
        size[r.doc_id] = len(blank_words(r.text))
        sizes[r.source] += size[r.doc_id]
    largest = Counter()
    for r in before:
        assert copies[r.doc_id] <= 3
        taken[r.source] += copies[r.doc_id] * size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= largest[source]
    by_id = {r.doc_id: r for r in before}
    assert all(by_id[r.doc_id] == r for r in after)


def test_token_stage(stages):
    import zlib

    from tokenizers import Tokenizer

    before, after = stages[4]
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    at, want = 0, []
    for r in sorted(before, key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after) == sorted(want)


def test_run_is_the_stages_in_order(spark, stages):
    """Reruns agree, also with what each stage leaves behind deleted."""
    got = corpus_pipeline.run(spark, SF).select(F.sum("n_tokens"), F.count(F.lit(1)), F.sum("ids_crc32")).first()
    last = stages[-1][1]
    assert tuple(got) == (sum(r.n_tokens for r in last), len(last), sum(r.ids_crc32 for r in last))
