import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterlake.llm import langid, quality, queries, urlfilter

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = queries.table(spark, SF, "documents")
    got = queries.op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_edges(make):
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    kinds = {"en": "abcde", "de": "efghi", "fr": "klmno", "xx": "qrstu"}
    rows = [(i, text(kinds[k]), k) for i, k in enumerate([*kinds] * 30)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 ... !!", "fr"), (503, text("abcde") * 300, None), (None, text("qrstu"), None), (504, "é", "fr"), (504, "é", "fr")]
    got = langid.identify(make(rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == langid.UNDETERMINED and by[i].score == 0 for i in (500, 501, 502))
    assert by[503].lang_pred == "en" and by[None].lang_pred == "xx" and by[None].family == "xx"
    assert all(by[i].lang_pred == rows[i][2] for i in range(120))
    assert langid.identify(make([])).count() == 0
    assert langid.identify(make([(1, "text", None)])).first().lang_pred == langid.UNDETERMINED


def test_predictions_use_the_text_only(make):
    rows = [(i, ("aba " if i % 2 else "zyz ") * 20, "en" if i % 2 else "fr") for i in range(60)]
    changed = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else None, "s") for i, t, lang in rows]
    a, b = ({r.doc_id: r.lang_pred for r in langid.identify(make(x)).collect()} for x in (rows, changed))
    assert a == b


def test_quality_of_labelled_documents(spark):
    labels = queries.table(spark, SF, "labels")
    got = queries.op7_quality_classifier(spark, SF).join(labels, "doc_id").withColumnRenamed("quality", "q").collect()
    good = [r for r in got if r.toxic == 0 and r[labels.columns.index("quality") - len(labels.columns)] == 1]
    assert sum(r.kept for r in good) / len(good) > 0.97
    bad = [r for r in got if r.toxic == 1]
    assert sum(not r.kept for r in bad) / len(bad) > 0.8


def test_quality_edges(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(1, "a b", "en", "s"), (2, None, None, None), (None, "x", "en", "s"), (1, "a b", "en", "s")]
    out = quality.quality_scores(make(rows, clash=True), none).collect()
    assert len(out) == 4 and all(r.kept and r.doc_good == 0.5 for r in out)
    one = spark.createDataFrame([(1, 1, None), (1, 1, 0), (None, 0, 1), (2, None, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_scores(make(rows), one).filter("kept").count() == 4
    assert quality.quality_scores(make([]), one).count() == 0
    assert quality.keep_good(make(rows, clash=True), one).count() == 4


def brute_posteriors(rows, p):
    """Host and path posteriors of each row in plain Python, the row itself left out."""
    exact, p = p, [round(v, 6) for v in p]
    hosts, paths = {}, {}
    for (_, _, lang, source), v in zip(rows, p, strict=True):
        hosts.setdefault(source, []).append(v)
        paths.setdefault((source, lang), []).append(v)
    n, base = len(p), sum(p) / len(p)

    def strength(sites, parents):
        k = len(sites)
        if k < 2 or n <= k:
            return quality.MAX_STRENGTH
        between = sum(len(s) * (sum(s) / len(s) - m) ** 2 for s, m in zip(sites, parents, strict=True))
        within = sum(sum(round(v * v, 6) for v in s) - len(s) * (sum(s) / len(s)) ** 2 for s in sites)
        v = (between - (k - 1) * within / (n - k)) / n
        return min(quality.MAX_STRENGTH, max(quality.MIN_STRENGTH, base * (1 - base) / v - 1)) if v > 1e-12 else quality.MAX_STRENGTH

    host_k = strength(list(hosts.values()), [base] * len(hosts))
    rate = {h: (sum(s) + host_k * base) / (len(s) + host_k) for h, s in hosts.items()}
    path_k = strength(list(paths.values()), [rate[h] for h, _ in paths])
    out = []
    for (i, _, lang, source), v, own in zip(rows, p, exact, strict=True):
        h, s = hosts[source], paths[(source, lang)]
        host = (sum(h) - v + host_k * base) / (len(h) - 1 + host_k)
        path = (sum(s) - v + path_k * host) / (len(s) - 1 + path_k)
        odds = [math.log(x / (1 - x)) for x in (min(max(x, 1e-6), 1 - 1e-6) for x in (own, path, base))]
        out.append((i, host, path, 1 / (1 + math.exp(-(odds[0] + odds[1] - odds[2])))))
    return out


def test_posteriors_are_those_of_plain_python(make, monkeypatch):
    """Hot, sparse and single sites, null hosts and paths; a document doesn't confirm itself."""
    rng = random.Random(8)
    sites = [("h1", "en", 0.9, 200), ("h1", "fr", 0.3, 3), ("h2", "en", 0.2, 90), ("h2", None, 0.6, 20), (None, "en", 0.5, 7), (None, None, 0.8, 2), ("one", "de", 0.05, 1)]
    rows, p = [], []
    for source, lang, rate, n in sites:
        for _ in range(n):
            p.append(round(min(0.999, max(0.001, rng.gauss(rate, 0.1))), 4))
            rows.append((len(rows), str(p[-1]), lang, source))
    chance = F.col("text").cast("double").alias("doc_good")
    fake = lambda docs, labels, n: docs.select("doc_id", "source", "lang", F.xxhash64("doc_id", "text", "source", "lang", F.col("doc_id").isNull()).alias("key"), chance)
    monkeypatch.setattr(quality, "evidence", fake)
    got = sorted((r.doc_id, r.host_good, r.path_good, r.quality) for r in quality.quality_scores(make(rows), None).collect())
    want = brute_posteriors(rows, p)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [x for r in got for x in r[1:]] == pytest.approx([x for r in want for x in r[1:]], abs=1e-9)
    alone = got[-1]
    assert alone[2] == pytest.approx(alone[1]) and alone[1] == pytest.approx(sum(p) / len(p))


def test_scores_of_long_texts_and_ties(spark, make):
    """A text is scored alike whatever it is batched with; equal texts on one path tie."""
    words = [f"w{i}" for i in range(40_000)]
    rows = [(i, f"plain good text number {i % 3}" if i % 2 else "toxic junk junk !!", "en", "s") for i in range(200)]
    rows += [(900, " ".join(words), "en", "s"), (901, "plain good text number 1", "en", "s"), (901, "plain good text number 1", "en", "s"), (902, "", "en", "s"), (903, None, "en", "s")]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(150)], "doc_id bigint, quality int, toxic int")
    a = {r.doc_id: r for r in quality.quality_scores(make(rows, clash=True), labels).collect()}
    b = {r.doc_id: r for r in quality.quality_scores(make(rows).repartition(9), labels).collect()}
    assert {k: (r.doc_good, r.quality) for k, r in a.items()} == {k: (r.doc_good, r.quality) for k, r in b.items()}
    assert a[1].quality == a[901].quality and a[902].quality == a[903].quality and 0 <= a[900].quality <= 1


RULES = "host string, path string, verdict string"


def brute_urls(rows, rules):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = []
    for i, url in rows:
        rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c in upper else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=(0, 0, None, "allow"))
        out.append((i, host, path, best[2], best[3]))
    return sorted(map(str, out))


def test_urls(spark):
    rules = [*queries.URL_RULES, ("a.b", "", "block"), ("b", "/x", "allow"), ("b", "/x", "block"), ("", "/", "block"), ("é.org", "/É", "block")]
    urls = [
        "http://example.com/en/1", "HTTPS://WWW.Example.COM/en/?q", "x://m.www.example.com/en/", "http://notexample.com/en/", "http://net/es/", "http://a.net/fr", "http://a.net/fr/#", "no scheme", None, "",
        "http://", "http://com", "http://com/", "http://.com/", "http://com./", "http://a.b", "http://c.a.b/x", "http://c.a.b/xy?z", "http://u:p@h.com:80/", "://b/x", "a://b://com/", "http://b#/x", "http://é.org/Éa", "http://" + "q." * 3000 + "com/" + "p" * 9000,
    ]
    rows = [(k, u) for k, u in enumerate(urls)] + [(0, urls[0]), (None, urls[0]), (3, urls[1])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"rule": F.lit("x"), "digest": F.lit("y"), "_url": F.lit("z")})
    got = urlfilter.judge_urls(df, spark.createDataFrame(rules, RULES)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_urls(rows, rules)
    assert urlfilter.judge_urls(df, spark.createDataFrame([], RULES)).filter("verdict = 'allow'").count() == len(rows)
    assert urlfilter.judge_urls(df.limit(0), spark.createDataFrame(rules, RULES)).count() == 0


def test_stages_survive_odd_rows_and_columns(spark, make):
    rows = [(1, None), (2, ""), (None, "a b c"), (None, None), (3, "w " * 9000, None, None), (4, "some text of six words here", "en", "s"), (4, "some text of six words here", "en", "s"), (5, "A", "en", None)]
    docs = make(rows, clash=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= 3 * len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, tmp_path, empty):
    """Each stage keeps the columns of documents and takes out what it should."""
    docs = queries.table(spark, SF, "documents")
    docs = docs.limit(0) if empty else docs
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
        if k < 3 and not empty:
            assert 0 < docs.count() < before
    assert corpus_pipeline.ORACLE_SQL is None
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (docs.count() == 0) == empty
