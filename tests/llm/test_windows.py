import hashlib
import random
import re

import pytest

from rasterlake.llm import decontaminate, substrings
from rasterlake.llm.words import alnum_words, blank_words


def test_words_follow_the_byte_classes():
    text = "Héllo, WORLD_9 a\x0bb\x1cc É\xa0x ½-ß"
    lower = "".join(c.lower() if c < "\x80" else c for c in text)
    assert [w.decode() for w in alnum_words(text)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    assert [w.decode() for w in blank_words(text)] == re.findall("[^\x20\x09-\x0d]+", text)


def brute_leaks(rows, items, window=10):
    out = []
    for i, text in rows:
        words, hit, found = alnum_words(text), set(), set()
        for item_id, t in items:
            item = alnum_words(t)
            k = min(window, len(item))
            for a in range(len(item) - k + 1) if k else ():
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == item[a : a + k]:
                        hit.update(range(p, p + k))
                        found.add("" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(map(str, out))


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_leaks(spark, make, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", broadcast)
    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "Éé", "zz9"]) + rng.choice("abcdefghij")
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 30])))) for i in range(12)]
    items += [(3, items[3][1]), (20, ""), (21, None), (22, "the"), (23, "the " * 15), (None, "only null " * 6)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            leak = alnum_words(items[i % 12][1])
            cut = leak[rng.randrange(3) :]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.decode().upper() if i % 2 else w.decode() for w in cut]
        rows.append((i, ", ".join(words)))
    rows += [(100, None), (101, ""), (102, "The the THE"), (103, "the " * 3000), (104, "only null " * 8), (0, rows[0][1]), (None, rows[3][1]), (105, rows[3][1] + " x" * 20_000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(make(rows, clash=True), bench).drop("th").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_leaks(rows, items)


def test_leaks_of_empty_tables(spark, make):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.contamination(make([(1, "a b")]), bench).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    assert decontaminate.contamination(make([]), bench).count() == 0


def test_leaks_of_long_and_many_items(spark, make):
    """An item of 20,000 words, 10,000 items of 200 words, a word repeated 20,000 times, a document of 100,000 places."""
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n))
    long, most = text(20_000), [text(200) for _ in range(10_000)]
    items = [(-1, long), (-2, "the " * 20_000), (-3, "of the"), *enumerate(most)]
    cut = long.split()[7_000:7_030]
    rows = [(1, "x " + " ".join(cut) + " y"), (2, most[77] + " z"), (3, "the " * 9), (4, "the " * 50_000 + "of the " * 50_000), (5, "clean words only")]
    got = {r.doc_id: r for r in decontaminate.contamination(make(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    digest = lambda *ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert (got[1].n_hit, got[1].items_sha256) == (30, digest("-1"))
    assert (got[2].n_hit, got[2].items_sha256) == (200, digest("77"))
    assert got[3].n_hit == 0 and got[5].n_hit == 0
    assert (got[4].n_words, got[4].n_hit, got[4].items_sha256) == (150_000, 150_000, digest("-2", "-3"))


def test_repeated_windows_are_looked_up_once():
    assert decontaminate.places_of([b"the"] * 500, [9] * 500, 10, 3) == [0, 1, 2]
    assert decontaminate.places_of([b"a", b"b"], [5, 1], 10, 3) == [0, 1]


def test_dropping_and_proximity(spark, make):
    item = "quick brown foxes jump over lazy sleeping dogs near rivers today"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    loose = item.replace("jump", "then jump high").replace("near", "very near")
    docs = make([(1, "x " + item + " y"), (2, loose), (3, "nothing here at all")])
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3]
    index = decontaminate.PositionalIndex(docs, bench)
    assert sorted(r.doc_id for r in index.proximity(4).collect()) == [1, 2]


def brute_repeats(rows, window=20):
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, gone = set(), {}
    for has, i, t in order:
        words, mask = blank_words(t), set()
        for p in range(len(words) - window + 1):
            g = tuple(words[p : p + window])
            if g in seen:
                mask.update(range(p, p + window))
            seen.add(g)
        gone[(has, i, t)] = mask
    out = []
    for i, t in rows:
        words, mask = blank_words(t), gone[(i is not None, i or 0, t or "")]
        kept = b" ".join(w for k, w in enumerate(words) if k not in mask)
        out.append((i, len(words), len(mask), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def repeating(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=3))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 55)]
    rows = []
    for i in range(50):
        words = [word() for _ in range(rng.randrange(80))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(60, "the " * 30), (61, "The the " * 40), (62, "a b c d e f g " * 12), (63, None), (64, ""), (65, rows[3][1]), (3, rows[3][1]), (None, rows[7][1]), (66, "w " * 30_000)]


@pytest.mark.parametrize(("chunk", "block", "hot"), [(1_000_000, 1_000_000, 5_000), (40, 3, 5_000), (25, 7, 2), (1, 1, 1)])
def test_repeats(make, monkeypatch, chunk, block, hot):
    """Also with many small blocks and chunks, and with every repeated gram hot."""
    monkeypatch.setattr(substrings, "CHUNK_GRAMS", chunk)
    monkeypatch.setattr(substrings, "BLOCK_GRAMS", block)
    monkeypatch.setattr(substrings, "HOT_GRAM", hot)
    monkeypatch.setattr(substrings, "FLUSH_WINDOWS", 10 * chunk)
    rows = repeating()
    got = substrings.substring_dedup(make(rows, clash=True)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(rows)


def test_flushes_keep_every_repeat(make, monkeypatch):
    """Also where a task gives out what it holds many times."""
    rows = repeating(9)
    docs = make(rows).coalesce(1)
    batch = substrings.Batch(substrings.WordHashes(), [t for _, t in rows])
    grams, counts = batch.counted()
    assert len(grams) == counts.sum() < len(batch.x)
    got = substrings.substring_dedup(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(rows)


def test_counters_never_fall_short():
    """Every key with a count of two is marked, few others are."""
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 31, 20_000).astype(np.uint32)
    keys[:4000] = keys[4000:8000]
    counts = np.ones(len(keys), np.uint32)
    counts[10_000:10_100] = 3
    marked = substrings.repeated(keys, counts, 16)
    assert marked[:8000].all() and marked[10_000:10_100].all()
    assert marked[10_100:].mean() < 0.2


def test_repeats_of_empty_table_and_texts(make):
    assert substrings.substring_dedup(make([])).count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    kept = {r.doc_id: r.text for r in substrings.drop_substrings(make([(1, long), (2, "x " + long + " y"), (3, None)])).collect()}
    assert kept == {1: long, 2: "x y", 3: None}
