import hashlib
import random
import re

import pytest

from rasterlake.llm import components, exactdedup, minhash


def brute_exact(rows):
    keys = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out, used = [], set()
    for (i, t), k in zip(rows, keys, strict=True):
        group = [(j, u or "") for (j, u), q in zip(rows, keys, strict=True) if q == k]
        longest = max(len(u) for _, u in group)
        best = min((j for j, u in group if len(u) == longest), key=lambda j: (j is None, j))
        kept = i == best and len(t or "") == longest and (k, "done") not in used
        if kept:
            used.add((k, "done"))
        out.append((i, best, len(group), kept, hashlib.sha256(k.encode()).hexdigest()))
    return out


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n\t"), (7, "é ü"), (7, "é ü"), (8, "x" * 50_000), (9, "x " * 50_000), (None, "ab"), (None, "alone"), (10, "A b"), (11, "a\xa0b")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups(make, digest_bytes):
    got = exactdedup.exact_dedup(make(ROWS, clash=True), digest_bytes).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_exact(ROWS)))


def test_weak_digests_are_verified_on_bytes(make):
    rows = [(i, f"text {i % 300}") for i in range(900)]
    got = exactdedup.exact_dedup(make(rows), digest_bytes=1).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_exact(rows)))


def test_exact_empty_table(make):
    assert exactdedup.exact_dedup(make([])).count() == 0


def test_runs_answer_lookups(spark, make):
    index = exactdedup.DigestIndex(spark)
    index.flush(make([(1, "a"), (2, "b")]))
    index.flush(make([(3, "a")]))
    found = index.lookup([hashlib.sha256(b"a").digest(), hashlib.sha256(b"none").digest()]).collect()
    assert sorted(r.doc_id for r in found) == [1, 3]
    assert sorted(r.group_size for r in index.compact().collect()) == [1, 2]


@pytest.mark.parametrize(("memtables", "fan_in", "bits"), [(8, 4, 8), (9, 3, 1), (1, 4, 8)])
def test_compaction_of_many_runs(spark, make, monkeypatch, memtables, fan_in, bits):
    """Sizes and best rows of all digests, through several levels, with filters that err often as well."""
    monkeypatch.setattr(exactdedup, "FILTER_BITS", bits)
    monkeypatch.setattr(exactdedup, "BLOCK_BITS", 32768 if bits > 1 else 64)
    rng = random.Random(3)
    rows = [(rng.choice([None, i, i, i]), "x" * rng.randrange(3) + " " * rng.randrange(3) + f"y{rng.randrange(150)}") for i in range(600)]
    index = exactdedup.DigestIndex(spark, memtables=memtables, fan_in=fan_in)
    index.flush(make(rows))
    got = {bytes(r.digest): (r.group_size, r.best.n_chars, None if r.best.inverse_id is None else ~r.best.inverse_id) for r in index.compact().collect()}
    want = {}
    for i, t in rows:
        want.setdefault(hashlib.sha256(t.replace(" ", "").encode()).digest(), []).append((len(t), i))
    assert set(got) == set(want)
    for digest, group in want.items():
        longest = max(n for n, _ in group)
        best = min((i for n, i in group if n == longest), key=lambda i: (i is None, i))
        assert got[digest] == (len(group), longest, best)
    expected = 1
    while memtables > 1:
        memtables, expected = -(-memtables // fan_in), expected + 1
    assert len(index.levels) == expected


def shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or "")) if w]
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute_near(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(root(i) if i is not None else None)) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):  # texts that share half of their words
        rows.append((1000 + i, " ".join(passage + [word() for _ in range(60)])))
    for base in range(12):  # near copies, some beyond the threshold
        words = [word() for _ in range(120)]
        for k in range(6):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = word()
            rows.append((base * 10 + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("open_per_class", [32, -1])
def test_near_components(make, monkeypatch, open_per_class):
    """With no pairs allowed in buckets, all that pivots leave goes through the prefix filter."""
    monkeypatch.setattr(minhash, "OPEN_PER_CLASS", open_per_class)
    rows = [*corpus(), (500, None), (501, ""), (502, " "), (503, "one two"), (504, "ONE  two"), (505, "one two three"), (None, "one two"), (506, "z " * 30_000), (0, rows_text())]
    got = minhash.near_dedup(make(rows, clash=open_per_class < 0), 3, (85, 100)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_near(rows, 3, 85, 100)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def rows_text():
    return "one two"


def test_near_empty_and_dropping(make):
    assert minhash.near_dedup(make([])).count() == 0
    rows = [*corpus()[:3], *corpus()[60:72], (7, "short text"), (7, "short text"), (None, "x"), (None, "x")]
    kept = minhash.drop_near_duplicates(make(rows), 3, (85, 100)).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(7) == 1 and ids.count(None) == 2 and {1000, 1001, 1002} <= set(ids) and len(set(ids)) < 16


def test_dropping_needs_no_other_columns(spark):
    """Of rows that repeat an id, the same one stays whatever their order, also where only a further column differs."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "a b c d e f g", "z"), (3, long, "l"), (4, long + " end", "m"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, more string")
    kept = [sorted((r.doc_id, r.more) for r in minhash.drop_near_duplicates(d).collect() if r.doc_id != 5) for d in (docs, docs.repartition(5, "more"))]
    assert kept[0] == kept[1] == [(1, "x"), (3, "l")]


def test_scratch_is_shared_or_refused():
    from types import SimpleNamespace

    from rasterlake.llm.scratch import shared_root

    conf = SimpleNamespace(get=lambda key, default=None: None)
    remote = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError):
        shared_root(remote)


def test_scratch_is_cleared(spark):
    import os

    from rasterlake.llm.scratch import Scratch, clear, made

    mark = made()
    scratch = Scratch(spark, "test")
    scratch.save(spark.range(3), "a")
    folder = scratch.base.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder + "/a")
    clear(spark, mark)
    assert not os.path.exists(folder) and made() == mark


def test_components_of_a_long_path(spark):
    n = 200
    order = random.Random(2).sample(range(n), n)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(900, 901), (5, 5)], "u bigint, v bigint")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 900: 900, 901: 900}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
