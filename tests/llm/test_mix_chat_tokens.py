import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import pytest

from rasterlake.llm import chatformat, mixing, tokens
from rasterlake.llm.queries import tokenizer_file
from rasterlake.llm.scratch import Scratch


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = total - sum(done.values())
        rest = [s for s in names if s not in done]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return {**done, **share}
        done |= {s: cap * sizes[s] for s in over}


def words(text):
    return len([w for w in (text or "").replace("\t", " ").split(" ") if w])


def mixed(make):
    rows = [(i, "w " * (i % 37 + 1), "en", f"s{i % 5}") for i in range(900)]
    rows += [(1000 + i, "w " * 200, "en", "big") for i in range(100)] + [(2000 + i, "w w", "en", "tiny") for i in range(5)]
    rows += [(3000 + i, "w w w", None, None) for i in range(50)] + [(4000, None, "en", "s0"), (4001, "", "en", "s1"), (4002, "w " * 5000, "en", "s2")] + [(5000, "a b", "en", "s3")] * 3 + [(None, "a b c", "en", "s3")]
    return rows, make(rows, clash=True)


def test_mix_meets_targets(make):
    rows, docs = mixed(make)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(5, 0.02 * sizes[s]), s
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_of_many_sources(spark):
    """Ranges of sources, ties, caps, sources without words."""
    rng = np.random.default_rng(2)
    sizes = {f"é{k}" if k % 7 == 0 else f"s{k}": int(rng.choice([0, 1, 5, 5, 5, 100, 4000])) for k in range(400)} | {None: 50}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint").repartition(6)
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want)
    assert [got[s] for s in want] == pytest.approx([want[s] for s in want])


def test_mix_corpus_repeats_rows(make):
    rows, docs = mixed(make)
    report = Counter()
    for r in mixing.mix_report(docs).collect():
        report[r.doc_id] += r.copies
    out = mixing.mix_corpus(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == +report


def test_each_document_keeps_its_expectation(make):
    docs = make([(i, "w " * (1 + i * i % 50), "en", "ab"[i % 2]) for i in range(40)])
    mean = Counter()
    for seed in range(6):
        for r in mixing.mix_report(docs, seed=seed).collect():
            mean[r.source] += r.copies / 6 / 20
    targets = {r.source: r.target / r.source_size for r in mixing.mix_report(docs).collect()}
    assert all(abs(mean[s] - targets[s]) < 0.25 for s in "ab")


def test_mix_empty(make):
    assert mixing.mix_report(make([])).count() == 0
    assert [r.taken for r in mixing.mix_report(make([(1, None), (2, "")])).collect()] == [0, 0]


CHAT = "conv_id bigint, turn bigint, role string, text string"
EVIL = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "<", "|", "<|im_end|>\n", "\\n", "é𝒳", "<\\n>", "\n\n", ""]


def test_chat_roundtrip(spark):
    rows = [(c, k, ["user", "assistant", "sys\ntem", None, "a<|b\\"][(c + k) % 5], EVIL[(c * 3 + k) % len(EVIL)] + EVIL[(c + 2 * k) % len(EVIL)]) for c in range(12) for k in range(c % 7 + 1)]
    rows += [(50, 0, "assistant", None), (51, None, "user", "x"), (51, None, "user", "x"), (51, 1, "assistant", "y"), (None, 0, "user", "n"), (52, 0, "assistant", "z" * 100_000)]
    got = {r.conv_id: r for r in chatformat.chat_digests(spark.createDataFrame(rows, CHAT)).collect()}
    by = {}
    for c, k, role, text in sorted(rows, key=lambda r: tuple((x is not None, x or (0 if i < 2 else "")) for i, x in enumerate(r))):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chatformat.chat_digests(spark.createDataFrame([], CHAT)).count() == 0


def test_chats_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a" * 50_000), (2, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, CHAT)
    odd = turns.withColumns({c: F.lit("x") for c in ("node", "parent", "score", "leaf", "depth", "c", "up", "head", "body", "loss", "begin", "nc", "formatted", "turns")})
    assert sorted(map(str, chatformat.chat_digests(odd).collect())) == sorted(map(str, chatformat.chat_digests(turns).collect()))


def test_best_branch_of_reply_trees(spark):
    tree = [  # two roots in one conversation, an orphan, a cycle
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", -5.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "thanks", 0.5),
        (1, 5, 2, "user", "no", 1.0), (1, 6, None, "user", "other", 0.0), (1, 7, 99, "user", "orphan", 50.0), (1, 8, 9, "user", "c", 9.0), (1, 9, 8, "user", "c", 9.0),
        (2, 1, None, "user", "only", None),
    ]
    nodes = spark.createDataFrame(tree, "conv_id bigint, node bigint, parent bigint, role string, text string, score double")
    out = {r.conv_id: r for r in chatformat.read_chats(chatformat.format_chats(nodes)).collect()}
    assert [t.text for t in out[1].turns] == ["q", "good", "thanks"] and out[1].loss_texts == ["good"]
    assert [t.text for t in out[2].turns] == ["only"]
    top = chatformat.format_chats(nodes, top=2).filter("conv_id = 1").collect()
    assert sorted(r.leaf for r in top) == [4, 6]


def test_long_chains_double(spark):
    turns = spark.createDataFrame([(1, k, "user", str(k)) for k in range(70)], CHAT)
    r = chatformat.chat_digests(turns).first()
    assert r.n_turns == 70 and r.turns_sha256 == hashlib.sha256("".join(f"user\n{k}\n" for k in range(70)).encode()).hexdigest()


TEXTS = [(5, "Hello world, again.\nAnd again"), (3, "a  b\n\n c\u00a0 d \n"), (4, None), (9, ""), (1, "word " * 3000), (7, "<|endoftext|> it's 日本"), (7, "<|endoftext|> it's 日本"), (None, "no id"), (2, "x" * 40_000), (-6, "\x1c \t"), (8, " lead and trail ")]


def test_tokens_are_the_library_s_and_read_back(make):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    docs = make(TEXTS, clash=True)
    segments = tokens.write_tokens(docs, Scratch(docs.sparkSession, "test").path("s"), tokenizer_file(), segment_tokens=500)
    got = tokens.read_tokens(segments).collect()
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in TEXTS}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in TEXTS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]), zlib.crc32(want[r.doc_id].tobytes()))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert tokens.token_report(make([]), tokenizer_file()).count() == 0


def test_ids_are_directly_addressed():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, top, n).astype(np.uint32) for top, n in ((200, 3), (50_257, 2000), (1 << 31, 700), (5, 0))]
    segment = tokens.Segment(tokens.pack_segment([1, None, 3, 4], docs))
    flat = np.concatenate(docs)
    assert [segment[i] for i in range(len(flat))] == flat.tolist() == segment.all().tolist()
    assert segment.document(2).tolist() == docs[2].tolist() and segment.doc_ids == [1, None, 3, 4]
    with pytest.raises(IndexError):
        segment[len(flat)]
    with pytest.raises(ValueError):
        tokens.Segment(b"x" * 64)


def test_other_tokenizers_are_not_cut():
    with open(tokenizer_file()) as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    encoder = tokens.UnitEncoder(json.dumps(spec).encode())
    assert not encoder.cuts
    assert encoder.encode(["a b"])[0].tolist() == encoder.tokenizer.encode("a b", add_special_tokens=False).ids


def test_remembered_units_are_small(monkeypatch):
    """A worker that has met more units than it remembers holds at most 140 MB of them."""
    import tracemalloc

    import pyarrow as pa

    with open(tokenizer_file(), "rb") as f:
        encoder = tokens.UnitEncoder(f.read())
    monkeypatch.setattr(encoder, "learn", lambda words: encoder.units.update((w, len(w).to_bytes(12, "little")) for w in words))
    before, held = pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for k in range(0, 2_400_000, 20_000):
        encoder.encode(["a " + " ".join(f"w{i:07d}" for i in range(k, k + 20_000))])
        held = max(held, tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before)
    tracemalloc.stop()
    assert held < 140e6, held


def test_packed_units_come_back_as_they_were(monkeypatch):
    """Units asked for again after three times the dict's number of others have the library's ids, without being encoded again."""
    with open(tokenizer_file(), "rb") as f:
        encoder = tokens.UnitEncoder(f.read(), max_units=300)
    texts = ["a " + " ".join(f"{c}w{i}é." if i % 3 else f"\n{c}w{i}" for i in range(290)) for c in "bcdeß"]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for t, w in zip(texts, want, strict=True):
        assert encoder.encode([t])[0].tolist() == w.ids
    learned, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (learned.extend(words), learn(words)))
    assert encoder.encode(texts[1:2])[0].tolist() == want[1].ids
    assert not learned
