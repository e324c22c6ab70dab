import zlib

import numpy as np
import pytest

from rasterlake.llm import langid


def test_every_language_is_learned(make):
    rows = [(i, f"text {i}", f"l{i % 250:03}") for i in range(1500)] + [(None, "same text", "tied")] * 50
    want = {r[2] for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 4 != 2}
    assert len(want) > 240
    for most in (100, 1000):
        x, langs = langid.training_sample(make(rows), most)
        each = max(1, most // len(want))
        assert set(langs) == want and len(x) == len(langs)
        assert all(langs.count(lang) <= 2 * each for lang in want)


@pytest.mark.parametrize(("text", "letter"), [(None, False), ("", False), ("² ½ 12", False), ("Ⅷ ① _ -", False), ("12 a", True), ("ʰ", True), ("中", True), ("ǅ", True), ("\u0301", False)])
def test_letters_are_unicode_letters(spark, text, letter):
    assert langid.has_letter(text) == letter
    got = spark.createDataFrame([(text,)], "text string").selectExpr(f"coalesce(rlike(text, r'{langid.LETTERS}'), false) as x").first().x
    assert got == letter


def test_numerals_are_undetermined(make):
    rows = [(i, ["le chat et la souris", "the cat and the mouse"][i % 2] + f" {i}", "fr" if i % 2 == 0 else "en") for i in range(60)]
    got = {r.doc_id: r for r in langid.identify(make([*rows, (100, "² ½ 12"), (101, "Ⅷ")])).collect()}
    assert all((got[i].lang_pred, got[i].score) == (langid.UNDETERMINED, 0.0) for i in (100, 101))


def test_predictions_are_plain_votes():
    """Families first, then one-versus-one votes, written out one text and one duel at a time."""
    rng = np.random.default_rng(3)
    words = {lang: ["".join(rng.choice(list("abcdefghijklmno")[k : k + 7], 4)) for _ in range(40)] for k, lang in enumerate(["en", "de", "nl", "fr", "es", "xx"])}
    texts = [(lang, " ".join(rng.choice(w, 25))) for lang, w in words.items() for _ in range(30)]
    x = np.array([langid.features(t) for _, t in texts])
    model = langid.LanguageModel(x, [lang for lang, _ in texts])
    assert model.members == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "xx": ["xx"]}
    assert model.pairs == [("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")]
    duel = dict(zip(model.pairs, model.pair_w, strict=True))
    plain = lambda v, w: float(sum(a * b for a, b in zip(v.tolist(), w.tolist(), strict=False)) + w[-1])
    chance = lambda z: 1 / (1 + np.exp(-z))
    got = model.predict(x[::7])
    for v, (lang, family, score) in zip(x[::7], got, strict=True):
        p = [chance(plain(v, w)) for w in model.family_w]
        assert family == model.families[int(np.argmax(p))]
        members = model.members[family]
        votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for (a, b), w in duel.items():
            if a in members:
                c = chance(4 * plain(v, w))
                votes[a if c >= 0.5 else b] += 1
                sums[a] += c
                sums[b] += 1 - c
        most = max(votes.values())
        best = max((m for m in members if votes[m] == most), key=lambda m: sums[m])
        inner = sums[best] / (len(members) - 1) if len(members) > 1 else 1.0
        assert lang == best and score == pytest.approx(max(p) / sum(p) * inner, abs=1e-4)
    assert np.mean([lang == got_lang for (lang, _), (got_lang, _, _) in zip(texts[::7], got, strict=True)]) > 0.9
