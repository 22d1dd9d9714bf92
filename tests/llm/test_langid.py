"""Kneser-Ney probabilities against direct counting, and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from unitlife.llm import langid

SYLLABLES = {"aa": "ba be bi bo bu da de", "bb": "ka ké ki ta té to ra", "cc": "zul zan zor ba be mi mo"}


def text(lang, rng, words=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(words))


def normal(t):
    return [langid._START] * 3 + [ord(c) for c in " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split())]


def direct(texts, every):
    """``-log2 P`` of a gram by the defining recursion."""
    top = Counter(tuple(normal(t)[i:i + 4]) for t in texts for i in range(len(normal(t)) - 3))
    orders = {4: top}
    for n in (3, 2, 1):
        orders[n] = Counter({g: 0 for g in ()})
        for g in {g[-n:] for g in orders[n + 1]}:
            orders[n][g] = len({h for h in orders[n + 1] if h[-n:] == g})

    def p(g):
        if not g:
            return 1 / (len(every) + 1)
        counts = orders[len(g)]
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.75
        follow = [v for h, v in counts.items() if h[:-1] == g[:-1]]
        lower = p(g[1:])
        return (max(counts.get(g, 0) - d, 0) + d * len(follow) * lower) / sum(follow) if follow else lower
    return lambda g: -math.log2(p(g))


def keys_of(texts):
    keys, owners = zip(*langid.grams(texts), strict=True)
    return np.concatenate(keys), np.concatenate(owners)


def counted(texts):
    return np.unique(keys_of(texts)[0], return_counts=True)


def test_probabilities():
    rng = random.Random(0)
    texts = {lang: [text(lang, rng, 6) for _ in range(3)] for lang in ("aa", "bb")}
    model = langid.Model({lang: counted(t) for lang, t in texts.items()})
    every = {c for t in texts.values() for x in t for c in normal(x)[3:]}
    probe = "Bade, ké-zul"
    codes = normal(probe)
    for j, lang in enumerate(model.langs):
        bits = direct(texts[lang], every)
        want = np.mean([bits(tuple(codes[i - 3:i + 1])) for i in range(3, len(codes))])
        assert model.entropies([probe])[0][0, j] == pytest.approx(want, rel=1e-5)


def test_grams_do_not_cross_texts():
    joined, owner = keys_of(["Ab, c", "", "...", "d"])
    assert np.array_equal(joined[owner == 0], keys_of(["ab c"])[0])
    assert np.bincount(owner[joined & np.uint64(0xFFFF) != 32], minlength=4).tolist() == [3, 0, 0, 1]


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    rng = random.Random(3)
    texts = [text("aa", rng, 200) + " ,. " * 30 + text("cc", rng, 50), "", "x", "  - "]
    model = langid.Model({"aa": counted(texts[:1]), "cc": counted([text("cc", rng)])})
    whole, letters = model.entropies(texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(langid, "BATCH_CHARS", size)
        assert np.allclose(model.entropies(texts)[0], whole) and (model.entropies(texts)[1] == letters).all()


def test_fit_and_identify(spark):
    rng = random.Random(1)
    rows = [(i, text(lang, rng), lang, 0.5) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(500, None, "aa", 0.5), (501, "", None, 0.5), (502, "123 !!", "bb", 0.5), (503, "xqwv jjhq fghw " * 20, None, 0.5),
             (504, "Zulzan", None, 0.5), (504, "Zulzan", None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = langid.identify(df, langid.fit(df.filter("doc_id % 5 <> 0"), sample_rows=60))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "cross_entropy", "rejected"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id < 500 and r.doc_id % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert not any(r.rejected for r in got if r.doc_id < 500 or r.doc_id == 504)
    assert {r.lang_pred for r in got if r.doc_id == 504} == {"cc"}
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in got if r.doc_id in (500, 501, 502))
    assert [r.rejected for r in got if r.doc_id == 503] == [True]


def test_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc", None), (None, None, "x")], "doc_id long, text string, lang string")
    got = langid.identify(df, langid.fit(df)).collect()
    assert {(r.lang_pred, r.rejected) for r in got} == {("und", False)}
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).collect() == []


def test_model_keeps_the_most_frequent_grams(spark):
    df = spark.createDataFrame([(1, "ab ab ab ab cd", "x")], "doc_id long, text string, lang string")
    small = langid.fit(df, max_grams=4)
    assert 0 < len(small.levels[0][-1].keys) <= 4


def test_no_gram_is_dropped_however_many_there_are(spark):
    rng = random.Random(4)
    han = ["".join(chr(rng.randrange(0x4E00, 0x9FA6)) for _ in range(5000)) for _ in range(60)]  # each gram once
    latin = [text("aa", rng) for _ in range(60)]
    rows = [(i, t, "han") for i, t in enumerate(han)] + [(i, t, "aa") for i, t in enumerate(latin, 100)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    whole = langid.Model({"han": counted(han), "aa": counted(latin)})
    assert model.langs == whole.langs and len(whole.levels[1][-1].keys) > 1 << 18
    for mine, theirs in zip(model.levels, whole.levels, strict=True):
        for a, b in zip(mine, theirs, strict=True):
            assert np.array_equal(a.keys, b.keys) and np.array_equal(a.counts, b.counts) and a.discount == b.discount
    assert [p[0] for p in model.predict([han[0][:50], latin[0]])] == ["han", "aa"]


def test_labels_without_letters_and_clashing_names(spark):
    """A label whose texts hold no letter is not learned; a rare language gets a limit of its own."""
    rng = random.Random(6)
    rows = [(i, text("aa", rng), "aa") for i in range(400)] + [(1000 + i, "123 456", "zz") for i in range(300)]
    rows += [(2000 + i, text("bb", rng), "bb") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS _text", "2 AS c0")
    model = langid.fit(df, sample_rows=50)
    alone = langid.Model({"aa": counted([r[1] for r in rows if r[2] == "aa"]), "bb": counted([r[1] for r in rows if r[2] == "bb"])})
    assert set(model.langs) == {"aa", "bb"}
    assert all(model.limits[lang] < alone.limits[lang] for lang in alone.langs)  # none keeps the limit of an uncalibrated model
    out = langid.identify(df, model)
    assert out.columns[:5] == ["doc_id", "text", "lang", "_text", "c0"]
    got = out.collect()
    assert {r.lang_pred for r in got if r.lang == "zz"} == {"und"} and {(r._text, r.c0) for r in got} == {(1, 2)}


def test_label_score_and_rejection_by_plain_counts(spark):
    rng = random.Random(8)
    rows = [(i, text(lang, rng, 5), lang) for i, lang in enumerate(list(SYLLABLES) * 8)]
    probes = [text(lang, rng, 3) for lang in SYLLABLES] + ["xqwv jjhq fghw", "ba", "q" * 60, "Zul, zan!zor be", "ЖЩ" * 30]
    columns = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(rows, columns))
    found = langid.identify(spark.createDataFrame([(i, t, None) for i, t in enumerate(probes)], columns), model).orderBy("doc_id").collect()

    langs = sorted(SYLLABLES)
    every = {c for _, t, _ in rows for c in normal(t)[3:]}
    bits = {lang: direct([t for _, t, own in rows if own == lang], every) for lang in langs}

    def entropies(t):
        codes = normal(t)
        return [math.fsum(bits[lang](tuple(codes[i - 3:i + 1])) for i in range(3, len(codes))) / (len(codes) - 3) for lang in langs]

    def shares(e, heat):
        odds = [2 ** (-heat * (x - min(e))) for x in e]
        return [x / sum(odds) for x in odds]

    own = [(langs.index(lang), entropies(t)) for _, t, lang in rows]
    heat = max(langid.TEMPERATURES, key=lambda h: sum(math.log(max(shares(e, h)[j], 1e-9)) for j, e in own))
    uniform = math.log2(len(every) + 1)
    limit = [(float(np.quantile([e[j] for i, e in own if i == j], 0.999)) + uniform) / 2 for j in range(len(langs))]
    for row, t in zip(found, probes, strict=True):
        e = entropies(t)
        best = e.index(min(e))
        letters = sum(c.isalpha() for c in t)
        assert (row.lang_pred, row.rejected) == (langs[best], e[best] > limit[best] + uniform / math.sqrt(letters))
        assert row.score == pytest.approx(shares(e, heat)[best], rel=1e-3) and row.cross_entropy == pytest.approx(e[best], rel=1e-4)
    assert {row.rejected for row in found} == {True, False}


def test_all_training_rows_set_temperature_and_limits(spark):
    """Of many rows of one language a few are odd: they move its exact quantile, wherever their keys put them."""
    rng = random.Random(11)
    rows = [(i, text("aa", rng, 3), "aa") for i in range(2200)] + [(5000 + i, "q" * 9 + "wvxj" * i, "aa") for i in range(1, 4)]
    rows += [(9000 + i, text("bb", rng, 3), "bb") for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    entropies, _ = model.entropies([t for _, t, _ in rows])
    own = np.array([model.langs.index(lang) for *_, lang in rows])
    for j, lang in enumerate(model.langs):
        want = (np.quantile(entropies[own == j, j], 0.999) + np.log2(model.letters)) / 2
        assert model.limits[lang] == pytest.approx(want, rel=1e-6)
    each = np.arange(len(own))
    fits = [np.log(np.maximum(langid._softmax(entropies, t)[each, own], 1e-9)).sum() for t in langid.TEMPERATURES]
    assert model.temperature == langid.TEMPERATURES[int(np.argmax(fits))]
