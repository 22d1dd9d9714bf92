"""Source divergence: the transducer against sorted lists, the audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from unitlife.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def brute(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        sources = sorted((s for own, s in groups if own == lang), key=str.encode)
        share = {}
        for source in [*sources, None]:
            own = {t: sum(counts[lang, s][t] for s in sources) if source is None else counts[lang, source][t] for t in kept}
            whole = sum(own.values()) + 2 * len(kept)
            share[source] = {t: 1 + 10 ** 9 * (n + 2) // whole for t, n in own.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for a in sources:
            pairs = sorted(((-sum(f(share[a][t], share[b][t]) for t in kept), b.encode(), b) for b in sources if b != a))
            out |= {(lang, a, "pair", b, -v, r) for r, (v, _, b) in enumerate(pairs, 1)}
            over = sorted((-f(share[a][t], share[None][t]), t.encode(), t) for t in kept
                          if counts[lang, a][t] and share[a][t] > share[None][t])[:top]
            out |= {(lang, a, "term", t, -v, r) for r, (v, _, t) in enumerate(over, 1)}
    return out


WORDS = st.lists(st.text(st.sampled_from("abcé日z"), min_size=1, max_size=6), max_size=60)


@given(WORDS)
@settings(max_examples=150, deadline=None)
def test_transducer_is_minimal_and_ordered(words):
    terms = sorted({w.encode() for w in words})
    machine, n = divergence.build(iter(terms))
    assert n == len(terms)
    if not terms:
        return
    back = divergence.Transducer.unpacked(machine.packed())
    assert back.terms(list(range(n))) == terms and machine.terms(list(range(n))) == terms
    # minimal: as many states as the terms have different sets of endings
    endings = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for t in terms for p in (t[:i] for i in range(len(t) + 1))}
    assert len(machine.final) == len(endings)


@given(WORDS, st.text(st.sampled_from("abcé日zABZ ,1"), max_size=200), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_walk_finds_exactly_the_kept_terms(words, text, stretches):
    terms = sorted({w.encode() for w in words})
    cuts = {}
    for i, t in enumerate(terms):  # stretches may not part terms with equal first bytes
        cuts.setdefault(divergence._prefix(t), []).append(t)
    runs = [list(x) for x in np.array_split(np.array(list(cuts), object), stretches) if len(x)]
    held, offset = [], 0
    for run in runs:
        own = [t for p in run for t in cuts[p]]
        held.append(("", divergence._prefix(own[0]), offset, divergence.build(iter(own))[0].packed()))
        offset += len(own)
    if not held:
        return
    walker = divergence.Walker(held)
    found = [o for low in divergence.buffers(text.encode(), 7) for o in walker.ordinals(low, *divergence.tokens(low), "")]
    assert Counter(terms[o] for o in found) == Counter(t.encode() for t in terms_of(text) if t.encode() in set(terms))


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        terms, count = rng.randint(1, 10 ** 6), rng.randint(0, 10 ** 14)
        total = count + rng.randint(0, 10 ** 15)
        assert divergence.shares(np.array([count]), total, terms)[0] == 1 + 10 ** 9 * (count + 2) // (total + 2 * terms)


def corpus(seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß日İſ") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    rows = []
    for i in range(400):
        lang = rng.choice(["aa", "aa", "bb", None, ""])
        source = rng.choice(["s1", "s1", "S1", "é", "日本", None, "s2"])
        own = words[(i % 5) * 10:][:60]
        text = rng.choice([" ", "1", ", ", "\x7f", "_"]).join(rng.choice([w, w.upper(), w]) for w in rng.choices(own, k=rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, text, None]), lang, source))
    rows += [("common " * 5, "cc", f"s{i}") for i in range(9)]  # too few documents: no kept term
    rows += [("", "dd", "only")]
    return rows + rows[:20]


def frame(spark, rows):
    data = [(i, t, lang, source, 0, "x", 1) for i, (t, lang, source) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, value int, part string, ordinal int")


@pytest.mark.parametrize("settings_", [
    {}, {"stretch_terms": 9, "block_terms": 7}, {"stretch_terms": 9, "round_bytes": 1, "least_docs": 3}, {"top": 2, "least_docs": 1},
])
def test_against_plain_counting(spark, monkeypatch, settings_):
    rows = corpus()
    if settings_:
        monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    got = divergence.audit(frame(spark, rows).repartition(3), **settings_).collect()
    want = brute(rows, settings_.get("least_docs", 10), settings_.get("top", 10))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_long_text_and_one_long_term(spark):
    rows = [("word " * 500_000 + "é" * 300_000, "aa", "s")] + [("word x" * i, "aa", f"t{i % 2}") for i in range(12)] + [("é" * 300_000, "aa", "u")] * 9
    got = divergence.audit(frame(spark, rows)).collect()
    assert len(got) == len(brute(rows)) and {tuple(r) for r in got} == brute(rows)


def test_no_terms_and_no_rows(spark):
    rows = [("1 2", "aa", "s"), (None, "aa", "t"), ("", None, None)]
    assert {tuple(r) for r in divergence.audit(frame(spark, rows)).collect()} == brute(rows) == {
        ("aa", "s", "pair", "t", 0, 1), ("aa", "t", "pair", "s", 0, 1)}
    assert divergence.audit(frame(spark, []).filter("false")).collect() == []
