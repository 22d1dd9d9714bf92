"""The similarity join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from unitlife.llm import components as cc
from unitlife.llm import jaccard


def shingles(text):
    words = [w.lower() for w in re.findall(r"\w+", text)]
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """Class id, least copy, copies and links per row with a text, by comparing all pairs of texts."""
    texts = sorted({t for _, t in rows if t is not None})
    least = {t: min((k for k, x in rows if x == t and k is not None), default=None) for t in texts}
    sets = [shingles(t) for t in texts]
    links = {t: [] for t in texts}
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[texts[i]].append(texts[j])
                links[texts[j]].append(texts[i])
    root = {}
    for t in texts:
        seen, todo = {t}, [t]
        while todo:
            for other in links[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        root[t] = min((least[x] for x in seen if least[x] is not None), default=None)
    return sorted(((k is None, k, root[t], least[t], sum(x == t for _, x in rows), len(links[t]))
                   for k, t in rows if t is not None), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, key = [], 0
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 9, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((key, " ".join(words).capitalize()))
            key += 1
    rows += [(key, ""), (key + 1, ""), (key + 2, None), (key + 3, None), (None, rows[0][1]), (key + 6, "one two"),
             (key + 6, "one two"), (key + 4, "One, two!"), (key + 5, "...")]
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, node string, leader string")
    out = jaccard.classes(df, **options).collect()
    return sorted(((r.key is None, r.key, r.class_id, r.copy_of, r.n_copies, r.n_links) for r in out), key=str)


@pytest.mark.parametrize("options", [{}, {"block_nodes": 3}, {"block_grams": 200}])
def test_against_all_pairs(spark, options):
    rows = corpus()
    assert found(spark, rows, **options) == brute(rows)


def test_keep_one_leaves_one_row_per_class(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, other string").selectExpr(
        "*", "1 AS node", "2 AS own", "3 AS copy_of", "4 AS c0")
    kept = jaccard.keep_one(df).collect()
    expected = {(r[2], ) for r in brute(rows)}
    with_text = [r for r in kept if r.text is not None]
    assert len(with_text) == len(expected) and {(r.doc_id,) for r in with_text} == expected
    assert len(kept) - len(with_text) == 2 and kept[0].other == "x"


def test_no_rows(spark):
    assert found(spark, []) == []


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = jaccard.bands_for(threshold, 0.999)
        assert bands * rows <= jaccard.MAX_HASHES and 1 - (1 - threshold**rows) ** bands >= 0.999


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 130)}, 201: 200}


def test_similar_is_exact_over_column_blocks(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    got = jaccard.similar(sets[:30], sets[30:], (1, 2))
    want = [[2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)) for b in sets[30:]] for a in sets[:30]]
    assert (got == np.array(want)).all()
