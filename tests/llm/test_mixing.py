"""Budgets against a plain walk down the tree, and the chosen prefix."""

import hashlib
import random
from fractions import Fraction

import pytest

from unitlife.llm import mixing

LEVELS = ("domain", "lang", "source")


def split(limit, children):
    """Water filling by hand: ``children`` are (name, weight, capacity)."""
    order = sorted(children, key=lambda c: (c[2] / c[1], c[0] or ""))
    out, open_ = {}, list(order)
    left = limit
    while open_ and Fraction(open_[0][2], open_[0][1]) <= Fraction(left, sum(c[1] for c in open_)):
        name, _, capacity = open_.pop(0)
        out[name] = capacity
        left -= capacity
    weight = sum(c[1] for c in open_)
    for name, w, _ in open_:
        out[name] = left * w // weight
    for name, *_ in open_[:limit - sum(out.values())]:
        out[name] += 1
    return out


def budgets(leaves, limit, weights, epochs, depth=0):
    """Budget per leaf path."""
    if depth == len(LEVELS):
        return {(): limit}
    names = {p[0] for p in leaves}
    below = {n: {p[1:]: t for p, t in leaves.items() if p[0] == n} for n in names}
    given = split(limit, [(n, weights.get(LEVELS[depth], {}).get(n, 1), epochs * sum(below[n].values())) for n in names])
    return {(n, *rest): b for n in names for rest, b in budgets(below[n], given[n], weights, epochs, depth + 1).items()}


def rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(400):
        domain = rng.choice(["a", "a", "a", "b", None])
        out.append((i, "x" * rng.choice([0, 3, 40, 400, 4000]), domain, rng.choice(["en", "de"]), rng.choice("stuv"), 9))
    return out + [out[1]] * 3 + [(None, "y" * 33, "a", "en", "s", 9), (500, None, "a", "en", "s", 9)]


@pytest.mark.parametrize("seed, share, epochs", [(1, (1, 2), 2), (2, (1, 1), 3), (3, (5, 1), 2), (4, (0, 1), 2), (5, (1, 999), 1)])
def test_against_a_walk(spark, seed, share, epochs):
    data = rows(seed)
    weights = {"domain": {"a": 5, "b": 2}, "lang": {"en": 3}}
    df = spark.createDataFrame(data, "doc_id long, text string, domain string, lang string, source string, tokens int")
    df = df.selectExpr("*", "1 AS budget", "2 AS slice", "3 AS level0", "4 AS c0", "5 AS place")
    out = mixing.mix(df, LEVELS, share, weights, epochs, seed=3)
    assert out.columns == ["doc_id", "text", *LEVELS, "budget", "slice", "level0", "c0", "place", "epoch", "tokens"]
    assert {tuple(r) for r in out.select("budget", "slice", "level0", "c0", "place").collect()} <= {(1, 2, 3, 4, 5)}
    got = sorted(((str(r.doc_id), r.epoch, r.tokens) for r in out.collect()))

    sized = [(r[0], -(-len(r[1] or "") // 4), r[2:5]) for r in data]
    leaves = {}
    for _, t, path in sized:
        if t:
            leaves[path] = leaves.get(path, 0) + t
    total = sum(leaves.values())
    want = []
    for path, budget in budgets(leaves, min(total * share[0] // share[1], epochs * total), weights, epochs).items():
        before, epoch = 0, 0
        while before < budget:
            key = lambda r: hashlib.md5(f"3|{epoch}|{'' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest()  # noqa: B023, E731
            for r in sorted((r for r in sized if r[2] == path and r[1]), key=key):
                if before < budget:
                    want.append((str(r[0]), epoch, r[1]))
                    before += r[1]
            epoch += 1
    assert got == sorted(want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, domain string, lang string, source string")
    assert mixing.mix(df, LEVELS).collect() == []


def test_a_weight_of_zero_leaves_out(spark):
    data = rows(6)
    df = spark.createDataFrame(data, "doc_id long, text string, domain string, lang string, source string, n int")
    weights = {"lang": {"de": 0, "en": 3}, "domain": {"b": 0}}
    got = mixing.mix(df, LEVELS, (1, 1), weights, 2, seed=3).collect()
    assert {r.lang for r in got} == {"en"} and {r.domain for r in got} == {"a", None}
    assert sum(r.tokens for r in got) > 0
    only = mixing.mix(df.filter("lang = 'en' AND domain <=> 'a'"), LEVELS, (1, 1), {}, 2, seed=3)
    assert only.count() > 0
    assert mixing.mix(df, LEVELS, (1, 1), {"lang": {"de": 0, "en": 0}}, 2).collect() == []
