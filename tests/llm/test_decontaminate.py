"""Alignment against the textbook recurrence, and planted passages."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from unitlife.llm import decontaminate as dec


def local_score(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, last[j - 1] + (dec.MATCH if x == y else dec.MISMATCH), last[j] + dec.GAP, row[-1] + dec.GAP))
        best, last = max(best, *row), row
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=20)),
                min_size=1, max_size=6))
def test_alignment_scores(pairs):
    items = dec._padded([np.array(a) for a, _ in pairs], -1)
    windows = dec._padded([np.array(b) for _, b in pairs], -2)
    assert dec.align(items, windows)[0].tolist() == [local_score(a, b) for a, b in pairs]


def planted(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([16, 30, 60]))) for i in range(40)]
    docs, want = [], {}
    for d in range(160):
        words = text(rng.choice([0, 5, 80, 300]))
        if d % 2:
            item_id, item = rng.choice(items)
            copy = list(item)
            if d % 4 == 1:  # edited: substitutions, a deletion and an insertion
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                del copy[rng.randrange(len(copy))]
                copy.insert(rng.randrange(len(copy)), "INSERTED")
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
            want[d] = (item_id, at, at + len(copy))
        docs.append((d, " ".join(words).replace("word1", "Word1")))
    return [(i, " ".join(w) + ".") for i, w in items], docs, want


def test_planted_passages_and_nothing_else(spark):
    items, docs, want = planted()
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (None, items[0][1])], "item_id long, text string")
    rows = [(d, t, "k") for d, t in docs] + [(900, None, "k"), (901, "", "k"), (1, docs[1][1], "k")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, leaks string").selectExpr(
        "doc_id", "text", "leaks", "1 AS _text", "2 AS _of", "3 AS _node", "4 AS _leaks", "5 AS digest", "6 AS c0")
    for block_words, at_once in ((dec.BLOCK_WORDS, 4), (300, 10), (300, 2)):
        out = dec.find(documents, benchmark, block_words=block_words, blocks_at_once=at_once)
        assert out.columns == ["doc_id", "text", "_text", "_of", "_node", "_leaks", "digest", "c0", "leaks"]
        found = out.collect()
        assert {(r._text, r._of, r._node, r._leaks, r.digest, r.c0) for r in found} == {(1, 2, 3, 4, 5, 6)}
        assert len(found) == len(rows)
        for r in found:
            leaks = [x for x in r.leaks if x.item_id is not None]
            assert [x.item_id for x in leaks] == ([want[r.doc_id][0]] if r.doc_id in want else [])
            for x in leaks:
                assert abs(x.start - want[r.doc_id][1]) <= 4 and abs(x.end - want[r.doc_id][2]) <= 4
        same = [len([x for x in r.leaks if x.item_id is None]) for r in found if r.leaks and r.leaks[-1].item_id == items[0][0]]
        assert all(same)  # an equal item under another id is reported too


def test_copies_with_every_fourth_or_fifth_word_replaced(spark):
    sizes = [9, 12, 16, 20, 39, 59]
    items = [(n, [f"item{n}x{i}" for i in range(n)]) for n in sizes]
    copies = {}
    for n, item in items:
        for step in (4, 5):
            copy = [f"new{i}" if i % step == step - 1 else w for i, w in enumerate(item)]
            if sum(a == b for a, b in zip(item, copy, strict=True)) >= dec.MIN_WORDS:
                assert local_score(item, copy) >= dec.MIN_SCORE * dec.MATCH * n
                copies[n * 10 + step] = (n, " ".join(copy))
    assert len(copies) == 11
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    edited = [(d, t) for d, (_, t) in copies.items()]
    whole = [(-n, " ".join(w)) for n, w in items]  # another copy must not hide an edited one
    shreds = [(-1000 - n, " . ".join(" ".join(w[i:i + 3]) for i in range(0, n, 7))) for n, w in items]
    for rows in (edited, edited + whole, edited + shreds):
        documents = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r.doc_id: [x.item_id for x in r.leaks] for r in dec.find(documents, benchmark).collect()}
        assert all(found[d] == [n] for d, (n, _) in copies.items())


def test_empty_sides(spark):
    documents = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in dec.find(documents, none).collect()] == [[]]
    items = spark.createDataFrame([(1, " ".join("abcdefghij"))], "item_id long, text string")
    assert dec.find(documents.limit(0), items).collect() == []


def found_in(spark, items, docs):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r.leaks for r in dec.find(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}


def test_every_item_aligned_with_every_document(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([12, 20, 33, 60, 140]))) for i in range(30)]
    docs = []
    for d in range(150):
        words = text(rng.choice([0, 20, 90]))
        if d % 3:
            copy = list(rng.choice(items)[1])
            for i in rng.sample(range(len(copy)), int(len(copy) * rng.uniform(0.15, 0.33))):
                copy[i] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((d, words))
    want = {(d, i): local_score(item, words) for d, words in docs for i, item in items}
    leaked = {pair for pair, score in want.items() if score >= dec.least_score(len(items[pair[1]][1]))}
    found = found_in(spark, [(i, " ".join(w)) for i, w in items], [(d, " ".join(w)) for d, w in docs])
    pairs = {(d, x.item_id): x.score for d, leaks in found.items() for x in leaks}
    assert set(pairs) <= leaked and len(leaked) > 60
    assert all(abs(score - want[p] / (dec.MATCH * len(items[p[1]][1]))) < 1e-9 for p, score in pairs.items())
    assert len(pairs) >= 0.9 * len(leaked)


def test_short_long_and_unspaced_items(spark):
    words = [f"v{i}" for i in range(300)]
    chinese = "".join(chr(0x4e00 + 7 * i) for i in range(24))
    items = [(1, "Who wrote it?"), (2, " ".join(words)), (3, chinese), (4, "two words"), (5, None)]
    docs = [(1, "they asked who wrote it again"), (2, "who else wrote it"), (3, "x " + " ".join(words[100:200]) + " y"),
            (4, " ".join(words[100:140])), (5, f"前{chinese[:10]}了{chinese[11:]}后"), (6, "two words")]
    found = {d: [(x.item_id, x.start, x.end, x.equal) for x in leaks] for d, leaks in found_in(spark, items, docs).items()}
    assert found == {1: [(1, 2, 5, 3)], 2: [], 3: [(2, 1, 101, 100)], 4: [], 5: [(3, 1, 25, 23)], 6: []}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.item_id for r in dec.unsearched(benchmark).collect()) == [4, 5]


def test_copies_next_to_each_other(spark):
    plain, dull = [f"p{i}" for i in range(16)], "a b a b a c a b".split() * 3
    items = [(1, " ".join(plain)), (2, " ".join(dull))]
    found = found_in(spark, items, [(1, " ".join(plain * 3)), (2, " ".join(dull + ["x"] * 3 + dull + ["y"] * 3 + dull))])
    assert [(x.item_id, x.start, x.end) for x in found[1]] == [(1, 0, 16), (1, 16, 32), (1, 32, 48)]
    covered = {w for x in found[2] if x.item_id == 2 for w in range(x.start, x.end)}
    assert len(found[2]) >= 1 and {*range(24), *range(27, 51), *range(54, 78)} <= covered


def test_a_phrase_that_many_items_share(monkeypatch):
    phrase = [f"s{i}" for i in range(8)]
    items = [(i, " ".join(phrase + [f"i{i}x{k}" for k in range(10)])) for i in range(400)]
    texts = [" ".join(" ".join(phrase) + f" gap{k}" for k in range(60)) + " " + items[7][1], "nothing here", items[399][1]]
    block = dec.Block.of(items)
    block.choose(block.count(texts))
    whole = block.leaks(texts)
    assert [[x[0] for x in rows] for rows in whole] == [[7], [], [399]]
    monkeypatch.setattr(dec, "HITS", 5000)
    numbers, starts = block.read(texts)
    regions = list(block.candidates(numbers, starts))
    assert len(regions) > 10 and max(map(len, regions)) <= 5000
    assert block.leaks(texts) == whole
