"""Removal against a plain scan over all strings of 50 bytes."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from unitlife.llm import suffixes


def brute(rows):
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        if key is not None:
            for i in range(len(data) - 49):
                s = data[i:i + 50]
                least[s] = min(least.get(s, key), key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 49):
            if key is not None and least[data[i:i + 50]] < key:
                gone[i:i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((str(key), len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [noise(n) for n in (48, 49, 50, 51, 60, 120, 400)] + ["ab" * 60, "x" * 200]
    rows = []
    for key in rng.sample(range(1000), 60):
        text = "".join(rng.choice([noise(rng.randrange(40)), rng.choice(shared)]) for _ in range(rng.randrange(8)))
        rows.append((key, text))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2001, rows[1][1]), (2001, rows[0][1]), (2002, None), (2003, ""),
             (None, shared[6]), (None, shared[6] + "q"), (-5, shared[6]), (2004, "x" * 49), (2005, "x" * 3000),
             (rows[2][0], shared[5] + "z")]
    return rows


@pytest.mark.parametrize("seed, part_bytes, bucket_bytes", [(1, 1 << 24, 1 << 27), (2, 700, 500), (3, 2500, 10_000)])
def test_against_all_strings(spark, monkeypatch, seed, part_bytes, bucket_bytes):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, part int, body string")
    got = suffixes.dedupe(df, part_bytes=part_bytes, bucket_bytes=bucket_bytes).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute(rows)


def test_long_documents_are_cut_without_a_trace(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    starts = np.array([0, 20, 80, 2100])
    windows = lambda a: {(s, at, d) for at, f, t, d in zip(a.at, a.first, a.last, a.doc, strict=True) for s in range(f, t + 1)}
    whole = windows(suffixes.anchors(data, starts))
    for size in (50, 64, 333):
        monkeypatch.setattr(suffixes, "BATCH_BYTES", size)
        assert windows(suffixes.part_anchors(data, starts)) == whole


def test_no_rows(spark):
    assert suffixes.dedupe(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_windows_have_their_anchor_at_the_same_distance():
    rng = np.random.default_rng(0)
    common = rng.integers(97, 100, 90).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 123, 33).astype(np.uint8), common, common[:70]])
    found = suffixes.anchors(data, np.array([0, 123]))
    by_window = {}
    for at, first, last in zip(found.at, found.first, found.last, strict=True):
        for start in range(first, last + 1):
            assert 0 <= at - start <= suffixes.REACH
            by_window.setdefault(data[start:start + suffixes.LENGTH].tobytes(), set()).add(at - start)
    assert all(len(v) == 1 for v in by_window.values())
    assert len(found.at) and sum(found.last - found.first + 1) == (123 - 49) + (70 - 49)


@pytest.mark.parametrize("hot_records", [0, 3])
def test_hot_anchors_change_no_result(spark, hot_records):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.dedupe(df, part_bytes=700, bucket_bytes=500, hot_records=hot_records).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute(rows)


def test_one_anchor_spreads_over_the_buckets():
    rng = random.Random(6)
    noise = lambda: "".join(rng.choice("abcdefgh") for _ in range(40))
    line = "a short line that every document has"
    bodies = [(noise() + line + noise()).encode() for _ in range(500)]
    n = len(bodies)
    table = pa.table({"part": [0] * n, "doc_id": list(range(n)), "row": list(range(n)), "body": pa.array(bodies, pa.binary())})
    part = suffixes.Part(table, suffixes._BITS.empty_table())
    repeated, numbers = part.shared_here(), part.numbers()
    (hot,) = suffixes.hot_anchors([part.hashes], [numbers], 100)
    assert hot.any() and not hot[numbers <= 100].any()
    records = part.records(repeated, hot)
    sizes = np.bincount(records.of_bucket(64), minlength=64)
    assert sizes.max() < 4 * sizes.mean()
    together = np.bincount(part.records(repeated, np.zeros_like(hot)).of_bucket(64), minlength=64)
    assert together.max() >= numbers[repeated].max() > 100  # all in one bucket if dealt by anchor
