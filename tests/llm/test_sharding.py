"""The permutation and the numbering."""

import os
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from unitlife.llm import queries, sharding

SMALL = "/root/testdata/sf0.001"


def spark_hash(*values):
    """Of (format, value) pairs, as the SQL function of the same name; None changes nothing."""
    h = 42
    for form, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if form == "s" else struct.pack(form, v), h)
    return h - (1 << 64) if h >> 63 else h


def walked(number, rows, seed=0):
    """The Feistel network and the cycle walk in plain arithmetic."""
    a, b = sharding.sides(rows)
    while True:
        left, right = divmod(number, b)
        for i in range(sharding.ROUNDS):
            noise = spark_hash(("<q", seed), ("<i", i), ("<q", left if i % 2 else right))
            if i % 2:
                right = (right + noise % b) % b
            else:
                left = (left + noise % a) % a
        number = left * b + right
        if number < rows:
            return number


@pytest.mark.parametrize("rows, seed", [(1, 0), (2, 1), (7, 3), (97, 0), (1000, 5), (4099, 2)])
def test_permutation_equals_plain_arithmetic(spark, rows, seed):
    got = spark.range(rows).select("id", sharding.permuted(F.col("id"), rows, seed).alias("p")).collect()
    assert all(r.p == walked(r.id, rows, seed) for r in got)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_query_equals_plain_arithmetic(spark):
    """Every document's number, shard, slot, size and checksum, worked out row by row."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = [(doc, len(text) + 1, zlib.crc32(text)) for doc, text in texts.items()]

    def order(row):
        values = [("<q", v) for v in row]
        h = spark_hash(*values)
        return h % sharding.BUCKETS, h, spark_hash(("<i", 1), *values)

    want = []
    for number, row in enumerate(sorted(rows, key=order)):
        place = walked(number, len(rows))
        want.append((*row, "rows", place % 8, place // 8))
    got = queries.op5_feistel_shards(spark, SMALL).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.slot) for r in got) == sorted(want)


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 7, 97, 1000, 4099])
def test_permutation_and_its_inverse(spark, rows):
    n = spark.range(rows).select("id", sharding.permuted(F.col("id"), rows, 3).alias("p"))
    back = n.select("id", "p", sharding.permuted(F.col("p"), rows, 3, inverse=True).alias("b")).collect()
    assert sorted(r.p for r in back) == list(range(rows)) and all(r.b == r.id for r in back)


def test_sides_leave_few_numbers_outside():
    for rows in (10, 997, 256_411, 10**9 + 7, 3 * 10**10 + 1):
        a, b = sharding.sides(rows)
        assert a > 1 and 0 <= a * b - rows < 40


def rows():
    return [(i, f"t{i}", i % 3) for i in range(50)] + [(1, "t1", 1)] * 30 + [(None, None, None)] * 20


def test_shards(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, shard long")
    out = sharding.shard(df, 8, seed=5)
    assert out.columns == ["doc_id", "text", "row_number", "shard", "slot"]
    got = out.collect()
    assert sorted(r.row_number for r in got) == list(range(100))
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b, _ in rows())
    found = out.select("row_number", sharding.row_at(F.col("shard"), F.col("slot"), 100, 8, 5).alias("n")).collect()
    assert all(r.row_number == r.n for r in found)


def test_independent_of_partitions_and_pieces(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, other long")
    place = lambda d: sorted(map(str, d.collect()))
    assert place(sharding.shard(df.repartition(7), 4)) == place(sharding.shard(df.coalesce(1), 4))
    assert place(sharding.numbered(df, piece=3)) == place(sharding.numbered(df))
    order = [r.doc_id for r in sharding.shard(df, 1).orderBy("slot").collect()]
    assert order != [r.doc_id for r in sharding.shard(df, 1, seed=9).orderBy("slot").collect()]


def test_no_rows(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, slot long"), 8).collect() == []
