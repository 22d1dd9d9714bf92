"""Operator 4: n-gram Jaccard self-join by MinHash banding.

1. Equal texts become one node. Each text's word 5-grams give a MinHash signature, cut into bands; ``bands_for``
   chooses bands and rows for the target recall at the threshold.
2. Band hashes are shuffled. A bucket names its least node as leader; the distinct (leader, node) rows put every two
   nodes that share a bucket into a common leader's group.
3. Groups are verified on full n-gram sets. A group is cut into blocks, and each pair of blocks is one piece of
   work of bounded size; all pairs are compared inside it, but it emits only a row per linked node: its
   number of links and the least node it hangs together with. A pair met in several groups counts in the
   least common leader's.
4. Those rows are the links whose connected components are the classes.

Words are runs of letters, digits and underscores without regard to case; a text of one to four words has one n-gram,
all its words. Texts without words are linked to nothing, but equal ones are copies. A null text is alone. Class ids
are the least doc id of a class (nulls aside); repeated rows are copies. Texts are read whole; other columns play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlife.llm.components import components
from unitlife.llm.shared import batched, positional, stored, values, words_of

WORDS = 5
THRESHOLD = (4, 5)
RECALL = 0.9995
MAX_HASHES = 128
BLOCK_NODES, BLOCK_GRAMS = 512, 1 << 21
BATCH_CHARS = 1 << 19
COLUMNS = 1 << 13  # n-grams of one multiplication

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def bands_for(threshold: float, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest rows whose bands, as many as the recall at the threshold takes, fit into
    ``hashes``. Longer rows mean fewer unlike pairs in a bucket."""
    fitting = [(ceil(log(1 - recall) / log(1 - threshold**rows)), rows) for rows in range(1, 17)]
    return max((x for x in fitting if x[0] * x[1] <= hashes), key=lambda x: x[1])


class _Words(dict):
    """Hashes of words, without regard to case; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "replace"))
        return value


_words = _Words()


def ngrams(text: str, words: int = WORDS) -> np.ndarray:
    """The text's distinct n-grams as sorted 64-bit hashes."""
    found = words_of(_WORD, text)
    code = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found) if isinstance(found, list) else -1)
    if not len(code):
        return code
    n = max(len(code) - words + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(code))):
        out = (out ^ code[k:n + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.factors = np.random.default_rng(20).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of band hashes for each set (which must not be empty)."""
        starts = np.cumsum([0, *map(len, sets)])[:-1]
        every = np.concatenate(sets)
        out = np.empty((len(sets), self.bands), np.uint64)
        for band in range(self.bands):
            h = np.full(len(sets), band + 1, np.uint64)
            for row in range(self.rows):
                h = (h ^ np.minimum.reduceat(every * self.factors[band * self.rows + row], starts)) * _MIX
                h ^= h >> np.uint64(31)
            out[:, band] = h
        return out


def _signed(docs: DataFrame, key: str, text: str, signer: Signer, words: int) -> DataFrame:
    """``key, node, size, bands`` per row that has a text; the node is the text's MD5."""
    source = docs.filter(F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("t"), F.col(key).cast("bigint").alias("key"),
        F.unhex(F.md5(F.col(text).cast("string"))).alias("node"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bands = [], []
            for some in batched(values(batch.column(0)), len, BATCH_CHARS):
                sets = [ngrams(t, words) for t in some]
                full = [s for s in sets if len(s)]
                rows = iter(signer.bands_of(full).view(np.int64)) if full else iter(())
                sizes += map(len, sets)
                bands += [next(rows) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["key", "node", "size", "bands"])

    return source.mapInArrow(sign, "key bigint, node binary, size bigint, bands array<bigint>")


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Which sets of two lists reach the threshold; exact, by products of 0/1 matrices over shared n-grams."""
    sizes = np.array([*map(len, left), *map(len, right)])
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    grams, number, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    use = shared[number]
    at, owner = column[number[use]], owner[use]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(left), len(right)), np.float64)
    total = int(shared.sum())
    for start in range(0, total, COLUMNS):
        low, high = np.searchsorted(at, (start, start + COLUMNS))
        cells = np.zeros((len(sizes), min(COLUMNS, total - start)), np.float32)
        cells[owner[low:high], at[low:high] - start] = 1
        common += cells[:len(left)] @ cells[len(left):].T
    num, den = threshold
    return (num + den) * common >= num * (sizes[:len(left), None] + sizes[None, len(left):]) - 1e-6


def _work(rows: list[dict], threshold: tuple[int, int]) -> Iterator[tuple[bytes, bytes, int]]:
    """Node, least node connected with it, number of links: for the linked nodes of one pair of blocks of a group."""
    rows.sort(key=lambda r: (r["block"], r["node"]))
    leader, low, high = rows[0]["leader"], rows[0]["low"], rows[0]["high"]
    left = [r for r in rows if r["block"] == low]
    right = left if low == high else [r for r in rows if r["block"] == high]
    if not left or not right:
        return
    sets = lambda side: [np.frombuffer(r["grams"], np.uint64) for r in side]
    linked = similar(sets(left), sets(right), threshold)
    if low == high:
        linked = np.triu(linked, 1)
    nodes = left if low == high else left + right
    shift = 0 if low == high else len(left)
    earlier = [{x for x in r["leaders"] if x < leader} for r in nodes]
    a, b = np.nonzero(linked)
    b = b + shift
    counts = np.zeros(len(nodes), np.int64)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if earlier[i] and earlier[j] and not earlier[i].isdisjoint(earlier[j]):
            continue  # a smaller common leader's group has this pair
        counts[i] += 1
        counts[j] += 1
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
    least: dict[int, bytes] = {}
    for i in np.flatnonzero(counts):
        r = find(int(i))
        least[r] = min(least.get(r, nodes[i]["node"]), nodes[i]["node"])
    for i in np.flatnonzero(counts):
        yield nodes[i]["node"], least[find(int(i))], int(counts[i])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys in sorted batches."""
    held, of = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != of:
                yield held
                held = []
            of = key
            held.append(row)
    if held:
        yield held


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD,
            words: int = WORDS, recall: float = RECALL, block_nodes: int = BLOCK_NODES,
            block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``key, node, class_id, class_node, copy_of, n_copies, n_links`` for every row that has a text.

    ``copy_of`` is the least key among equal texts (``n_copies`` of them), ``n_links`` the number of other texts that
    reach the threshold, ``class_id`` the least key of the connected component and ``class_node`` that key's node.
    """
    signer = Signer(*bands_for(threshold[0] / threshold[1], recall))
    signed = stored(_signed(docs, key, text, signer, words), "signed")
    nodes = signed.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"),
                                       F.min("key").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    grouped = stored(banded.join(leaders, "bucket").select("leader", "node").distinct(), "grouped")

    own = (  # a leader per band at most; with the key that stands for the text, so copies do not meet in one task
        grouped.groupBy("node").agg(F.collect_list("leader").alias("leaders"))
        .join(nodes.select("node", "copy_of"), "node").withColumnRenamed("node", "of")
    )
    sizes = nodes.select("node", "size")
    blocks = (
        grouped.join(sizes, "node").groupBy("leader")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
        .select("leader", F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("grams") / block_grams))
                .cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = (
        grouped.join(blocks, "leader").withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leader", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    texts = (
        docs.filter(F.col(text).isNotNull())
        .select(F.unhex(F.md5(F.col(text).cast("string"))).alias("node"), F.col(text).cast("string").alias("t"),
                F.col(key).cast("bigint").alias("key"))
        .join(own, (F.col("node") == F.col("of")) & F.col("key").eqNullSafe(F.col("copy_of")))
        .groupBy("node").agg(F.first("t").alias("t"), F.first("leaders").alias("leaders"))
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                grams = [ngrams(t, words).tobytes() for t in values(part.column(0))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(grams, pa.binary())],
                                                 names=["node", "leaders", "grams"])

    full = stored(texts.select("t", "node", "leaders").mapInArrow(
        sets, "node binary, leaders array<binary>, grams binary"), "grams")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes, int]] = []
        for group in _groups(batches, ("leader", "low", "high")):
            out += _work(group, threshold)
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    work = placed.join(full, "node").repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high")
    links = stored(work.mapInArrow(verify, "a binary, b binary, n bigint"), "verified")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    roots = components(links.select("a", "b"))
    placed_nodes = (
        nodes.select("node", "copy_of", "n_copies").join(roots, "node", "left").join(counts, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    by_key = F.struct(F.col("copy_of").isNull(), "copy_of", "node")
    least = placed_nodes.groupBy("root").agg(
        F.min("copy_of").alias("class_id"), F.min_by("node", by_key).alias("class_node"))
    return signed.select("key", "node").join(
        placed_nodes.join(least, "root").select(
            "node", "class_id", "class_node", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "node")


def _rows(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                                      names=["a", "b", "n"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, the one of the least key; rows without a text stay."""
    found = classes(docs, key, text, **options)
    kept = (found.filter(F.col("node") == F.col("class_node"))
            .select("node", "copy_of").distinct())
    flat = positional(docs)
    place_of = dict(zip(docs.columns, flat.columns, strict=True))
    body, number = F.col(place_of[text]), F.col(place_of[key]).cast("bigint")
    one = (
        flat.withColumn("own", F.unhex(F.md5(body.cast("string"))))
        .join(kept, (F.col("own") == F.col("node")) & number.eqNullSafe(F.col("copy_of")))
        .dropDuplicates(["own"]).select(*flat.columns)
    )
    return one.union(flat.filter(body.isNull())).toDF(*docs.columns)
