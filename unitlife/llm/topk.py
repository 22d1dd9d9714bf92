"""Operator 10: exact top-k inner products by MaxScore over sharded postings.

A vector's components become integers; each dimension is a query term whose posting list holds the
component of every row of a shard, in id order, with the list's least and greatest value. For one
query, a term's contribution lies between two bounds that follow from these. Terms whose bounds are
so close together that all of them cannot lift a row over the current k-th score are
non-essential: the essential lists are traversed, and the others are probed, widest first, only for
the rows that are still competitive. Shard results are merged by score and id.

Candidates are dealt into shards by a hash of their id, queries into blocks, and every block meets
every shard once, packed into arrays. A task holds one shard and one block.

Rows without an id, and vectors that are null or hold a null or non-finite component take no part.
Shorter vectors count as filled up with zeros. Rows that share the query's id are its own rows;
repeated query rows count once per different vector. Ties go to the smaller id. An empty table or
query set gives an empty result. Other columns are not read. Components are longs; products that do not fit in one are summed as Python's
integers, and only a score beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 1 << 17
SHARD_CELLS = 1 << 24  # eight bytes each
BLOCK_ROWS = 1 << 10
STRIDE = 2048
EXACT = 1 << 53

FOUND = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, w)``: the usable vectors, as ``floor(scale * x)``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("bigint")).alias("w"))


def matrix(vectors, width: int) -> np.ndarray:
    """Rows by dimensions, short rows filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, w in zip(out, vectors, strict=True):
        row[:len(w)] = w
    return out


class Shard:
    """Posting lists (dimension by row) of rows in ascending id order, with their bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        lists = np.ascontiguousarray(rows[order].T)
        self.low, self.high = lists.min(1), lists.max(1)
        self.greatest = max(abs(int(self.low.min(initial=0))), abs(int(self.high.max(initial=0))))
        self.lists = lists

    def typed(self, q: np.ndarray) -> np.ndarray:
        """The lists in a type whose sums are exact for this query block: doubles, longs, or integers of any size."""
        most = self.greatest * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(len(self.low), 1)
        return self.lists.astype(np.float64 if most < EXACT else np.int64 if most < 1 << 62 else object)

    def top(self, q: np.ndarray, own: int, k: int, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of one query, best first."""
        kind = object if lists.dtype == object else np.int64
        a, b = q.astype(kind) * self.low, q.astype(kind) * self.high
        least, most = np.minimum(a, b), np.maximum(a, b)
        by_range = np.argsort(most - least, kind="stable")
        reach = np.cumsum((most - least)[by_range])
        floor_all, weights = least.sum(), q.astype(lists.dtype)
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        threshold, split, essential, probes, rest = None, -1, None, (), 0
        for start in range(0, len(self.ids), STRIDE):
            at = slice(start, start + STRIDE)
            if threshold is not None:
                # non-essential: even all their ranges together do not reach the threshold
                now = int(np.searchsorted(reach, threshold - floor_all, side="right"))
                if now != split:
                    split = now
                    essential = np.sort(by_range[split:])
                    heads = weights[essential]
                    probes = by_range[:split][::-1]
                    rest = most[probes].sum()
                rows = np.arange(start, min(start + STRIDE, len(self.ids)))
                partial = heads @ lists[essential, at]
                open_ = rest
                keep = partial + open_ > threshold
                rows, partial = rows[keep], partial[keep]
                for d in probes:
                    if not len(rows):
                        break
                    open_ -= most[d]
                    partial = partial + weights[d] * lists[d, rows]
                    keep = partial + open_ > threshold
                    if not keep.all():
                        rows, partial = rows[keep], partial[keep]
            else:
                rows = np.arange(start, min(start + STRIDE, len(self.ids)))
                partial = weights @ lists[:, at]
            keep = self.ids[rows] != own
            ids = np.concatenate([ids, self.ids[rows[keep]]])
            scores = np.concatenate([scores, partial[keep].astype(np.int64)])
            if len(ids) > k:
                best = np.argsort(-scores, kind="stable")[:k]  # ids ascend within equal scores
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                threshold = scores.min()
        best = np.lexsort((ids, -scores))
        return ids[best], scores[best]


def _packed(df: DataFrame, group: str, width: int, key: bool) -> DataFrame:
    """One row per group: its ids (and keys) and component matrix as bytes."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            group: [pdf[group].iloc[0]],
            "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "keys": [pdf["query_key"].to_numpy(np.int64).tobytes() if key else b""],
            "cells": [matrix(pdf["w"], width).tobytes()],
        })
    return df.groupBy(group).applyInPandas(pack, f"{group} int, ids binary, keys binary, cells binary")


def _dealt(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def search(queries: DataFrame, candidates: DataFrame, k: int, shard_rows: int = SHARD_ROWS,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of every query.

    Both inputs come from ``integers``.
    """
    spark = queries.sparkSession
    size = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w")).alias("width")).first()
    asked = queries.select("vec_id", "w").distinct().withColumn("query_key", F.xxhash64("w"))
    about = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w")).alias("width")).first()
    width = max(size["width"] or 0, about["width"] or 0)
    shard_rows = max(min(shard_rows, SHARD_CELLS // max(width, 1)), 1)
    block_rows = max(min(block_rows, SHARD_CELLS // max(width, 1)), 1)
    shards = max(-(-size["n"] // shard_rows), 2 * spark.sparkContext.defaultParallelism)
    blocks = max(-(-about["n"] // block_rows), 1)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                cells = np.frombuffer(row.cells, np.int64).reshape(-1, width)
                shard = Shard(np.frombuffer(row.ids, np.int64), cells)
                asked_rows = np.frombuffer(row.q_cells, np.int64).reshape(-1, width)
                lists = shard.typed(asked_rows)
                out = []
                for q, own, key in zip(asked_rows, np.frombuffer(row.q_ids, np.int64),
                                       np.frombuffer(row.q_keys, np.int64), strict=True):
                    ids, scores = shard.top(q, int(own), k, lists)
                    out.append(pd.DataFrame({"query_id": own, "query_key": key, "vec_id": ids, "score": scores}))
                if out:
                    yield pd.concat(out)

    lists = _packed(candidates.withColumn("shard", _dealt(F.col("vec_id"), shards)), "shard", width, False)
    ask = (
        _packed(asked.withColumn("block", _dealt(F.col("vec_id"), blocks)), "block", width, True)
        .select("block", F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("cells").alias("q_cells"),
                F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    )
    found = ask.join(lists, "shard").select("q_ids", "q_keys", "q_cells", "ids", "cells").mapInPandas(meet, FOUND)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
