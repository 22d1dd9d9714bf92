"""Operator 2: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

Test items come in blocks of about ``BLOCK_WORDS`` words, ``BLOCKS_AT_ONCE`` of which bound what a task holds; more items
mean more readings of the documents, never fewer items.

1. The occurrences of the items' word n-grams are counted in all documents. Every n-gram that occurs is a seed, so a copied
   run of ``SEED_WORDS`` words always holds one, however frequent the passage is and whatever other copies there are. (To
   take only the rarest of a few neighbours would let n-grams that an edit destroyed, which are rare or nowhere, displace
   those that were copied.)
2. A seed in a document places the item there. Places whose words cannot reach the score are left out, many items at a
   time; a phrase that many items share costs ``HITS`` places of memory at once, however often it occurs. Item and surrounding
   words are aligned locally (match 2, mismatch and gap -1), many at a time. The score is the alignment's share of the
   item's best possible score; from ``MIN_SCORE`` on, or from ``LONG_WORDS`` equal words' worth, and with at least ``MIN_WORDS``
   equal words, the passage counts as leaked. What lies left and right of it is aligned again, so every copy is found.

Both passes run where the documents are read; only counts are shuffled. Words are runs of letters, digits and
underscores without regard to case; in scripts written without blanks every character is a word. A null or empty text has
no leak. An item shorter than ``MIN_WORDS`` words is found only where it stands word for word; one shorter than
``SEED_WORDS`` (null and empty items too) cannot be told from chance, is not searched, and is listed by ``unsearched``. Equal items and
repeated rows are reported one by one. Texts are searched whole. Input columns called ``leaks`` are replaced; empty tables
give empty results.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from unitlife.llm.shared import LONG_TEXT, batched, positional, stored, values, words_of

SEED_WORDS = 3
MIN_SCORE, MIN_WORDS = 0.5, 8
LONG_WORDS = 50  # what counts as leaked of an item of any length
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS, BLOCKS_AT_ONCE = 1 << 18, 4
BATCH_CHARS = 1 << 19
CELLS = 1 << 21  # of one batch of alignments
HITS = 1 << 20  # places of items in a batch of texts that are looked at together

# Thai to Lao, Myanmar, Khmer, kana, ideographs
_BLOCKS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(r"\w+")
_UNSPACED = re.compile(f"[{_BLOCKS}]")
_MIXED = re.compile(rf"[{_BLOCKS}]|[^\W{_BLOCKS}]+")
_BITS = 21  # a word number

Leak = tuple[int, float, int, int, int]  # item, score, first word, past the last word, equal words
LEAK = StructType([StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("start", IntegerType()),
                   StructField("end", IntegerType()), StructField("equal", IntegerType())])
_ARROW_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()),
                                   ("end", pa.int32()), ("equal", pa.int32())]))


def pattern_of(text: str) -> re.Pattern:
    """What a word is in this text."""
    return _MIXED if not text.isascii() and _UNSPACED.search(text) else _WORD


def least_score(words: int) -> float:
    """What an alignment of an item of so many words must reach."""
    return MATCH * (words if words < MIN_WORDS else min(MIN_SCORE * words, LONG_WORDS))


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair of rows: score, and past the last cell in item and window.

    Rows are padded with negative numbers that differ between the sides. A step along the window is a running
    maximum, so each item word costs a few array operations over all pairs.
    """
    pairs, width = windows.shape
    ramp = np.arange(width, dtype=np.int32) * -GAP
    last = np.zeros((pairs, width + 1), np.int32)
    best = np.zeros(pairs, np.int32)
    item_end, window_end = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
    for i in range(items.shape[1]):
        h = last[:, :-1] + np.where(windows == items[:, i, None], MATCH, MISMATCH).astype(np.int32)
        np.maximum(h, last[:, 1:] + GAP, out=h)
        np.maximum(h, 0, out=h)
        h = np.maximum.accumulate(h + ramp, axis=1) - ramp
        top = h.max(1)
        better = top > best
        if better.any():
            best[better] = top[better]
            item_end[better] = i + 1
            window_end[better] = h[better].argmax(1) + 1
        last[:, 1:] = h
    return best, item_end, window_end


def _padded(rows: Sequence[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int32)
    for into, row in zip(out, rows, strict=True):
        into[:len(row)] = row
    return out


def _equal_words(item: np.ndarray, window: np.ndarray) -> int:
    """Words that both passages hold, each as often as in the poorer one."""
    a, n = np.unique(item, return_counts=True)
    b, m = np.unique(window, return_counts=True)
    _, i, j = np.intersect1d(a, b, return_indices=True)
    return int(np.minimum(n[i], m[j])[a[i] > 0].sum())


def keys_of(numbers: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of word numbers; -1 where a word is unknown (0)."""
    n = max(len(numbers) - SEED_WORDS + 1, 0)
    key, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(SEED_WORDS):
        part = numbers[k:n + k]
        key = key << _BITS | part
        known &= part > 0
    return np.where(known, key, -1)


@dataclass
class Block:
    """Test items as word numbers, and the sorted keys of all their n-grams."""

    ids: list[int]
    items: list[np.ndarray]
    numbers: dict[str, int]
    grams: np.ndarray
    seeds: np.ndarray | None = None  # sorted keys; places in the same order
    firsts: np.ndarray | None = None
    places: np.ndarray | None = None  # rows of item, offset
    lengths: np.ndarray | None = None  # words of each item, and how many of them a leak must share
    needs: np.ndarray | None = None

    @staticmethod
    def of(rows: Sequence[tuple[int, str]]) -> Block:
        numbers: dict[str, int] = {}
        ids, items = [], []
        for item_id, text in rows:
            words = [w.lower() for w in pattern_of(text or "").findall(text or "")]
            if len(words) >= SEED_WORDS:
                ids.append(item_id)
                items.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64))
        grams = [keys_of(x) for x in items]
        return Block(ids, items, numbers, np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int64))

    def choose(self, counts: np.ndarray) -> Block:
        """Keep every n-gram that occurs as a seed."""
        grams = [keys_of(item) for item in self.items]
        keys = np.concatenate(grams)
        places = np.array([(i, at) for i, one in enumerate(grams) for at in range(len(one))], np.int64).reshape(-1, 2)
        use = np.flatnonzero(counts[np.searchsorted(self.grams, keys)])
        use = use[np.argsort(keys[use], kind="stable")]
        self.seeds, times = np.unique(keys[use], return_counts=True)
        self.firsts = np.concatenate([[0], np.cumsum(times)])
        self.places = places[use]
        self.lengths = np.array([len(item) for item in self.items], np.int64)
        self.needs = np.array([max(least_score(n) / MATCH, min(MIN_WORDS, n)) for n in self.lengths.tolist()])
        return self

    def read(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of some texts, a 0 after each, and where each text begins."""
        get, starts = self.numbers.get, []
        words = array("q") if any(len(t) >= LONG_TEXT for t in texts) else []  # a long text's words as plain numbers
        for text in texts:
            starts.append(len(words))
            if len(text) >= LONG_TEXT:
                words.extend(get(w) or get(w.lower(), 0) for w in words_of(pattern_of(text), text))
            else:
                words.extend([get(w) or get(w.lower(), 0) for w in words_of(pattern_of(text), text)])
            words.append(0)
        return np.array(words, np.int64), np.array(starts, np.int64)

    def count(self, texts: Sequence[str]) -> np.ndarray:
        keys = keys_of(self.read(texts)[0])
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        return np.bincount(at[self.grams[at] == keys], minlength=len(self.grams))

    def candidates(self, numbers: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Regions to align, as columns: text, item, first and past the last word. Seeds of an item that place it less
        than its slack apart share a region. Every array tells of other items, from about ``HITS`` places."""
        if not len(self.seeds):
            return
        keys = keys_of(numbers)
        at = np.minimum(np.searchsorted(self.seeds, keys), len(self.seeds) - 1)
        where = np.flatnonzero(self.seeds[at] == keys)
        if not len(where):
            return
        seed, count = at[where], len(self.items)
        first, last = self.firsts[seed], self.firsts[seed + 1]
        if (last - first).sum() <= HITS:
            yield self._regions(numbers, starts, where, first, last)
            return
        times = np.diff(self.firsts)
        hits = np.bincount(self.places[:, 0], np.repeat(np.bincount(seed, minlength=len(times)), times), minlength=count)
        cut = np.flatnonzero(np.diff((np.cumsum(hits) // HITS), prepend=-1, append=-1))  # items that begin a range
        by_item = np.repeat(np.arange(len(times)) * count, times) + self.places[:, 0]
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            first, last = np.searchsorted(by_item, seed * count + low), np.searchsorted(by_item, seed * count + high)
            some = last > first
            if some.any():
                yield self._regions(numbers, starts, where[some], first[some], last[some])

    def _regions(self, numbers: np.ndarray, starts: np.ndarray, where: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
        times = to - from_
        flat = np.repeat(from_ - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, offset = self.places[flat].T
        begin = np.repeat(where, times) - offset
        text = np.searchsorted(starts, np.repeat(where, times), side="right") - 1
        order = np.lexsort((begin, item, text))
        item, begin, text = item[order], begin[order], text[order]
        length = self.lengths[item]
        slack = length // 4 + 4
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (begin[1:] - begin[:-1] > slack[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item)) - 1
        ends = np.append(starts[1:], len(numbers)) - 1
        low = np.maximum(begin[first] - slack[first], starts[text[first]])
        high = np.minimum(begin[last] + length[last] + slack[last], ends[text[first]])
        return np.stack([text[first], item[first], low, high], 1)

    def hopeful(self, numbers: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The regions that share enough words with their item to reach the score at all. Items in one region are
        looked at together."""
        found = found[np.lexsort((found[:, 3], found[:, 2]))]
        enough = np.zeros(len(found), bool)
        present = np.zeros(len(self.numbers) + 1, bool)
        new = np.flatnonzero(np.any(np.diff(found[:, 2:], axis=0, prepend=-1) != 0, axis=1))
        for first, last in zip(new, np.append(new[1:], len(found)), strict=True):
            window = numbers[found[first, 2]:found[first, 3]]
            present[window] = True
            present[0] = False
            for at in range(first, last, HITS // 16):
                items = found[at:min(at + HITS // 16, last), 1]
                equal = np.add.reduceat(present[np.concatenate([self.items[i] for i in items])],
                                        np.cumsum(self.lengths[items]) - self.lengths[items], dtype=np.int64)
                enough[at:at + len(items)] = equal >= self.needs[items]
            present[window] = False
        return found[enough]

    def leaks(self, texts: Sequence[str]) -> list[list[Leak]]:
        numbers, starts = self.read(texts)
        out: list[list[tuple[int, Leak]]] = [[] for _ in texts]
        for regions in self.candidates(numbers, starts):
            while len(regions):
                regions = self._aligned(numbers, starts, self.hopeful(numbers, regions), out)
        return [_outermost(rows) for rows in out]

    def _aligned(self, numbers: np.ndarray, starts: np.ndarray, regions: np.ndarray, out: list[list[tuple[int, Leak]]]) -> np.ndarray:
        """Adds the best alignment of each region to ``out``; returns what is left of the regions around them."""
        order = np.lexsort((regions[:, 3] - regions[:, 2], self.lengths[regions[:, 1]]))
        rest = []
        cells = lambda c: len(self.items[c[1]]) * (c[3] - c[2])
        for some in batched(map(tuple, regions[order].tolist()), cells, CELLS):
            items = [self.items[i] for _, i, _, _ in some]
            windows = [numbers[low:high] for _, _, low, high in some]
            best, item_end, window_end = align(_padded(items, -1), _padded(windows, -2))
            good = [k for k in range(len(some)) if best[k] >= least_score(len(items[k]))]
            if not good:
                continue
            # the same alignment read backwards ends where it begins
            _, item_back, window_back = align(_padded([items[k][:item_end[k]][::-1] for k in good], -1),
                                              _padded([windows[k][:window_end[k]][::-1] for k in good], -2))
            for k, ib, wb in zip(good, item_back, window_back, strict=True):
                text, item, low, high = some[k]
                end = low + int(window_end[k])
                start = end - int(wb)
                equal = _equal_words(items[k][item_end[k] - ib:item_end[k]], numbers[start:end])
                if equal >= min(MIN_WORDS, len(items[k])):
                    begin = int(starts[text])
                    out[text].append((item, (self.ids[item], float(best[k]) / (MATCH * len(items[k])), start - begin, end - begin, equal)))
                rest += [(text, item, low, start), (text, item, end, high)]
        return np.array([r for r in rest if r[3] - r[2] >= SEED_WORDS], np.int64).reshape(-1, 4)


def _outermost(rows: list[tuple[int, Leak]]) -> list[Leak]:
    """The passages of a text that do not lie in a longer one of the same item, in text order."""
    kept, item, reach = [], None, -1
    for i, leak in sorted(rows, key=lambda r: (r[0], r[1][2], -r[1][3])):
        if i != item:
            item, reach = i, -1
        if leak[3] > reach:
            kept.append(leak)
            reach = leak[3]
    return sorted(kept, key=lambda r: (r[2], r[3], r[0] is not None, r[0]))


def _counts(documents: DataFrame, text: str, block: Block) -> np.ndarray:
    shared = documents.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.grams), np.int64)
        for batch in batches:
            for some in batched((t for t in values(batch.column(0)) if t), len, BATCH_CHARS):
                total += shared.value.count(some)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    sums = (documents.select(F.col(text).cast("string")).mapInArrow(count, "gram bigint, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")).toArrow())  # one row per n-gram of the block
    out = np.zeros(len(block.grams), np.int64)
    out[sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return out


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
           block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    items = benchmark.filter(F.col(text).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    unspaced = (F.octet_length("text") - F.length("text")) / 2  # an ideograph has three bytes
    words = int(items.agg(F.sum(F.size(F.split("text", r"\W+")) + unspaced)).first()[0] or 0)
    parts = max(-(-words // block_words), 1)
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        block = Block.of([tuple(r) for r in rows])
        if block.items:
            yield block


def unsearched(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, text`` of the items that are too short to be searched."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t or "" for t in values(batch.column(1)))
            yield batch.filter(pa.array([len(pattern_of(t).findall(t)) < SEED_WORDS for t in texts], pa.bool_()))

    return benchmark.select(F.col(item_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(few, "item_id bigint, text string")


def _searched(documents: DataFrame, text: str, names: Sequence[str], some: Sequence[Block]) -> DataFrame:
    """``names`` and the ``leaks`` of a few blocks, found where the documents are read."""
    shared = [documents.sparkSession.sparkContext.broadcast(block) for block in some]
    source = positional(documents.select(F.col(text).cast("string"), *names))
    schema = StructType([*(StructField(c, f.dataType) for c, f in zip(names, source.schema.fields[1:], strict=True)),
                         StructField("leaks", ArrayType(LEAK))])
    fields = LEAK.fieldNames()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            for texts in batched((t or "" for t in values(batch.column(0))), len, BATCH_CHARS):
                rows: list[list[dict]] = [[] for _ in texts]
                for block in shared:
                    for row, leaks in zip(rows, block.value.leaks(texts), strict=True):
                        row += [dict(zip(fields, leak, strict=True)) for leak in leaks]
                found += rows
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, _ARROW_LEAKS)], names=schema.names)

    return source.mapInArrow(scan, schema)


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: Sequence[str] | None = None,
         block_words: int = BLOCK_WORDS, blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """``documents`` (its columns ``keep``, or all) with ``leaks``: item, score, the passage as word numbers (end
    exclusive) and its number of equal words.

    If the benchmark has more blocks than a task should hold, each few of them are a search of their own, whose finds
    are stored by text digest and joined at the end.
    """
    names = [c for c in (documents.columns if keep is None else keep) if c != "leaks"]
    ready = (block.choose(_counts(documents, text, block)) for block in blocks(benchmark, block_words=block_words))
    few, more = list(islice(ready, blocks_at_once)), list(islice(ready, 1))
    if not more:
        return _searched(documents, text, names, few)
    node = F.md5(F.col(text).cast("string"))
    texts = documents.select(F.col(text).alias("t"), node.alias("node"))
    finds = []
    while few:
        finds.append(stored(_searched(texts, "t", ["node"], few).filter(F.size("leaks") > 0), "leaks"))
        few, more = [*more, *islice(ready, blocks_at_once - len(more))], []
    every = reduce(DataFrame.unionByName, finds).select("node", F.explode("leaks").alias("leak")).distinct()
    by_text = every.groupBy(F.col("node").alias("digest")).agg(F.array_sort(F.collect_list("leak")).alias("found"))
    flat = positional(documents.select(*names, node))
    joined = flat.join(by_text, F.col(flat.columns[-1]) == F.col("digest"), "left")
    return joined.select(*flat.columns[:-1], F.coalesce("found", F.array().cast(ArrayType(LEAK)))).toDF(*names, "leaks")
