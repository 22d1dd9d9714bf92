"""Operator 8: removal of repeated byte strings by blockwise suffix sorting over a cover sample.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller id. That is decided
for every suffix by its first ``LENGTH`` bytes, its window.

* Cover sample. Each window holds one sampled position, an anchor: the least hash among the ``ANCHOR``-byte strings in
  it, leftmost first. Equal windows hold it at the same distance, so two suffixes that tie can be compared by the
  bytes before the anchor, the anchor's rank and the bytes after it. (A cover of fixed positions, periodic in the
  document, would do the same with three times the anchors, each with twice the neighbourhood.)
* Ranks. Anchor hashes meet in hash ranges. An anchor that one document alone has cannot lie in a repeated window;
  its windows end here.
* Suffix buckets. What is left is shuffled by anchor: a record holds the anchor with the bytes around it that its
  windows can reach. A bucket ranks its anchors once and sorts its suffixes one distance at a time: by the bytes before the
  anchor, by the anchor's rank, by the bytes after it. Equal windows come to lie side by side, and each learns whether a
  smaller document has it too. Hashes only deal the work out; what decides are the bytes and the ranks.
* Hot anchors. Parts count their records of each anchor with its hash. An anchor of more than ``hot_records`` in all (a short
  line between ever different neighbours) is dealt by window instead: a record per distance, dealt by a hash of its window's
  bytes, so that equal windows still meet and the others spread over all buckets.

Documents are dealt into parts of about ``part_bytes``; a part is read whole, in the same order, in each of the three
steps, and answers come back to it as bits in the order of its sorted anchors or records. A part sends each anchor
and each distinct record once, so a passage shared by any number of documents weighs no more than the number of
parts, and one with ever different neighbours spreads as a hot anchor. Later copies of a whole text need no sorting: they go entirely, unless shorter than a window.

A null text is empty. Rows without an id neither lose bytes nor make others lose some; rows with equal ids do not
affect each other. Repeated rows get equal answers. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlife.llm.shared import batched

LENGTH, ANCHOR = 50, 32
REACH = LENGTH - ANCHOR  # the furthest that an anchor lies from its window's start
AROUND = ANCHOR + 2 * REACH
PART_BYTES = 1 << 21
BUCKET_BYTES = 1 << 23
HOT_RECORDS = 1 << 14
BATCH_BYTES = 1 << 18

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)  # fixed values: odd mixing constants
_MIX = np.uint64(0xBF58476D1CE4E5B9)

HASHES, MASKS, LATER = 0, 1, 2  # kinds of answers to a part

RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + LENGTH + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + LENGTH,), "<u8", padded.data, 0, (1,)).copy()


@dataclass
class Anchors:
    """Anchors of some documents: position, first and last window start, hash and document, by position."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def anchors(data: np.ndarray, starts: np.ndarray) -> Anchors:
    """Anchors of the documents that begin at ``starts`` (and end where the next begins) in ``data``."""
    n = len(data)
    w = _words(data)
    h = w[:n] * _FACTORS[0]
    for k in range(1, ANCHOR // 8):
        h += w[8 * k:8 * k + n] * _FACTORS[k]
        h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(32)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := REACH + 1 - width:
        least = np.minimum(least[:-rest], least[rest:])
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    windows = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(starts)), windows)
    begin = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    at = (least[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    lead = np.flatnonzero(new)
    tail = np.append(lead[1:], len(at)) - 1 if len(lead) else lead
    spread = h[at[lead]] * _FACTORS[4]  # least hashes are small; spread them over all ranges again
    spread ^= spread >> np.uint64(32)
    return Anchors(at[lead], begin[lead], begin[tail], spread * _FACTORS[5], owner[lead])


def part_anchors(data: np.ndarray, starts: np.ndarray) -> Anchors:
    """The same, some documents at a time; a long document in stretches whose window starts do not overlap."""
    ends = np.append(starts[1:], len(data))[:len(starts)]
    stretches = (
        (doc, at, min(end, at + BATCH_BYTES + LENGTH - 1))
        for doc, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))
        for at in range(start, max(end - LENGTH + 1, start), BATCH_BYTES))
    found = []
    for some in batched(stretches, lambda s: s[2] - s[1], BATCH_BYTES):
        bytes_ = np.concatenate([data[low:high] for _, low, high in some])
        sizes = np.array([high - low for _, low, high in some])
        begins = np.cumsum(sizes) - sizes
        a = anchors(bytes_, begins)
        shift = (np.array([low for _, low, _ in some]) - begins)[a.doc]
        docs = np.array([doc for doc, _, _ in some], np.int32)[a.doc]
        found.append((a.at + shift, a.first + shift, a.last + shift, a.hash, docs))
    if not found:
        none = np.empty(0, np.int64)
        return Anchors(none, none, none, none.view(np.uint64), none)
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))


class Part:
    """The documents of one part, in a fixed order. Those with an id that are the first with their text are sorted;
    ``told`` names the others with an id, the later copies."""

    def __init__(self, table: pa.Table, told: pa.Table):
        ids, row = table["doc_id"].fill_null(0).to_numpy(), table["row"].to_numpy()
        order = np.lexsort((row, ids))
        self.table = table.take(pa.array(order))
        later = {(int(i), int(r)) for i, r in np.frombuffer(
            b"".join(told.filter(pc.equal(told["kind"], LATER))["bits"].to_pylist()), ">i8").reshape(-1, 2)}
        known = self.table["doc_id"].is_valid().to_numpy()
        self.copy = np.array([(i, r) in later for i, r in zip(ids[order].tolist(), row[order].tolist(), strict=True)], bool) & known
        self.first = known & ~self.copy
        chosen = np.flatnonzero(self.first)
        bodies = self.table["body"].take(pa.array(chosen))
        sizes = np.array([b.as_buffer().size for chunk in bodies.chunks for b in chunk], np.int64)
        self.data = np.frombuffer(b"".join(b.as_buffer() for chunk in bodies.chunks for b in chunk), np.uint8)
        self.starts = np.cumsum(sizes) - sizes
        self.ends = self.starts + sizes
        self.ids = self.table["doc_id"].fill_null(0).to_numpy()[chosen]
        self.anchors = part_anchors(self.data, self.starts)
        self.hashes, self.number = np.unique(self.anchors.hash, return_inverse=True)

    def slices(self, buckets: int) -> np.ndarray:
        """Borders of the hash ranges in the sorted hashes."""
        return np.searchsorted(self.hashes, _borders(buckets))

    def shared_here(self) -> np.ndarray:
        """Which hashes several ids of this part have."""
        ids = self.ids[self.anchors.doc]
        low, high = np.full(len(self.hashes), np.iinfo(np.int64).max), np.full(len(self.hashes), np.iinfo(np.int64).min)
        np.minimum.at(low, self.number, ids)
        np.maximum.at(high, self.number, ids)
        return low != high

    def numbers(self) -> np.ndarray:
        """How many records each hash would send."""
        times = np.bincount(self.number, minlength=len(self.hashes))
        use = np.flatnonzero(times[self.number] > 1)
        _, first, _ = _distinct(self._neighbourhoods(use))
        distinct = np.bincount(self.number[use[first]], minlength=len(self.hashes))
        return np.where(times > 1, distinct, times)

    def _neighbourhoods(self, use: np.ndarray) -> np.ndarray:
        """Nearest and furthest distance, and the bytes around, of some anchors."""
        a = self.anchors
        at, doc = a.at[use], a.doc[use]
        padded = np.zeros(len(self.data) + 2 * AROUND, np.uint8)
        padded[AROUND:AROUND + len(self.data)] = self.data
        cells = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[at - REACH + AROUND]
        left, right = at - self.starts[doc], self.ends[doc] - at - ANCHOR
        column = np.arange(AROUND)
        cells = np.where((column >= REACH - left[:, None]) & (column < REACH + ANCHOR + right[:, None]), cells, 0)
        near, far = (at - a.last[use]).astype(np.uint8), (at - a.first[use]).astype(np.uint8)
        return np.ascontiguousarray(np.column_stack([near, far, cells]).astype(np.uint8))

    def records(self, repeated: np.ndarray, hot: np.ndarray) -> Records:
        """Distinct neighbourhoods of the anchors whose hash is repeated; of the hot ones, distinct windows."""
        use = np.flatnonzero(repeated[self.number])
        warm = hot[self.number[use]]
        cold, use = use[~warm], use[warm]
        found = [self._records(cold, self._neighbourhoods(cold))]
        around = self._neighbourhoods(use)
        column = np.arange(AROUND)
        for distance in range(REACH + 1) if len(use) else ():
            own = np.flatnonzero((around[:, 0] <= distance) & (distance <= around[:, 1]))
            rows = around[own]
            rows[:, :2] = distance
            rows[:, 2:][:, (column < REACH - distance) | (column >= REACH - distance + LENGTH)] = 0
            one = self._records(use[own], rows)
            one.hash = _row_hash(one.rows)
            found.append(one)
        shift = np.cumsum([0, *(len(r.rows) for r in found)])
        return Records(*(np.concatenate([getattr(r, name) for r in found]) for name in ("rows", "least", "hash", "use")),
                       np.concatenate([r.number + k for r, k in zip(found, shift)]))

    def _records(self, use: np.ndarray, rows: np.ndarray) -> Records:
        keys, first, number = _distinct(rows)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.ids[self.anchors.doc[use]])
        return Records(keys, least, self.anchors.hash[use][first], use, number)

    def answers(self, records: Records, smaller: np.ndarray) -> pa.Table:
        """The result of every row, given each record's bits: distances at which a smaller document has the window."""
        a, use = self.anchors, records.use
        mask = np.where(self.ids[a.doc[use]] > records.least[records.number], np.uint32(0xFFFFFFFF), smaller[records.number])
        cover = np.zeros(len(self.data) + 1, np.int8)  # at most LENGTH windows cover a byte
        near, far = records.rows[records.number, 0], records.rows[records.number, 1]
        for distance in range(REACH + 1):
            begin = a.at[use] - distance
            gone = (near <= distance) & (distance <= far) & (mask >> np.uint32(distance) & np.uint32(1) > 0)
            cover[begin[gone]] += 1  # every window has one anchor, so no start comes twice
            cover[begin[gone] + LENGTH] -= 1
        covered = np.cumsum(cover[:-1], dtype=np.int8) > 0
        out, k = [], 0
        for i, body in enumerate(b for chunk in self.table["body"].chunks for b in chunk):
            whole = np.frombuffer(body.as_buffer(), np.uint8)
            if self.first[i]:
                gone = covered[self.starts[k]:self.ends[k]]
                k += 1
            else:
                gone = np.full(len(whole), bool(self.copy[i]) and len(whole) >= LENGTH)
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            out.append((len(whole), int(gone.sum()), spans, hashlib.sha256(whole[~gone].tobytes()).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([self.table["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


@dataclass
class Records:
    """Distinct neighbourhoods (nearest and furthest distance, then the bytes), their least id and the hash that deals them
    (the anchor's, or a hot one's window's), in a fixed order; ``use`` and ``number`` lead from the anchors to them."""

    rows: np.ndarray
    least: np.ndarray
    hash: np.ndarray
    use: np.ndarray
    number: np.ndarray

    def of_bucket(self, buckets: int) -> np.ndarray:
        return np.searchsorted(_borders(buckets)[1:], self.hash, side="right")


def _borders(buckets: int) -> np.ndarray:
    """First hash of each of ``buckets`` equal ranges; the last border is left open."""
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of bytes, where each comes first, and each row's number among them."""
    keys, first, number = np.unique(rows.view(f"V{AROUND + 2}").ravel(), return_index=True, return_inverse=True)
    return keys.view(np.uint8).reshape(-1, AROUND + 2), first, number


def _row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k, word in enumerate(_numbers(rows)):
        out = (out + word) * _FACTORS[k % len(_FACTORS)]
        out ^= out >> np.uint64(31)
    return out * _FACTORS[5]


def hot_anchors(values: Sequence[np.ndarray], numbers: Sequence[np.ndarray], limit: int) -> list[np.ndarray]:
    """For each part's distinct hashes of a range: which have more than ``limit`` records in all parts."""
    _, number = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(number, np.concatenate(numbers))
    return np.split(total[number] > limit, np.cumsum([len(v) for v in values])[:-1])


def repeated_anchors(values: Sequence[np.ndarray], flags: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each part's distinct hashes of a range: which occur in another part too or are flagged."""
    every, flag = np.concatenate(values), np.concatenate(flags)
    order = np.argsort(every, kind="stable")
    same = np.zeros(len(every) + 1, bool)
    same[1:-1] = every[order][1:] == every[order][:-1]
    out = flag.copy()
    out[order] |= same[1:] | same[:-1]
    # a flag of one part holds for all parts that have the hash; those are repeated anyway
    return np.split(out, np.cumsum([len(v) for v in values])[:-1])


def _numbers(cells: np.ndarray) -> list[np.ndarray]:
    """Columns of bytes as big-endian numbers of eight bytes each, so that numbers sort as the bytes do."""
    wide = np.zeros((len(cells), -(-cells.shape[1] // 8) * 8), np.uint8)
    wide[:, :cells.shape[1]] = cells
    return [column.astype(np.uint64) for column in wide.view(">u8").T]


def smaller_elsewhere(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A bit per distance for each record: whether a record with a smaller id has the same window there.

    At one distance the windows are sorted by their bytes before the anchor, then by the anchor's rank, which
    stands for its bytes, then by the bytes after it.
    """
    out = np.zeros(len(rows), np.uint32)
    near, far, cells = rows[:, 0], rows[:, 1], rows[:, 2:]
    anchor = np.ascontiguousarray(cells[:, REACH:REACH + ANCHOR]).view(f"V{ANCHOR}").ravel()
    rank = np.unique(anchor, return_inverse=True)[1]
    for distance in range(REACH + 1):
        use = np.flatnonzero((near <= distance) & (distance <= far))
        if len(use) < 2:
            continue
        left = cells[use, REACH - distance:REACH]
        right = cells[use, REACH + ANCHOR:AROUND - distance]
        keys = [*_numbers(left), rank[use], *_numbers(right)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(use), bool)
        new[0] = True
        for key in keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        first = np.flatnonzero(new)
        ids = least[use][order]
        lowest = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(use))))
        out[use[order[ids > lowest]]] |= np.uint32(1 << distance)
    return out


def _rows(kind: pa.Schema, *columns) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def _schema(*, bytes_: Sequence[str], ints: Sequence[str] = ("bucket", "part")) -> pa.Schema:
    return pa.schema([*((n, pa.int32()) for n in ints), *((n, pa.binary()) for n in bytes_)])


def _ordered(table: pa.Table, by: str) -> pa.Table:
    return table.take(pa.array(np.argsort(table[by].to_numpy(), kind="stable")))


_HASHES = _schema(bytes_=("hashes", "flags", "several"))
_BITS = _schema(bytes_=("bits",), ints=("part", "bucket", "kind"))
_RECORDS = _schema(bytes_=("rows", "least"))


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES,
           bucket_bytes: int = BUCKET_BYTES, hot_records: int = HOT_RECORDS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), body.alias("t")).withColumn("node", F.unhex(F.md5("t")))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts, buckets = max(-(-size // part_bytes), 1), max(-(-size // bucket_bytes), 16)
    # of several rows with a text, those of the least id are sorted
    least = (rows.filter(F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(F.col("node").alias("of"), "least"))
    later = (rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "node").join(least, F.col("node") == F.col("of"))
             .filter(F.col("doc_id") > F.col("least")).select("doc_id", "node").distinct())
    part_of = F.pmod(F.xxhash64("doc_id", "node"), F.lit(parts)).cast("int").alias("part")
    dealt = rows.select(part_of, "doc_id", F.xxhash64("node").alias("row"), F.col("t").cast("binary").alias("body"))
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    known = later.select(part_of, F.lit(0).alias("bucket"), F.lit(LATER).alias("kind"),
                         F.concat(number("doc_id"), number(F.xxhash64("node"))).alias("bits"))

    def send_hashes(table: pa.Table, told: pa.Table) -> pa.Table:
        part = Part(table, told)
        number, flags, records = table["part"][0].as_py(), part.shared_here(), part.numbers()
        cut = np.append(part.slices(buckets), len(part.hashes))
        sent = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        several = np.flatnonzero(records > 1)  # most hashes have one record; only the others' numbers are sent
        pairs = [several[slice(*np.searchsorted(several, cut[b:b + 2]))] for b in sent]
        return _rows(_HASHES, sent, [number] * len(sent),
                     [part.hashes[cut[b]:cut[b + 1]].astype(np.uint32).tobytes() for b in sent],
                     [np.packbits(flags[cut[b]:cut[b + 1]]).tobytes() for b in sent],
                     [np.stack([at - cut[b], records[at]]).astype(np.uint32).tobytes() for b, at in zip(sent, pairs, strict=True)])

    def match_hashes(table: pa.Table) -> pa.Table:
        table = _ordered(table, "part")
        values = [np.frombuffer(v, np.uint32) for v in table["hashes"].to_pylist()]
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(v)).astype(bool)
                 for f, v in zip(table["flags"].to_pylist(), values, strict=True)]
        found = repeated_anchors(values, flags)
        records = [np.ones(len(v), np.int64) for v in values]
        for own, several in zip(records, table["several"].to_pylist(), strict=True):
            at, times = np.frombuffer(several, np.uint32).reshape(2, -1)
            own[at] = times
        hot = hot_anchors(values, records, hot_records)
        return _rows(_BITS, table["part"].to_pylist(), table["bucket"].to_pylist(), [HASHES] * len(found),
                     [np.packbits(f).tobytes() + (np.packbits(h).tobytes() if h.any() else b"")
                      for f, h in zip(found, hot, strict=True)])

    def recall(part: Part, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The answers about a part's hashes, in their order: which are repeated, which are hot."""
        bits = told.filter(pc.equal(told["kind"], HASHES))
        repeated, hot = np.zeros(len(part.hashes), bool), np.zeros(len(part.hashes), bool)
        cut = np.append(part.slices(buckets), len(part.hashes))
        for b, packed in zip(bits["bucket"].to_pylist(), bits["bits"].to_pylist(), strict=True):
            low, high = cut[b], cut[b + 1]
            packed, size = np.frombuffer(packed, np.uint8), -(-(high - low) // 8)
            repeated[low:high] = np.unpackbits(packed[:size], count=high - low)
            if len(packed) > size:
                hot[low:high] = np.unpackbits(packed[size:], count=high - low)
        return repeated, hot

    def send_records(table: pa.Table, told: pa.Table) -> pa.Table:
        part = Part(table, told)
        records = part.records(*recall(part, told))
        bucket = records.of_bucket(buckets)
        sent = np.unique(bucket).tolist()
        return _rows(_RECORDS, sent, [table["part"][0].as_py()] * len(sent),
                     [records.rows[bucket == b].tobytes() for b in sent], [records.least[bucket == b].tobytes() for b in sent])

    def match_records(table: pa.Table) -> pa.Table:
        table = _ordered(table, "part")
        least = [np.frombuffer(v, np.int64) for v in table["least"].to_pylist()]
        rows = np.frombuffer(b"".join(table["rows"].to_pylist()), np.uint8).reshape(-1, AROUND + 2)
        found = smaller_elsewhere(rows, np.concatenate(least))
        bits = np.split(found, np.cumsum([len(v) for v in least])[:-1])
        return _rows(_BITS, table["part"].to_pylist(), table["bucket"].to_pylist(), [MASKS] * len(bits),
                     [b.tobytes() for b in bits])

    def answer(table: pa.Table, told: pa.Table) -> pa.Table:
        part = Part(table, told)
        masks = told.filter(pc.equal(told["kind"], MASKS))
        records = part.records(*recall(part, told))
        smaller, bucket = np.zeros(len(records.rows), np.uint32), records.of_bucket(buckets)
        for b, found in zip(masks["bucket"].to_pylist(), masks["bits"].to_pylist(), strict=True):
            smaller[bucket == b] = np.frombuffer(found, np.uint32)
        return part.answers(records, smaller)

    def with_answers(told: DataFrame, work, schema: str) -> DataFrame:
        return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(work, schema)

    hashes = with_answers(known, send_hashes, "bucket int, part int, hashes binary, flags binary, several binary")
    ranks = hashes.groupBy("bucket").applyInArrow(match_hashes, "part int, bucket int, kind int, bits binary")
    told = known.unionByName(ranks)
    records = with_answers(told, send_records, "bucket int, part int, rows binary, least binary")
    masks = records.groupBy("bucket").applyInArrow(match_records, "part int, bucket int, kind int, bits binary")
    return with_answers(told.unionByName(masks), answer, f"doc_id bigint, {RESULT}")
