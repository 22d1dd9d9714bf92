"""Operator 13: source divergence audit over a minimal acyclic transducer vocabulary.

1. Document frequencies. A pass over the texts counts, per language, in how many documents each term occurs; the
   counts are combined on the map side. Terms of at least ``least_docs`` documents are kept.
2. Vocabulary. The kept terms are sorted by range of (language, first eight bytes). A task builds, per language, one
   transducer from its sorted stretch: the minimal acyclic automaton (equal suffixes share states, found while
   reading), whose arcs carry the number of terms that sort before the ones behind them. The sum along a term's path is its
   lexicographic ordinal within the stretch; adding the stretch's first ordinal gives that within the language.
3. Recount. The texts are streamed through the transducers, all tokens of a buffer byte by byte side by side, and come
   out as ordinals, counted by (language, source, ordinal). Transducers go out as a broadcast of at most
   ``round_bytes``; a larger vocabulary takes more rounds, each of which reads the texts once more for the languages that it holds.
4. Divergence. The counts of one block of ordinals of a language meet in one task, which adds up the block's part of
   the divergence of every pair of sources and keeps each source's first terms. Blocks shrink as sources grow, so a
   task holds a bounded matrix. Ranks follow from the sums; equal values go by ordinal (terms) or name (sources).

All arithmetic is on integers: shares are divided out in three steps of 1,000, exact up to 9 * 10^15 tokens of a
group. Null texts, languages and sources are ''. Groups without a kept term take part with zero counts; where a
language keeps no term, its pairs have the value 0 and there are no term rows. Repeated rows count as often as they come. An
empty table gives an empty result. Other columns are not read. A term is as long as its letters run, of whatever length.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitlife.llm.shared import stored, values, words_of

SCALE_STEP, SCALE_STEPS = 1000, 3  # shares are in units of 1 / 1000^3
LEAST_DOCS = 10
TOP = 10
HELD_TERMS = 1 << 18  # distinct terms that a task holds before it sends counts
HELD_TOKENS = 1 << 20
BUFFER = 1 << 21  # bytes of text walked at a time
STRETCH_TERMS = 1 << 17
ROUND_BYTES = 1 << 28
BLOCK_TERMS, BLOCK_CELLS = 1 << 12, 1 << 20
PREFIX = 8

# Bytes of terms, in lower case; 0 ends a term. All bytes from 0x80 on belong to characters beyond ASCII.
_LOWER = np.zeros(256, np.uint8)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_LOWER[ord("A"):ord("Z") + 1] = _LOWER[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER_BYTES = _LOWER.tobytes()
_TERM = re.compile(rb"[^\x00]+")


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, term, n)``: in how many of the documents read a term occurs."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, held in counts.items():
            yield pa.record_batch([
                pa.array([lang] * len(held), pa.string()), pa.array(list(held), pa.string()),
                pa.array(list(held.values()), pa.int64())], ["lang", "term", "n"])
        counts.clear()

    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        for text, lang in zip(values(texts), values(batch.column(1)), strict=True):
            held = counts[lang]
            held.update(set(words_of(_TERM, text.translate(_LOWER_BYTES))))
            if len(held) > HELD_TERMS:
                yield from out()
    yield from out()


class Transducer(NamedTuple):
    """Arcs in the order of (state, byte): ``keys`` is ``state << 8 | byte``. State 0 is the root."""

    keys: np.ndarray
    targets: np.ndarray
    skips: np.ndarray  # terms that sort before those behind the arc, counted from its state
    final: np.ndarray  # by state

    def packed(self) -> bytes:
        return (np.array([len(self.keys), len(self.final)], "<i8").tobytes() + self.keys.astype("<i8").tobytes()
                + self.targets.astype("<i8").tobytes() + self.skips.astype("<i8").tobytes() + self.final.astype(np.uint8).tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Transducer:
        arcs, states = np.frombuffer(data, "<i8", 2).tolist()
        part = lambda k: np.frombuffer(data, "<i8", arcs, 16 + 8 * arcs * k)
        return cls(part(0), part(1), part(2), np.frombuffer(data, np.uint8, states, 16 + 24 * arcs).astype(bool))

    def terms(self, ordinals: list[int]) -> list[bytes]:
        """The terms of ordinals: at each state the last arc that does not skip too many."""
        first = np.searchsorted(self.keys, np.arange(len(self.final) + 1) << 8)
        out = []
        for rest in ordinals:
            state, term = 0, bytearray()
            while not (self.final[state] and rest == 0):
                own = slice(first[state], first[state + 1])
                at = own.start + int(np.searchsorted(self.skips[own], rest, side="right")) - 1
                rest -= int(self.skips[at])
                term.append(int(self.keys[at]) & 255)
                state = int(self.targets[at])
            out.append(bytes(term))
        return out


def build(terms: Iterator[bytes]) -> tuple[Transducer, int]:
    """The minimal transducer of distinct sorted terms, and their number.

    Only the path of the last term is open. When the next one leaves it, the states behind the fork can change no
    more: each is replaced by an equal one (same arcs, same end mark) if there is one.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, ((byte, target), ...)) of closed states
    sizes: list[int] = []  # terms behind a closed state
    path: list[list] = [[False, []]]  # open states: [final, [(byte, target), ...]]
    last, n = b"", 0

    def close(depth: int) -> None:
        while len(path) > depth:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append(key)
                sizes.append(final + sum(sizes[t] for _, t in arcs))
            if path:
                path[-1][1].append((last[len(path) - 1], state))

    for term in terms:
        shared = 0
        for a, b in zip(last, term, strict=False):
            if a != b:
                break
            shared += 1
        close(shared + 1)
        path.extend([False, []] for _ in term[shared:])
        path[-1][0] = True
        last, n = term, n + 1
    close(0)
    root = len(states) - 1  # closed last; it is numbered 0
    number = lambda s: root - s
    rows = []
    for s, (final, arcs) in enumerate(states):
        skip = int(final)
        for byte, target in arcs:
            rows.append((number(s) << 8 | byte, number(target), skip))
            skip += sizes[target]
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 3)
    return Transducer(columns[:, 0].copy(), columns[:, 1].copy(), columns[:, 2].copy(),
                      np.array([states[number(s)][0] for s in range(len(states))], bool)), n


def _prefix(term: bytes) -> bytes:
    return term[:PREFIX].ljust(PREFIX, b"\0")


_STRETCH = "stretch bigint, lang string, first binary, n bigint, size bigint, transducer binary"


def _build_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A transducer per language of a sorted partition."""
    from itertools import groupby

    from pyspark import TaskContext

    rows = (row for batch in batches for row in zip(
        values(batch.column(0)), values(batch.column(1).cast(pa.large_binary())), strict=True))
    number = TaskContext.get().partitionId() << 32
    for lang, own in groupby(rows, key=lambda row: row[0]):
        _, first = next(own)
        machine, n = build(t for part in ([first], (t for _, t in own)) for t in part)
        data = machine.packed()
        yield pa.record_batch([
            pa.array([number], pa.int64()), pa.array([lang]), pa.array([_prefix(first)], pa.binary()),
            pa.array([n], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())],
            ["stretch", "lang", "first", "n", "size", "transducer"])
        number += 1


class Vocabulary(NamedTuple):
    """``stretches`` is a stored table of transducers; ``index`` has ``(stretch, lang, first, n, size, offset)`` of each, in
    order, ``offset`` being the first ordinal within the language."""

    stretches: DataFrame
    index: list[tuple[int, str, bytes, int, int, int]]

    def sizes(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for _, lang, _, n, _, _ in self.index:
            out[lang] = out.get(lang, 0) + n
        return out


def _read(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))


def vocabulary(texts: DataFrame, least_docs: int = LEAST_DOCS, stretch_terms: int = STRETCH_TERMS) -> Vocabulary:
    """The kept terms of every language of ``(text, lang, ...)``."""
    kept = stored(texts.select("text", "lang").mapInArrow(_document_terms, "lang string, term string, n bigint")
                  .groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_docs)
                  .select("lang", "term"), "kept-terms")
    parts = max(-(-kept.count() // stretch_terms), 1)
    # terms that share their first bytes stay together, so those bytes tell the stretch
    by = ["lang", F.substring(F.col("term").cast("binary"), 1, PREFIX)]
    built = stored(kept.repartitionByRange(parts, *by).sortWithinPartitions("lang", "term").mapInArrow(
        _build_stretches, _STRETCH), "transducers")
    index, before = [], {}
    for r in sorted(built.drop("transducer").collect(), key=lambda r: (r["lang"].encode(), bytes(r["first"]))):
        offset = before.get(r["lang"], 0)
        index.append((r["stretch"], r["lang"], bytes(r["first"]), r["n"], r["size"], offset))
        before[r["lang"]] = offset + r["n"]
    return Vocabulary(built, index)


class Walker:
    """Several transducers as one set of arrays; a token starts at the root of its language's stretch."""

    def __init__(self, stretches: list[tuple[str, bytes, int, bytes]]):
        keys, targets, skips, final, states = [], [], [], [], 0
        self.of: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_lang = defaultdict(list)
        for lang, first, offset, data in stretches:
            machine = Transducer.unpacked(data)
            by_lang[lang].append((int.from_bytes(first, "big"), states, offset))
            keys.append(machine.keys + (states << 8))
            targets.append(machine.targets + states)
            skips.append(machine.skips)
            final.append(machine.final)
            states += len(machine.final)
        self.keys, self.targets, self.skips, self.final = (np.concatenate(x) for x in (keys, targets, skips, final))
        for lang, own in by_lang.items():
            firsts, roots, offsets = zip(*sorted(own), strict=True)
            self.of[lang] = np.array(firsts, np.uint64), np.array(roots), np.array(offsets)

    def ordinals(self, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lang: str) -> np.ndarray:
        """Ordinals of the tokens at ``starts`` that the language's terms hold."""
        firsts, roots, offsets = self.of[lang]
        stretch = np.zeros(len(starts), np.int64)
        if len(firsts) > 1:
            prefix = np.zeros(len(starts), np.uint64)
            for i in range(PREFIX):
                byte = np.where(i < lengths, low[np.minimum(starts + i, len(low) - 1)], 0).astype(np.uint64)
                prefix = prefix << np.uint64(8) | byte
            stretch = np.maximum(np.searchsorted(firsts, prefix, side="right") - 1, 0)
        state, ordinal = roots[stretch], offsets[stretch]
        at, left = starts, lengths
        found = []
        while len(at):
            wanted = state << 8 | low[at]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            on = np.flatnonzero(self.keys[arc] == wanted)
            arc = arc[on]
            state, ordinal, at, left = self.targets[arc], ordinal[on] + self.skips[arc], at[on] + 1, left[on] - 1
            ended = left == 0
            if ended.any():
                found.append(ordinal[ended & self.final[state]])
                on = np.flatnonzero(~ended)
                state, ordinal, at, left = state[on], ordinal[on], at[on], left[on]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def buffers(data: bytes, limit: int = BUFFER) -> Iterator[np.ndarray]:
    """Lower-case bytes of a text in pieces of about ``limit``; a piece ends where a term ends."""
    start = 0
    while start < len(data):
        end = min(start + limit, len(data))
        while end < len(data) and _LOWER[data[end]]:
            end += 1
        yield _LOWER[np.frombuffer(data, np.uint8, end - start, start)]
        start = end


def tokens(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the terms in lower-case bytes."""
    inside = np.concatenate([[False], low != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def _counted(groups: dict, buffered: dict) -> pa.RecordBatch:
    """``(lang, source, ordinal, n)`` of the ordinals gathered per group."""
    columns: list[list] = [[], [], [], []]
    for code, (lang, source) in groups.items():
        if buffered[code]:
            ordinals, n = np.unique(np.concatenate(buffered[code]), return_counts=True)
            for column, part in zip(columns, ([lang] * len(n), [source] * len(n), ordinals, n), strict=True):
                column.extend(part)
    return pa.record_batch([pa.array(c, t) for c, t in zip(
        columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "ordinal", "n"])


def _recount(texts: DataFrame, held: list[tuple[str, bytes, int, bytes]]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(shared.value)
        groups: dict[int, tuple[str, str]] = {}
        codes: dict[tuple[str, str], int] = {}
        buffered: dict[int, list] = defaultdict(list)
        pending: dict[int, list] = defaultdict(list)  # short texts of a group, walked together
        weight, total = Counter(), 0

        def walk(code: int) -> int:
            data, lang = b" ".join(pending.pop(code, [])), groups[code][0]
            weight[code] = 0
            n = 0
            for low in buffers(data):
                buffered[code].append(walker.ordinals(low, *tokens(low), lang))
                n += len(buffered[code][-1])
            return n

        for batch in batches:
            texts = values(batch.column(0).cast(pa.large_binary()))
            for text, lang, source in zip(texts, values(batch.column(1)), values(batch.column(2)), strict=True):
                if lang not in walker.of:
                    continue
                code = codes.setdefault((lang, source), len(codes))
                groups[code] = (lang, source)
                pending[code].append(text)
                weight[code] += len(text) + 1
                if weight[code] >= BUFFER or weight.total() >= 8 * BUFFER:
                    for some in [code] if weight[code] >= BUFFER else list(pending):
                        total += walk(some)
                if total >= HELD_TOKENS:
                    yield _counted(groups, buffered)
                    buffered.clear()
                    total = 0
        for code in list(pending):
            walk(code)
        yield _counted(groups, buffered)

    return texts.mapInArrow(stream, "lang string, source string, ordinal bigint, n bigint")


def recount(texts: DataFrame, words: Vocabulary, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``lang, source, ordinal, n``: the stored counts of kept terms in ``(text, lang, source)``."""
    rounds, weight = [[]], 0
    for stretch in words.index:
        if rounds[-1] and weight + stretch[4] > round_bytes:
            rounds.append([])
            weight = 0
        rounds[-1].append(stretch)
        weight += stretch[4]
    parts = []
    for own in rounds:
        if not own:
            return stored(texts.sparkSession.createDataFrame([], "lang string, source string, ordinal bigint, n bigint"), "recount")
        data = {r["stretch"]: r["transducer"] for r in
                words.stretches.filter(F.col("stretch").isin([s[0] for s in own])).select("stretch", "transducer").collect()}
        held = [(lang, first, offset, bytes(data[stretch])) for stretch, lang, first, _, _, offset in own]
        langs = sorted({s[1] for s in own})
        read = texts.filter(F.col("lang").isin(langs)) if len(rounds) > 1 else texts
        counts = _recount(read, held).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        parts.append(stored(counts, "recount"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)  # stretches share no ordinal
    return out


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(1000^3 * (count + 2) / (total + 2 * terms))``."""
    out, rest, whole = np.zeros_like(counts), counts + 2, total + 2 * terms
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out = out * SCALE_STEP + rest // whole
        rest %= whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_BLOCK = "part string, lang string, source string, other string, ordinal bigint, value bigint"


def _block(top: int):
    """One block of a language's ordinals: rows ``(lang, block, source, ordinal, n, total, terms)``; a source's row
    without an ordinal has its total."""
    def work(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        ordinal = table.column("ordinal")
        heads = table.filter(ordinal.is_null())
        cells = table.filter(ordinal.is_valid())
        names, totals = heads.column("source").to_pylist(), heads.column("total").to_pylist()
        terms = heads.column("terms")[0].as_py()
        at = {name: i for i, name in enumerate(names)}
        columns, column = np.unique(cells.column("ordinal").to_numpy(), return_inverse=True)
        counts = np.zeros((len(names), len(columns)), np.int64)
        coded = cells.column("source").combine_chunks().dictionary_encode()
        row = np.array([at[name] for name in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        counts[row, column] = cells.column("n").to_numpy()
        p = np.array([shares(c, t, terms) for c, t in zip(counts, totals, strict=True)])
        q = shares(counts.sum(0), sum(totals), terms)
        rows: list[tuple] = []
        for i, name in enumerate(names):
            sums = apart(p[i], p[i + 1:]).sum(1) if i + 1 < len(names) else ()
            rows += [("pair", lang, name, other, None, int(v)) for other, v in zip(names[i + 1:], sums, strict=True)]
            over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = apart(p[i][over], q[over])
            best = np.lexsort((columns[over], -value))[:top]
            rows += [("term", lang, name, None, int(columns[over[b]]), int(value[b])) for b in best]
        names_of = ("part", "lang", "source", "other", "ordinal", "value")
        types = (pa.string(),) * 4 + (pa.int64(),) * 2
        lists = zip(*rows, strict=True) if rows else ((),) * 6
        return pa.table([pa.array(list(c), t) for c, t in zip(lists, types, strict=True)], names=names_of)
    return work


def _named(first: DataFrame, words: Vocabulary) -> DataFrame:
    """Rows with an ordinal, with its term, read back from the transducer of its stretch."""
    spark = first.sparkSession
    places = spark.createDataFrame([(lang, stretch, offset, n) for stretch, lang, _, n, _, offset in words.index],
                                   "p_lang string, stretch bigint, offset bigint, size bigint")
    here = (F.col("lang") == F.col("p_lang")) & (F.col("ordinal") >= F.col("offset")) & (F.col("ordinal") < F.col("offset") + F.col("size"))
    placed = first.join(places, here).select("lang", "source", "value", "rank", "stretch", (F.col("ordinal") - F.col("offset")).alias("at"))

    def read(rows: pa.Table, machine: pa.Table) -> pa.Table:
        if not len(rows):
            return rows.select(["lang", "source", "value", "rank"]).append_column("item", pa.array([], pa.string()))
        terms = Transducer.unpacked(machine.column("transducer")[0].as_py()).terms(rows.column("at").to_pylist())
        return rows.select(["lang", "source", "value", "rank"]).append_column("item", pa.array(terms, pa.string()))

    return placed.groupBy("stretch").cogroup(words.stretches.select("stretch", "transducer").groupBy("stretch")).applyInArrow(
        read, "lang string, source string, value bigint, rank int, item string")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS,
          top: int = TOP, stretch_terms: int = STRETCH_TERMS, round_bytes: int = ROUND_BYTES,
          block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of the language by divergence (part ``pair``) and
    the ``top`` terms that a source uses more than its language (part ``term``)."""
    spark = docs.sparkSession
    texts = _read(docs, text, lang, source)
    words = vocabulary(texts, least_docs, stretch_terms)
    counts = recount(texts, words, round_bytes)
    sizes = spark.createDataFrame(list(words.sizes().items()), "lang string, terms bigint")
    groups = stored(
        texts.select("lang", "source").distinct()
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "terms"))), "source-totals")
    most = groups.groupBy("lang").count().agg(F.max("count").alias("n")).first()["n"] or 1
    block = max(min(block_terms, BLOCK_CELLS // most), 1)
    # every source has a row in every block of its language, so that pairs see its total where it has no count
    heads = groups.filter("terms > 0").select(
        "lang", F.explode(F.sequence(F.lit(0), F.expr(f"(terms - 1) div {block}"))).alias("block"), "source",
        F.lit(None).cast("bigint").alias("ordinal"), F.lit(None).cast("bigint").alias("n"), "total", "terms")
    cells = counts.select("lang", F.expr(f"ordinal div {block}").alias("block"), "source", "ordinal", "n",
                          F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("terms"))
    found = stored(heads.union(cells).groupBy("lang", "block").applyInArrow(_block(top), _BLOCK), "block-sums")
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    empty = groups.filter("terms = 0").select("lang", "source")
    none = empty.join(empty.select("lang", F.col("source").alias("other")), "lang").filter("source < other").select(
        "lang", "source", "other", F.lit(0).cast("bigint").alias("value"))
    both = sums.union(none).select("lang", "value", F.inline(F.array(
        F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))))
    place = lambda by: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), by)).cast("int")
    pairs = both.withColumn("rank", place("item"))
    first = found.filter("part = 'term'").withColumn("rank", place("ordinal")).filter(F.col("rank") <= top)
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(order).union(
        _named(first, words).withColumn("part", F.lit("term")).select(order))
