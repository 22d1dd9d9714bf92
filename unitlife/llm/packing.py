"""Operator 12: sum-of-squares online packing of documents into windows of tokens.

Documents are tokenized once, by whole texts, and placed as they come. A level array holds how many open windows are
filled to each level; a document goes to the level (an empty window counts as level 0) whose choice leaves the smallest
sum of squared counts over the partially filled levels, of equal ones to the fullest. The part of a document beyond whole windows is
what is placed; the whole windows are closed at once. When a task's documents end, or more than ``MAX_OPEN`` windows
are open, the open windows are settled: the emptiest give their documents, cut where needed, to fill the fullest. What is then
left at the end is less than a window; it goes into windows whose lengths are the powers of two of its binary form,
which need no padding either.

Every task packs the documents it reads, with its own level array, so no text is shuffled and a task's memory is a
batch of texts and at most ``MAX_OPEN`` open windows. A repeated task reads the same rows in the same order and gives the same windows;
a table stored in another way is packed in another way. Sequence ids are unique, not gapless.

Where the tokenizer's file says that no token spans them, texts are cut at blanks and between letters and signs, and equal
pieces are tokenized once while they are in a bounded cache; a text is thus read in stretches, however long. A null text is empty: it has
the final id alone. Null and repeated ids are packed like others, each row for itself. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlife.llm.shared import values, words_of

WINDOW = 4096
FINAL_ID = 2
MAX_OPEN = 1 << 12
BATCH_SEQUENCES = 256

STRETCH = 1 << 14  # pieces
CACHED_CHARS = 64  # longer pieces are not kept
CACHED_PIECES = 1 << 19  # of each of two generations; some 200 bytes a piece
WHOLE = re.compile(r"[^ \t\n\r]+")
# Latin letters (whose lower case is one letter) not followed by another character beyond ASCII; then signs and digits up to a
# letter or blank, without an apostrophe, which joins letters; then whatever else stands between blanks.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
FINE = re.compile(rf"[{LATIN}]++(?![^\x00-\x7f])|[!-&(-@\[-`{{-~]++(?=[{LATIN} \t\n\r]|\Z)|[^ \t\n\r]+")
LETTERS = re.compile(f"[{LATIN}]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as its printable Latin-1 character; the others, in order, as those from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()

# What a tokenizer's file says if no token spans a blank, or a border between letters and ASCII signs but the
# apostrophe, and if letters are read byte by byte in lower case. Others are given whole texts.
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK = "<|"


class Pieces(dict):
    """Ids by piece; one that is not held is looked up or tokenized when it is asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.before: dict[str, bytes] = {}  # of the generation before
        self.long: list[str] = []

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            if LETTERS.fullmatch(piece):
                numbers = [t.id for t in self.model.tokenize(piece.lower().encode().decode("latin-1").translate(BYTE_LETTERS))]
                ids = struct.pack(f"<{len(numbers)}I", *numbers)
            else:
                ids = coded(self.tokenizer, piece)
            if len(piece) > CACHED_CHARS:
                self.long.append(piece)
        self[piece] = ids
        return ids

    def trim(self) -> None:
        for piece in self.long:
            self.pop(piece, None)
        self.long.clear()
        if len(self) > CACHED_PIECES:
            self.before = dict(self)
            self.clear()


def coded(tokenizer, text: str) -> bytes:
    ids = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of texts, as little-endian 32-bit numbers."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary)
        file = json.loads(vocabulary)
        steps = [s["type"] for s in (file.get("normalizer") or {}).get("normalizers", [])]
        first = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_pieces = (steps == NORMAL and first.get("pattern") == {"Regex": SPLIT}
                          and all(t["content"].startswith(MARK) and not t["lstrip"] and not t["rstrip"] for t in file["added_tokens"]))
        self.pieces = Pieces(self.tokenizer)

    def ids(self, text: str) -> bytes:
        if not self.by_pieces:
            return coded(self.tokenizer, text)
        pieces, known = words_of(WHOLE if MARK in text else FINE, text), self.pieces
        if isinstance(pieces, list):
            out = b"".join(map(known.__getitem__, pieces))
            known.trim()
            return out
        parts = []  # of a long text
        while stretch := list(islice(pieces, STRETCH)):
            parts.append(b"".join(map(known.__getitem__, stretch)))
            known.trim()
        return b"".join(parts)


@lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


class Packer:
    """Windows of one task. A piece is ``(document, start, ids, tokens of the document)``, ids as bytes; closed windows
    are lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        # counts of open windows by level; the two ends are set so that one difference compares all choices: opening a
        # window costs 2 N(s) + 1, closing one -2 N(h) + 1, a move from h to h + s costs 2 N(h + s) - 2 N(h) + 2
        self.counts = np.zeros(window + 1)
        self.counts[0], self.counts[window] = 0.5, -0.5
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.n_open = 0

    def _put(self, level: int, pieces: list[tuple]) -> None:
        self.open[level].append(pieces)
        self.counts[level] += 1
        self.n_open += 1

    def level_for(self, size: int) -> int:
        """The level that a document of ``size`` tokens goes to."""
        before = self.counts[: self.window + 1 - size]
        cost = np.where(before > 0, self.counts[size:] - before, np.inf)
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, document, ids: bytes) -> Iterator[list[tuple]]:
        """Places a document; yields the windows that it closes."""
        tokens, width = len(ids) // 4, 4 * self.window
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            yield [(document, at // 4, ids[at:at + width], tokens)]
        size = tokens - whole // 4
        if not size:
            return
        level, piece = self.level_for(size), (document, whole // 4, ids[whole:], tokens)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
        else:
            self._put(level + size, pieces)
        if self.n_open > self.max_open:
            closed, level, left = self.settled()
            yield from closed
            if left:
                self._put(level, left)

    def settled(self) -> tuple[list[list[tuple]], int, list[tuple]]:
        """Closes all open windows but one: ``(full windows, level of the last, its pieces)``."""
        windows = [(level, p) for level in sorted(self.open, reverse=True) for p in self.open[level]]
        self.open.clear()
        self.counts[1:self.window] = 0
        self.n_open = 0
        full, first, last = [], 0, len(windows) - 1
        supply: list[tuple] = []
        have = 0
        while first <= last or have:
            level, pieces = 0, []
            if first <= last:
                level, pieces = windows[first]
                first += 1
            room = self.window - level
            while have < room and first <= last:
                size, more = windows[last]
                last -= 1
                supply += more
                have += size
            moved, supply = cut(supply, min(room, have))
            level += min(room, have)
            have -= min(room, have)
            pieces = pieces + moved
            if level < self.window:
                return full, level, pieces
            full.append(pieces)
        return full, 0, []

    def rest(self) -> Iterator[list[tuple]]:
        """Closes what is still open: full windows, then powers of two."""
        full, level, pieces = self.settled()
        yield from full
        while level:
            size = 1 << (level.bit_length() - 1)
            part, pieces = cut(pieces, size)
            yield part
            level -= size


def cut(pieces: list[tuple], tokens: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``tokens`` of the pieces, and what follows them."""
    taken = []
    for i, (document, start, ids, whole) in enumerate(pieces):
        size = len(ids) // 4
        if size > tokens:
            if tokens:
                taken.append((document, start, ids[:4 * tokens], whole))
            return taken, [(document, start + tokens, ids[4 * tokens:], whole), *pieces[i + 1:]]
        taken.append(pieces[i])
        tokens -= size
    return taken, []


def _sequences(numbered: list[tuple[int, list[tuple]]], window: int, schema: pa.Schema) -> pa.RecordBatch:
    rows = []
    for sequence, pieces in numbered:
        spans, at = [], 0
        for document, start, ids, tokens in pieces:
            size = len(ids) // 4
            spans.append({"document": document, "start": start, "length": size, "tokens": tokens, "offset": at})
            at += size
        padded = at if at & (at - 1) == 0 else window
        rows.append({"sequence_id": sequence, "tokens": at, "padded": padded,
                     "ids": b"".join(p[2] for p in pieces), "pieces": spans})
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str | Column = "text",
         window: int = WINDOW, final_id: int = FINAL_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """``sequence_id, tokens, padded, ids, pieces`` of every window.

    ``vocabulary`` is the content of a tokenizer's file. ``ids`` are little-endian 32-bit numbers; ``pieces`` says which
    span of which document lies where: ``document, start, length, tokens`` (of the document, with the final id), ``offset``.
    """
    source = docs.select(F.col(doc_id).alias("document"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    final = np.array([final_id], "<u4").tobytes()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, number = encoder(shared.value), Packer(window, max_open), TaskContext.get().partitionId() << 36
        held: list[tuple[int, list[tuple]]] = []
        schema = None

        def out(closed: Iterable[list[tuple]], least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for pieces in closed:
                held.append((number, pieces))
                number += 1
                if len(held) >= BATCH_SEQUENCES:
                    yield _sequences(held, window, schema)
                    held.clear()
            if held and len(held) >= least:
                yield _sequences(held, window, schema)
                held.clear()

        for batch in batches:
            piece = pa.struct([("document", batch.schema.field(0).type), *((n, pa.int64()) for n in ("start", "length", "tokens", "offset"))])
            schema = pa.schema([("sequence_id", pa.int64()), ("tokens", pa.int64()), ("padded", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(piece))])
            for document, content in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                yield from out(packer.add(document, coder.ids(content or "") + final), BATCH_SEQUENCES)
        if schema is not None:
            yield from out(packer.rest(), 1)

    id_type = docs.select(doc_id).schema[0].dataType.simpleString()
    return source.mapInArrow(windows, (
        "sequence_id bigint, tokens bigint, padded bigint, ids binary, "
        f"pieces array<struct<document: {id_type}, start: bigint, length: bigint, tokens: bigint, offset: bigint>>"))


def pieces(packed: DataFrame) -> DataFrame:
    """A row per piece, with its ids."""
    return packed.select("sequence_id", "ids", F.explode("pieces").alias("piece")).select(
        "sequence_id", "piece.*", F.substring(
            F.col("ids"), (F.col("piece.offset") * 4 + 1).cast("int"), (F.col("piece.length") * 4).cast("int")).alias("ids"))
