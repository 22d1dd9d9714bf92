"""Operator 7: language identification with interpolated Kneser-Ney character models.

``fit`` counts the character 4-grams of every training text, per language: each task merges its own counts,
Spark sums them. All of them make its model, whatever their number: the broadcast grows with the distinct grams of the
training texts. (A caller may give ``max_grams``: then a language's grams from the highest count down, as far as whole counts
fit, make its model, which is no longer the full one.) Lower orders hold continuation counts, discounts come from the counts
of counts. A gram is a 64-bit key of four 16-bit letter codes, kept in sorted arrays; the grams of all languages share
one array with a row of log-probabilities per language, and other grams are worked out from the lower orders.

``identify`` picks the language of the lowest cross-entropy per character. ``score`` is the softmax of the
cross-entropies at the temperature that fits all training rows best. A text is ``rejected`` if even
its best language describes it badly: its cross-entropy lies beyond the middle between what all of that language's own
training texts reach (exact 0.999 quantile) and a uniform guess, plus an allowance for short texts.

Text is lower-cased; everything but letters is one space. A text that is null or has no letter is ``und``, with score
0, and rejected. Texts are read whole. Repeated rows are handled alike. Input columns with the names of the new
ones are replaced; an empty table stays empty. Without any training text every text is ``und`` and none is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from unitlife.llm.shared import batched, positional, stored, values
from unitlife.operators.drift import column_quantiles

ORDER = 4
LIMIT_SHARE = 0.999  # of a language's training texts, for its limit of rejection
BATCH_CHARS = 1 << 18
UNKNOWN = "und"
TEMPERATURES = (0.5, 1, 2, 4, 8, 16, 32, 64)

_BITS = 16
_START, _SPACE = 1, 32
_MARK = "\U0010ffff" * (ORDER - 1)  # stands before every text


@cache
def _codes() -> np.ndarray:
    """The letter code of every code point: lower case for letters, a space for all else."""
    table = np.full(0x110000, _SPACE, np.uint64)
    for point in range(0x40000):  # there are no letters beyond
        letter = chr(point)
        if letter.isalpha():
            table[point] = min(ord(letter.lower()[0]), 0xFFFF)
    table[0x10FFFF] = _START
    return table


def letter_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of some texts, each after its marks and with single spaces, and the text that each belongs to."""
    joined = "".join(_MARK + t for t in texts)
    code = np.concatenate([
        _codes()[np.frombuffer(joined[k:k + BATCH_CHARS].encode("utf-32-le", "replace"), np.uint32)].astype(np.uint16)
        for k in range(0, len(joined), BATCH_CHARS)] or [np.empty(0, np.uint16)])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + ORDER - 1 for t in texts])
    space = code == _SPACE
    kept = np.ones(len(code), bool)
    kept[1:] = ~(space[1:] & (space[:-1] | (code[:-1] == _START)))
    return code[kept], owner[kept]


def grams(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all 4-grams of some texts, and the text that each belongs to, a bounded number at a time."""
    code, owner = letter_codes(texts)
    for start in range(0, len(code) - ORDER + 1, BATCH_CHARS):
        part = code[start:start + BATCH_CHARS + ORDER - 1].astype(np.uint64)
        last = part[ORDER - 1:]
        key = last.copy()
        for back in range(1, ORDER):
            key |= part[ORDER - 1 - back:len(part) - back] << np.uint64(_BITS * back)
        real = last != _START
        yield key[real], owner[start + ORDER - 1:start + ORDER - 1 + len(last)][real]


def _low(keys: np.ndarray, codes: int) -> np.ndarray:
    return keys & np.uint64((1 << (_BITS * codes)) - 1)


@dataclass
class Level:
    """One order of one language: grams with counts, and their contexts with totals and numbers of followers."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray = field(init=False)
    totals: np.ndarray = field(init=False)
    followers: np.ndarray = field(init=False)
    discount: float = field(init=False)

    def __post_init__(self) -> None:
        self.contexts, first, self.followers = np.unique(
            self.keys >> np.uint64(_BITS), return_index=True, return_counts=True)
        self.totals = np.add.reduceat(self.counts, first) if len(first) else np.empty(0)
        once, twice = (self.counts == 1).sum(), (self.counts == 2).sum()
        self.discount = once / (once + 2 * twice) if once and twice else 0.75

    def mixed(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Discounted probability plus the mass set free times the lower order's."""
        if not len(self.keys):
            return lower
        at, seen = _find(self.keys, keys)
        own = np.where(seen, np.maximum(self.counts[at] - self.discount, 0), 0)
        at, known = _find(self.contexts, keys >> np.uint64(_BITS))
        mixed = (own + self.discount * self.followers[at] * lower) / self.totals[at]
        return np.where(known, mixed, lower)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Model:
    """The models of all languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.levels: list[list[Level]] = []
        for lang in self.langs:
            keys, n = counts[lang]
            order = np.argsort(keys)
            levels = [Level(keys[order], n[order].astype(np.float64))]
            for codes in range(ORDER - 1, 0, -1):
                lower, types = np.unique(_low(levels[0].keys, codes), return_counts=True)
                levels.insert(0, Level(lower, types.astype(np.float64)))
            self.levels.append(levels)
        letters = [levels[0].keys for levels in self.levels]
        self.letters = len(np.unique(np.concatenate(letters))) + 1 if letters else 1
        every = [levels[-1].keys for levels in self.levels]
        self.table = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        self.bits = self._bits(self.table)
        self.temperature = 1.0
        self.limits = {lang: float(np.log2(self.letters)) for lang in self.langs}

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        """``-log2 P`` of the last letter of each gram, a column per language."""
        out = np.empty((len(keys), len(self.langs)), np.float32)
        for j, levels in enumerate(self.levels):
            p = np.full(len(keys), 1 / self.letters)
            for codes, level in enumerate(levels, 1):
                p = level.mixed(_low(keys, codes), p)
            out[:, j] = -np.log2(p)
        return out

    def entropies(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (a row per text, a column per language) and letters of every text."""
        n, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), len(self.langs)))
        for keys, owner in grams(texts):
            at, seen = _find(self.table, keys)
            bits = self.bits[at]
            if not seen.all():
                new, inverse = np.unique(keys[~seen], return_inverse=True)
                bits[~seen] = self._bits(new)[inverse]
            n += np.bincount(owner, minlength=len(texts))
            letters += np.bincount(owner[_low(keys, 1) != _SPACE], minlength=len(texts))
            for j in range(len(self.langs)):
                sums[:, j] += np.bincount(owner, bits[:, j], len(texts))
        return sums / np.maximum(n, 1)[:, None], letters

    def calibrate(self, chances: Sequence[float], reached: Sequence[float | None]) -> None:
        """Set the temperature of the highest log-chance of the training rows' own languages, and every language's limit by the
        cross-entropy that its own rows reach (None: it has no row with a letter)."""
        self.temperature = TEMPERATURES[int(np.argmax(chances))]
        for lang, bits in zip(self.langs, reached, strict=True):
            if bits is not None:
                self.limits[lang] = float(bits + np.log2(self.letters)) / 2

    def predict(self, texts: Sequence[str]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy and rejection of every text."""
        if not self.langs:
            return [(UNKNOWN, 0.0, None, False)] * len(texts)
        entropies, letters = self.entropies(texts)
        best = entropies.argmin(1)
        scores = _softmax(entropies, self.temperature)
        allowance = np.log2(self.letters) / np.sqrt(np.maximum(letters, 1))
        out = []
        for i, (j, n) in enumerate(zip(best, letters, strict=True)):
            if not n:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            lang, entropy = self.langs[j], float(entropies[i, j])
            out.append((lang, float(scores[i, j]), entropy, entropy > self.limits[lang] + allowance[i]))
        return out


def _softmax(entropies: np.ndarray, temperature: float) -> np.ndarray:
    x = -entropies * np.log(2) * temperature
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial gram counts per language of a partition of ``(lang, text)``."""
    held: dict[str, list] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        unique, inverse = np.unique(keys, return_inverse=True)
        return unique, np.bincount(inverse, counts).astype(np.int64)

    for batch in batches:
        rows = zip(values(batch.column(0)), values(batch.column(1)), strict=True)
        for some in batched(rows, lambda r: len(r[1]), BATCH_CHARS):
            by_lang: dict[str, list[str]] = {}
            for lang, text in some:
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for keys, _ in grams(texts):
                    held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
                    if len(held[lang]) > 16:
                        held[lang] = [merged(lang)]
    for lang in held:
        keys, counts = merged(lang)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)],
            names=["lang", "gram", "n"])


def fit(training: DataFrame, key: str = "doc_id", max_grams: int | None = None, sample_rows: int | None = None) -> Model:
    """Models, temperature and limits from all rows of ``lang, text`` that have both a language and a text. ``key`` and
    ``sample_rows`` are of former use, when some rows set the temperature and the limits; they change nothing."""
    rows = training.select(F.col("lang").cast("string").alias("lang"), "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stored(
        rows.select("lang", "text").mapInArrow(_counted, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    if max_grams is not None:
        frequent = Window.partitionBy("lang").orderBy(F.desc("n"))
        least = (  # one row per language: the lowest count whose grams still fit
            counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("size"))
            .withColumn("upto", F.sum("size").over(frequent)).filter(F.col("upto") <= max_grams)
            .groupBy("lang").agg(F.min("n").alias("least"))
        )
        counts = counts.join(F.broadcast(least), "lang").filter(F.col("n") >= F.col("least")).select("lang", "gram", "n")
    kept = counts.toArrow()  # the model: one row per language and gram
    keys, n = kept["gram"].to_numpy().view(np.uint64), kept["n"].to_numpy()
    lang = pc.index_in(kept["lang"], names := pc.unique(kept["lang"])).to_numpy()
    model = Model({one: (keys[lang == j], n[lang == j]) for j, one in enumerate(names.to_pylist())})
    if not model.langs:
        return model
    shared = training.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        """Of every learned row with a letter: its language, its cross-entropy there, and the log of its chance at each temperature."""
        at = {lang: j for j, lang in enumerate(shared.value.langs)}
        for batch in batches:
            rows = ((at[lang], text) for lang, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True) if lang in at)
            for some in batched(rows, lambda r: len(r[1]), BATCH_CHARS):
                entropies, letters = shared.value.entropies([t for _, t in some])
                own, entropies = np.array([j for j, _ in some])[letters > 0], entropies[letters > 0]
                every = np.arange(len(own))
                chances = (np.log(np.maximum(_softmax(entropies, t)[every, own], 1e-9)) for t in TEMPERATURES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array(entropies[every, own]), *(pa.array(c) for c in chances)], names=names_of)

    chance = [f"t{k}" for k in range(len(TEMPERATURES))]
    names_of = ["own", "bits", *chance]
    found = stored(rows.select("lang", "text").mapInArrow(
        measured, f"own int, bits double, {', '.join(f'{c} double' for c in chance)}"), "langid-measured")
    sums = found.agg(*[F.sum(c).alias(c) for c in chance]).first()
    each = [f"bits{j}" for j in range(len(model.langs))]
    reached = column_quantiles(found.select(*[F.when(F.col("own") == j, F.col("bits")).alias(c) for j, c in enumerate(each)]),
                               each, [LIMIT_SHARE])
    if sums[0] is not None:
        model.calibrate(list(sums), [r.quantiles[0] if r.n else None for r in reached])
    return model


def identify(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, or all) with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``."""
    added = [("lang_pred", StringType(), pa.string()), ("score", DoubleType(), pa.float64()),
             ("cross_entropy", DoubleType(), pa.float64()), ("rejected", BooleanType(), pa.bool_())]
    taken = {name for name, _, _ in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in taken]
    source = positional(df.select(df[text].cast("string"), *(df[c] for c in kept)))
    schema = StructType([*(StructField(c, f.dataType) for c, f in zip(kept, source.schema.fields[1:], strict=True)),
                         *(StructField(name, kind) for name, kind, _ in added)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            texts = ((t or "") for t in values(batch.column(0)))
            found = [p for some in batched(texts, len, BATCH_CHARS) for p in shared.value.predict(some)]
            columns = list(zip(*found, strict=True)) or [()] * len(added)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, added, strict=True))],
                names=schema.names)

    return source.mapInArrow(scan, schema)
