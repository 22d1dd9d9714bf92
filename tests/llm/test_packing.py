"""Sum-of-squares packing: the rule against its definition, tokens against the tokenizer, pieces against a round trip."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from unitlife.llm import packing, queries

VOCABULARY = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
TEXTS = [
    None, "", " ", "\n\t ", "one", "It's we'll ANSWER'S 12345 a1b2", "Größe İstanbul ΣΑΣ ς é ́x", "日本語の文章。長い 文", "a b c\u0085d\x1ce",
    "<|endoftext|>in<|startoftext|> <|end oftext|>", "\U0001f600\U0001f1e9 👩‍👩‍👧", "x" * 3000, "'s 's's", "a\r\nb\x0bc\x0cd", "\x00 \x01",
    "don't ('tis) a,b;c. naïve, cafe\u0301s e\u0301 3.14abc --x's,", "A\u0301bc d\u0308", "x|<endoftext|>y",
]


def test_ids_are_those_of_the_whole_text(monkeypatch):
    whole = Tokenizer.from_str(VOCABULARY)
    rng = random.Random(2)
    texts = [t for t in TEXTS if t is not None]
    texts += ["".join(rng.choice(["a", "É", " ", "\n", "'s", "9", "-", "́", "日", "Word", "　", "<|endoftext|>", ",", ".", "(", "\u0301", "'", "İ", "\x1c", "Don", "<|", "ÿ", "ſ", "ß", "Ö", "\u0100", "ŉ", "×", "\u017f", "\u0180"]) for _ in range(60)) for _ in range(300)]
    for stretch, cached in ((1 << 14, 1 << 17), (3, 2)):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        monkeypatch.setattr(packing, "CACHED_PIECES", cached)
        coder = packing.Encoder(VOCABULARY)
        for t in [*texts, *texts]:
            assert np.frombuffer(coder.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_every_latin_letter():
    whole, coder = Tokenizer.from_str(VOCABULARY), packing.Encoder(VOCABULARY)
    for a in range(0x21, 0x250):
        for t in (chr(a), f"x{chr(a)}y", f"{chr(a)}\u0301", f"'{chr(a)}s"):
            assert np.frombuffer(coder.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_read_whole_texts():
    other = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    whole, coder = Tokenizer.from_str(other), packing.Encoder(other)
    assert not coder.by_pieces and packing.Encoder(VOCABULARY).by_pieces
    for t in filter(None, TEXTS):
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_long_text_is_read_in_stretches():
    text = "Some words, 42 of them. " * 200_000
    assert packing.Encoder(VOCABULARY).ids(text) == packing.Encoder(VOCABULARY).ids("Some words, 42 of them. ") * 200_000


def squares(counts, window):
    return sum(n * n for level, n in counts.items() if 0 < level < window)


@pytest.mark.parametrize("window, seed", [(8, 1), (16, 2), (64, 3)])
def test_level_minimises_the_sum_of_squares(window, seed):
    rng = random.Random(seed)
    packer = packing.Packer(window, 1 << 30)
    for n in range(400):
        size = rng.choice([1, 2, 3, window // 2, window - 1, window, rng.randint(1, window)])
        counts = Counter({level: len(w) for level, w in packer.open.items() if w})
        assert {level: int(packer.counts[level]) for level in range(1, window) if packer.counts[level]} == counts
        costs = {}
        for level in [0, *counts]:
            if level + size <= window:
                after = counts.copy()
                after[level] -= level > 0
                after[level + size] += 1
                costs[level] = squares(after, window)
        best = min(costs.values())
        assert packer.level_for(size) == max(level for level, c in costs.items() if c == best)
        list(packer.add(n, bytes(4 * size)))


@pytest.mark.parametrize("max_open", [3, 1 << 12])
def test_windows_hold_everything_once_without_padding(max_open):
    rng = random.Random(5)
    for trial in range(60):
        window = rng.choice([4, 16, 64])
        packer = packing.Packer(window, max_open)
        docs = {d: np.array([rng.randrange(1 << 32) for _ in range(rng.choice([1, 2, rng.randint(1, window), 3 * window + 1, window]))], "<u4").tobytes()
                for d in range(rng.choice([0, 1, 2, 50]))}
        closed = [w for d, ids in docs.items() for w in packer.add(d, ids)]
        assert all(sum(len(p[2]) for p in w) == 4 * window for w in closed) and packer.n_open <= max_open
        closed += packer.rest()
        found = {d: bytearray(len(ids)) for d, ids in docs.items()}
        seen = Counter()
        for w in closed:
            size = sum(len(p[2]) for p in w) // 4
            assert size == window or size & (size - 1) == 0
            for d, start, ids, tokens in w:
                assert tokens == len(docs[d]) // 4 and ids
                found[d][4 * start:4 * start + len(ids)] = ids
                seen.update((d, i) for i in range(start, start + len(ids) // 4))
        assert found == docs and set(seen.values()) <= {1} and len(seen) == sum(map(len, docs.values())) // 4
        assert sum(sum(len(p[2]) for p in w) // 4 < window for w in closed) < window.bit_length()


def test_cuts_are_few():
    """Documents shorter than a window are cut only while settling."""
    rng = random.Random(8)
    packer = packing.Packer(256)
    closed = [w for d in range(5000) for w in packer.add(d, bytes(4 * rng.randint(1, 200)))]
    assert all(p[1] == 0 and len(p[2]) == 4 * p[3] for w in closed for p in w)
    whole = Counter(p[0] for w in [*closed, *packer.rest()] for p in w)
    assert sum(n > 1 for n in whole.values()) < 150


def expected(texts, final=2):
    whole = Tokenizer.from_str(VOCABULARY)
    return [whole.encode(t or "", add_special_tokens=False).ids + [final] for t in texts]


def held(rows, ids_of):
    """Checks pieces (document, start, length, crc, tokens, sequence, offset) against every document's ids."""
    covered, sequences = Counter(), {}
    for document, start, length, crc, tokens, sequence, offset in rows:
        ids = ids_of[document]
        assert tokens == len(ids) and length > 0
        assert crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
        covered.update((document, i) for i in range(start, start + length))
        sequences.setdefault(sequence, []).append((offset, length))
    assert set(covered.values()) <= {1} and len(covered) == sum(map(len, ids_of.values()))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_pack(spark, tmp_path):
    texts = [*TEXTS, "long words " * 5000, *(f"text {i} " * (i % 700) for i in range(300))]
    spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pieces string, ids int").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = queries.op12_sum_of_squares_packing(spark, str(tmp_path)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    held(got, dict(enumerate(expected(texts))))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    packed = packing.pack(docs, VOCABULARY)
    assert [r for r in packed.collect() if r.tokens != r.padded or len(r.ids) != 4 * r.tokens] == []
    assert packing.pack(docs.filter("false"), VOCABULARY).collect() == []


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), ("k", "a b"), ("k", "a b"), ("k", None)], "doc_id string, text string")
    got = packing.pieces(packing.pack(docs, VOCABULARY)).collect()
    assert sorted((str(r.document), r.tokens) for r in got if r.start == 0) == [("None", 3), ("k", 1), ("k", 3), ("k", 3)]


def test_whole_small_table(spark):
    """The registered query against the tokenizer, over all documents."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_sum_of_squares_packing(spark, folder).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    held(got, {d.doc_id: ids for d, ids in zip(docs, expected([d.text for d in docs]), strict=True)})
