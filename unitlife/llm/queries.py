"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlife.llm import (
    chat, decontaminate, divergence, jaccard, langid, mixing, packing, pii, sharding, suffixes, topk, warc, whitening,
)
from unitlife.llm.shared import new_path, stored, table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to deduplicated archives and read back."""
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    index = stored(warc.read_archives(spark, path, payloads=False), "warc-index")
    return warc.resolved(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that aligns with a test item."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id", *(count(kind) for kind in pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"))


def op4_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    alone = docs.filter(F.col("text").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"),
        F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"))
    return jaccard.classes(docs).select(
        F.col("key").alias("doc_id"), "class_id", "copy_of", "n_copies", "n_links").union(alone)


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into eight shards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(light, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that speaks in control strings, formatted, stored and read back."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    read = chat.read_back(stored(chat.windows(rows), "chat"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    joined = lambda part: F.array_join(F.transform("parts", lambda p: p[part]), "")
    return (
        read.select("conv_id", F.size("turns").cast("bigint").alias("n"), F.length("formatted").cast("bigint").alias("chars"),
                    F.struct("window", line.alias("said"), F.array_join("targets", "").alias("target")).alias("part"))
        .groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
             F.count(F.lit(1)).alias("n_windows"), F.sort_array(F.collect_list("part")).alias("parts"))
        .select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
                F.length(joined("target")).cast("bigint").alias("loss_chars"),
                F.sha2(joined("target"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
    )


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold() != 0))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 50 bytes that an earlier one has."""
    return suffixes.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))


# A source's number stands for its domain, as the table has no such column.
DOMAIN = "'d' || pmod(try_cast(regexp_extract(source, '[0-9]+', 0) as int), 4)"
MIX = {"domain": {"d0": 4, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}


def op9_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fifths of all tokens, mixed by domain, language and source."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN))
    return mixing.mix(docs, ("domain", "lang", "source"), (3, 5), MIX, max_epochs=2, seed=7).select(
        "doc_id", "domain", "lang", "source", "epoch", "tokens")


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector among all others."""
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's first eight whitened components."""
    return whitening.whiten(whitening.integers(table(spark, sf_dir, "embeddings")), 8)


def op12_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4,096 tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        packed = packing.pack(table(spark, sf_dir, "documents"), file.read())
    return packing.pieces(packed).select(
        F.col("document").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others, and its most over-used terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_warc_revisits, op2_benchmark_leaks, op3_pii_spans, op4_jaccard_classes, op5_feistel_shards, op6_chat_windows, op7_language_id, op8_repeated_bytes, op9_hierarchical_mix,
        op10_maxscore_topk, op11_feast_whitening, op12_sum_of_squares_packing, op13_source_divergence)}
