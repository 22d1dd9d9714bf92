"""The pipeline on a small corpus with planted cases, and the registered queries against their SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from unitlife.llm import oracle, queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "conversations")
SF = "/root/testdata/sf0.001"


def text(rng, words):
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("corpus")
    items = [(i, text(rng, 30)) for i in range(5)]
    clean = [text(rng, 60) for _ in range(40)]
    near = clean[0].split()
    near[30] = "zzz"
    docs = [(i, t, "aa", f"src{i % 3}", len(t)) for i, t in enumerate(clean)]
    docs += [(100, clean[1], "aa", "src1", 1), (101, " ".join(near), "aa", "src1", 1), (102, f"{text(rng, 20)} {items[2][1]}", "aa", None, 1),
             (103, "12 34 !!", "aa", "src1", 1), (104, None, None, None, None), (105, "", "aa", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs


def test_stages(spark, corpus):
    folder, docs = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language identification", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = rows.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{folder}/stage{len(ids)}"
        stage(spark, rows, folder).write.parquet(out)
        rows = spark.read.parquet(out)
        assert rows.columns == columns
        ids.append(sorted(r.doc_id for r in rows.collect()))
    kept = list(range(40))
    assert ids[0] == [*kept, 100, 101, 102]
    assert ids[1] == [*kept, 102]
    assert ids[2] == kept
    assert set(ids[3]) <= set(kept) and len(ids[3]) > 20
    last = corpus_pipeline.STAGES[-1][1](spark, rows, folder).collect()
    assert sorted(r.doc_id for r in last) == ids[3] and {r.shard for r in last} <= set(range(8))
    assert sorted(str(r) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(map(str, last))


def test_empty_corpus(spark, corpus, tmp_path):
    folder, _ = corpus
    rows = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r) for r in found.fetchall()), key=str)
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_other_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
