"""Registered queries over sf0.001 against their SQL twins, and the pipeline
against brute force stage by stage."""

import duckdb
import pytest
from helpers_llm import bucket, components, contamination, docs_frame, repeats, same
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lexicarta.llm.oracles import ORACLES
from lexicarta.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_registration():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) <= set(names) and "pipeline" in names and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    same(got.select(*columns).collect(), result.fetchall())


def test_language_query_is_accurate(spark):
    found = QUERIES["op1_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert all(r.held_out == (bucket(r.doc_id) == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]

    def text_of(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    one = stages["language_id"](spark, docs, SF).persist()
    assert one.columns == docs.columns and 0.97 * docs.count() <= one.count() <= docs.count()
    two = stages["ngram_jaccard_join"](spark, one, SF).persist()
    rows = text_of(one)
    assert two.columns == docs.columns
    same([(r.doc_id,) for r in two.collect()], [(c[0],) for c in components(rows) if c[0] == c[2] or c[1] == 0])
    three = stages["substring_dedup"](spark, two, SF).persist()
    assert three.columns == docs.columns
    expected = {i: (words - gone, digest) for i, words, gone, digest in repeats(text_of(two))}
    got = {r.doc_id: r for r in three.collect()}
    assert set(got) == set(expected) and all(len((got[i].text or "").split()) == n for i, (n, _) in expected.items())
    assert all(r.n_chars == len(r.text) for r in got.values())
    four = stages["benchmark_decontamination"](spark, three, SF).persist()
    same([(r.doc_id,) for r in four.collect()], [(c[0],) for c in contamination(text_of(three), bench) if not c[5]])
    five = stages["best_fit_packing"](spark, four, SF).collect()
    assert {r.doc_id for r in five} == {i for i, _ in text_of(four)}


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_on_odd_rows(spark):
    docs = docs_frame(spark, [None, "", "12", "a b c", "a b c", "the word " * 80], langs=[None, "en", "en", "en", "de", "en"])
    extra = {"score": 1, "margin": "m", "n_words": -7, "lang_pred": "q", "__id": 5, "__hash": "h", "__own": 9, "row_hash": 3, "__text": "t", "carried_2": 8, "spans": "x"}
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    for _, stage in corpus_pipeline.STAGES[:4]:
        kinds = docs.dtypes
        docs = stage(spark, docs, SF)
        assert docs.dtypes == kinds
        assert {tuple(r)[5:] for r in docs.collect()} == {tuple(extra.values())}
    assert corpus_pipeline.pack(spark, docs, SF).count() > 0
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_stages_leave_no_tables_but_their_last(spark):
    import os

    from lexicarta.llm import ngram_join, phrase_dedup, winnow
    from lexicarta.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{passage} tail {i}" if i < 6 else f"own words of {i} " * 9) for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for step in (lambda: ngram_join.keep_one(docs), lambda: phrase_dedup.remove_repeats(docs), lambda: winnow.clean_documents(docs, bench)):
        before = set(os.listdir(root))
        step().collect()
        new = [f for f in set(os.listdir(root)) - before if f.startswith("staged-")]
        assert [len(os.listdir(f"{root}/{f}")) for f in new] == [1]
