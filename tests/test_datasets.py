"""Named datasets by domain, their summary, vector tables on disk, runner kinds."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta import fixed as FX
from lexicarta.operators import profile as P
from lexicarta.operators import scoring as SC
from lexicarta.plans import catalog as CAT
from lexicarta.plans import workflows as W
from lexicarta.sources import files


def corpus(spark, base, name, sources):
    rows = [(f" text {i}\nof \"{s}\" ", i % 2, s, None, "test" if i % 5 == 0 else "train") for i, s in enumerate(sources * 10)]
    files.write_split_csvs(spark.createDataFrame(rows, "text string, label int, source string, question string, split string"), base, name)
    return rows


def test_domain_of_a_dataset_on_disk(spark, scratch):
    base = f"{scratch}/{uuid.uuid4().hex}"
    rows = corpus(spark, base, "hc3", list(FX.QA_DOMAINS))
    corpus(spark, base, "turingbench", ["human", "gpt2"])
    whole = {r["doc_id"]: (r["text"], r["split"]) for r in CAT.read_dataset(spark, base, "hc3").collect()}
    assert sorted(t for t, _ in whole.values()) == sorted(r[0] for r in rows)  # blanks at the ends stay
    train, test = CAT.pair(CAT.read_dataset(spark, base, "hc3", domain="finance"))
    assert train.count() + test.count() == 10 and {r["source"] for r in train.collect()} == {"finance"}
    assert all(whole[r["doc_id"]] == (r["text"], "train") for r in train.collect())
    with pytest.raises(ValueError, match="no domain named"):
        CAT.read_dataset(spark, base, "hc3", domain="sports")
    with pytest.raises(ValueError, match="has no domains"):
        CAT.read_dataset(spark, base, "turingbench", domain="finance")
    with pytest.raises(ValueError, match="unknown dataset"):
        CAT.read_dataset(spark, base, "other")
    both = CAT.read_dataset(spark, base, "combined")
    assert both.count() == 70
    ranks = sorted(r["shuffle_rank"] for r in both.where("split = 'test'").collect())
    assert ranks == list(range(1, 15))


def test_summary_on_load(spark):
    df = spark.createDataFrame([("ab", 0, None, "train"), ("abcd", 1, "s", "train"), (None, None, "s", "test")],
                               "text string, label int, source string, split string")
    got = {(r["split"], r["measure"]): r["value"] for r in P.load_summary(df).collect()}
    assert got == {("train", "rows"): 2, ("train", "mean length"): 3, ("train", "label 0"): 1, ("train", "label 1"): 1,
                   ("train", "nulls source"): 1, ("test", "rows"): 1, ("test", "mean length"): None,
                   ("test", "nulls text"): 1, ("test", "nulls label"): 1}
    assert P.load_summary(df.limit(0)).count() == 0


def test_vector_table_on_disk(spark, scratch):
    path = f"{scratch}/{uuid.uuid4().hex}"
    values = np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32)
    table = spark.createDataFrame([(f"w{i}", [float(x) for x in v]) for i, v in enumerate(values)], "token string, vec array<float>")
    files.write_vector_table(table, f"{path}/text")
    got = {r["token"]: r["vec"] for r in files.read_vector_table(spark, f"{path}/text", 3).collect()}
    assert got == {f"w{i}": [float(x) for x in v] for i, v in enumerate(values)}
    table.write.parquet(f"{path}/parquet")
    assert files.read_vector_table(spark, f"{path}/parquet", 3, "parquet").count() == 50
    with pytest.raises(FileNotFoundError):
        files.read_vector_table(spark, f"{path}/none", 3)


def test_vector_lines_of_other_shapes(spark, scratch):
    """A first line of counts, blanks in tokens, CRLF, repeated tokens, wrong lines."""
    path = f"{scratch}/{uuid.uuid4().hex}.txt"
    with open(path, "w", newline="") as f:
        f.write("4 2\nplain 1 2\r\n. . . 3 4\ntwice 0 9\ntwice 1 0 \n\n")
    got = {r["token"]: r["vec"] for r in files.read_vector_table(spark, path, 2).collect()}
    assert got == {"plain": [1, 2], ". . .": [3, 4], "twice": [1, 0]}
    with pytest.raises(Exception, match="not a token and 5 numbers"):
        files.read_vector_table(spark, path, 5).collect()
    with open(path, "a") as f:
        f.write("bad 1 x\n")
    with pytest.raises(Exception, match="no number"):
        files.read_vector_table(spark, path, 2).collect()


def test_encoder_and_padded_kinds(spark, scratch):
    rows = [(i, "one two" if i else "", i % 2, "s", "train" if i % 2 else "test") for i in range(6)]
    ds = spark.createDataFrame(rows, "doc_id long, text string, label int, source string, split string")
    vec = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 2.0])], "token string, vec array<float>")
    out = W.run_features(spark, ds, ["padded", "encoder"], f"{scratch}/{uuid.uuid4().hex}", vec, 2, SC.count_encoder(), max_len=3)
    padded = {r["doc_id"]: r["sequence"] for r in files.load_features(spark, out["padded"]).collect()}
    assert padded[1] == [[1, 0], [0, 2], [0, 0]] and padded[0] == [[0, 0]] * 3 and len(padded) == 6
    coded = files.load_features(spark, out["encoder"])
    assert {r["doc_id"]: r["embedding"] for r in coded.collect()}[1] == [7, 1]
    assert coded.where(F.col("split") == "train").count() == 3
    with pytest.raises(ValueError, match="encoder factory"):
        W.extract(ds, "encoder")


def test_funnel_counts_rows_per_stage(spark):
    from lexicarta.operators import corpus as C
    rows = [(1, "abc"), (2, "abc"), (3, "x"), (4, "x"), (5, "abcd"), (6, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    firsts = C.distinct_texts(df, ["doc_id"], ["doc_id"])
    assert sorted((r["doc_id"], r["n_chars"], r["n_rows"]) for r in firsts.collect()) == [(1, 3, 2), (3, 1, 2), (5, 4, 1), (6, None, 2)]
    got = [(r["stage"], r["n_rows"]) for r in P.row_funnel(df, firsts, 2).orderBy("step").collect()]
    kept = C.min_length(df, 2)
    assert got == [("raw", 7), ("flattened", 7), ("after_length", kept.count()), ("after_dedupe", C.dedupe_first(kept, ["doc_id"]).count())]
    assert [r["n_rows"] for r in P.row_funnel(df.limit(0), firsts.limit(0), 2).orderBy("step").collect()] == [0] * 4
