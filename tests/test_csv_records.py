"""Files of quoted multi-line records, read by splits."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lexicarta.schema import SPLIT_CSV
from lexicarta.sources import files

WORDS = ["plain", 'with "quotes"', "comma, inside", "line\nend", "blank\n\nline", '"', '""', "", " space ", "é漢😀", "\n", 'a"\n"b']


def written(path, rows, end="\n", last=True):
    """As pandas writes them: quoted where needed, an empty text quoted."""
    def field(v):
        v = "" if v is None else str(v)
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n\r') else v

    body = end.join(["text,label,source,question"] + [",".join(field(v) for v in r) for r in rows])
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(body + (end if last else ""))


@pytest.fixture
def small_splits(spark):
    """Splits of 64 bytes, so that records lie over many of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "64")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def rows_of(seed, n):
    r = random.Random(seed)
    return [(" ".join(r.choice(WORDS) for _ in range(r.randint(1, 12))) + "x", r.randint(0, 1), f"s{i}", r.choice([None, "why\nso?"]))
            for i in range(n)]


@pytest.mark.parametrize("end,last", [("\n", True), ("\r\n", True), ("\n", False), ("\r\n", False)])
def test_equal_to_the_plain_reader_over_many_splits(spark, scratch, small_splits, end, last):
    path = f"{scratch}/{uuid.uuid4().hex}.csv"
    rows = rows_of(1, 60)
    written(path, rows, end, last)
    got = files.read_csv_records(spark, [path], SPLIT_CSV, "at")
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10
    records = [tuple(r[c] for c in SPLIT_CSV.names) for r in got.orderBy("at").collect()]
    assert records == [tuple(r) for r in files.read_csv(spark, path, SPLIT_CSV).collect()]
    assert [r[0] for r in records] == [r[0] for r in rows]
    assert sorted(r["at"] for r in got.collect()) == list(range(60))


def test_quoted_line_ends_of_two_kinds(spark, scratch):
    path = f"{scratch}/{uuid.uuid4().hex}.csv"
    written(path, [("a\r\nb", 1, "s", None), ("c\nd", 0, "t", None)], "\r\n")
    assert [r["text"] for r in files.read_csv_records(spark, [path], SPLIT_CSV, "at").orderBy("at").collect()] == ["a\r\nb", "c\nd"]


def test_one_record_longer_than_many_splits(spark, scratch, small_splits):
    path = f"{scratch}/{uuid.uuid4().hex}.csv"
    long = "\n".join(f'line {i}, "{i}"' for i in range(400))
    written(path, [("first", 0, "s", None), (long, 1, "s", None), ("last", 0, "s", None)])
    got = files.read_csv_records(spark, [path], SPLIT_CSV, "at").orderBy("at").collect()
    assert [(r["at"], r["text"]) for r in got] == [(0, "first"), (1, long), (2, "last")]


def test_positions_over_files_and_paths(spark, scratch, small_splits):
    """Files in the order of their names, whatever their sizes; empty files,
    headers alone and empty lines count for nothing."""
    import os
    base = f"{scratch}/{uuid.uuid4().hex}"
    os.makedirs(f"{base}/d_train.csv")
    first, second, test = rows_of(2, 5), rows_of(3, 40), rows_of(4, 7)
    written(f"{base}/d_train.csv/a.csv", first)
    written(f"{base}/d_train.csv/b.csv", [])
    open(f"{base}/d_train.csv/c.csv", "w").close()
    written(f"{base}/d_train.csv/d.csv", second)
    written(f"{base}/d_test.csv", test)
    with open(f"{base}/d_test.csv", "a", encoding="utf-8", newline="") as f:
        f.write("\n\r\nend,1,s,\n")
    got = files.read_split_csvs(spark, base, "d").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(53))
    assert [r["text"] for r in got] == [r[0] for r in first + second + test] + ["end"]
    assert [r["split"] for r in got] == ["train"] * 45 + ["test"] * 8


def test_quotes_that_do_not_close(spark, scratch):
    path = f"{scratch}/{uuid.uuid4().hex}.csv"
    with open(path, "w") as f:
        f.write('text,label,source,question\n"open,1,s,\nmore,1,s,\n')
    with pytest.raises(Exception, match="quotes do not close"):
        files.read_csv_records(spark, [path], SPLIT_CSV, "at").collect()


def test_several_tasks_read_one_file(spark, scratch, small_splits):
    path = f"{scratch}/{uuid.uuid4().hex}.csv"
    written(path, rows_of(5, 100))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.lit(0).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    marked = lines.mapInArrow(files._mark_lines, files._LINE).withColumn("task", F.spark_partition_id())
    assert marked.select("task").distinct().count() > 10
    assert marked.agg(F.max("line")).first()[0] < 20
