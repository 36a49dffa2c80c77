"""File sources and sinks: processed split CSVs, raw multi-class CSVs,
nested Q&A JSON/Parquet, and Parquet/JSON persistence of features,
embeddings and metrics.  Schemas are always explicit (no inference).
Parquet partitioned by ``split`` is the native form: a train/test filter
becomes partition pruning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import join_small
from ..schema import MULTICLASS_RAW, NESTED_QA, SPLIT_CSV, VECTORS
from ..session import materialize, staged_table

_SPLITS = ("train", "test")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _require(spark: SparkSession, path: str, what: str) -> None:
    if not _exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header CSV with quoted multi-line fields by Spark's own reader, which
    gives a whole file to one task.  ``read_csv_records`` reads the same
    records with as many tasks as the files have splits."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("quote", '"').csv(path))


#: A line as it is staged: its number in the file split, the parity of the
#: quotes before it in the split, whether its own quotes are odd, and how many
#: records start up to it if the split starts outside or inside a field.
_LINE = "part int, file string, block bigint, line bigint, inside boolean, odd boolean, n_out bigint, n_in bigint, value string"


def _mark_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running line, quote and record-start counts of every file split.

    The lines of a split come in order inside one task, so what is carried
    from batch to batch is one split's counts."""
    last, carry = None, np.zeros(4, np.int64)  # quotes, lines, starts outside, starts inside
    for batch in batches:
        if not batch.num_rows:
            continue
        part, file, block, value = (batch.column(c) for c in ("part", "file", "block", "value"))
        quotes = pc.count_substring(value, pattern='"').to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.is_in(value, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        names = file.dictionary_encode()
        key = np.stack([part.to_numpy(), names.indices.to_numpy(), block.to_numpy()])
        new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

        def running(steps: np.ndarray, at: int) -> np.ndarray:
            """Sums within the split, ``steps`` included."""
            total = np.cumsum(steps)
            total = total - (total - steps)[first]
            return total + np.where(first == 0, carry[at], 0)

        here = (part[0].as_py(), file[0].as_py(), block[0].as_py())
        if here != last:
            carry = np.zeros(4, np.int64)
        sums = running(quotes, 0)
        inside = (sums - quotes) % 2 == 1
        lines = running(np.ones(len(new), np.int64), 1)
        n_out, n_in = running((~inside & ~blank).astype(np.int64), 2), running((inside & ~blank).astype(np.int64), 3)
        last = (part[-1].as_py(), file[-1].as_py(), block[-1].as_py())
        carry = np.array([sums[-1], lines[-1], n_out[-1], n_in[-1]])
        yield pa.RecordBatch.from_arrays(
            [part, file, block, pa.array(lines), pa.array(inside), pa.array(quotes % 2 == 1), pa.array(n_out), pa.array(n_in), value],
            ["part", "file", "block", "line", "inside", "odd", "n_out", "n_in", "value"])


def read_csv_records(spark: SparkSession, paths: Sequence[str], schema: T.StructType, position: str) -> DataFrame:
    """Header CSV files with quoted multi-line fields, read by splits.

    Returns the columns of ``schema``, ``part`` (the place of the record's path
    in ``paths``) and ``position``: the record's place over all ``paths``, the
    files of a path in the order of their names.

    A line starts a record when the quotes before it in its file are even.
    One scan counts quotes and possible record starts per split and stages the
    lines as Parquet in the shared checkpoint folder; prefix sums over one row
    per split then say where every split starts.  Records of one line, and
    lines of records over several, need no order any more: only the latter are
    brought together, by record.

    Lines end with LF or CRLF.  Fields that hold quotes or line ends must be
    quoted, quotes in them doubled (as pandas and Spark write them).  Empty
    lines between records are skipped, files of a header or nothing give no
    row, short records end in nulls; a file whose quotes do not close raises
    when its rows are read."""
    scans = [spark.read.option("lineSep", "\n").text(p).select(
        F.lit(i).alias("part"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value") for i, p in enumerate(paths)]
    lines = staged_table(reduce(DataFrame.unionAll, scans).mapInArrow(_mark_lines, _LINE), "csv-lines")

    splits = lines.groupBy("part", "file", "block").agg(
        F.sum(F.col("odd").cast("int")).alias("odd"), F.max("n_out").alias("n_out"), F.max("n_in").alias("n_in"))
    before = Window.partitionBy("part", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("part", "file")
    splits = (splits.withColumn("starts_in", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
              .withColumn("n", F.when(F.col("starts_in"), F.col("n_in")).otherwise(F.col("n_out")))
              .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .withColumn("records", F.sum("n").over(whole))
              .withColumn("open", F.sum("odd").over(whole) % 2 == 1))
    # one row per file: the header is no record
    files = splits.groupBy("part", "file").agg(F.first("records").alias("records"))
    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "file", F.coalesce(F.sum(F.greatest(F.col("records") - 1, F.lit(0))).over(earlier), F.lit(0)).alias("base"))
    splits = materialize(splits.join(files, ["part", "file"]).select("part", "file", "block", "starts_in", "before", "base", "open"))

    known = join_small(lines, splits, ["part", "file", "block"], known_rows=splits.count())
    unclosed = F.raise_error(F.concat(F.lit("quotes do not close in "), F.col("file"))).cast("boolean")
    known = known.select("part", "file", "block", "line", "base", "odd", "value",
                         F.when(F.col("open"), unclosed).otherwise(F.col("inside") != F.col("starts_in")).alias("inside"),
                         (F.col("before") + F.when(F.col("starts_in"), F.col("n_in")).otherwise(F.col("n_out"))).alias("n"))
    alone = ~F.col("inside") & ~F.col("odd")
    single = known.where(alone & ~F.col("value").isin("", "\r"))
    pieces = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    several = (known.where(~alone).groupBy("part", "file", "n").agg(F.first("base").alias("base"), pieces.alias("pieces"))
               .select("part", "base", "n", F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value")))
    records = single.select("part", "base", "n", "value").unionByName(several).where(F.col("n") > 1)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}
    row = F.from_csv(F.regexp_replace("value", "\r$", ""), schema.simpleString()[len("struct<"):-1].replace(":", " "), options)
    return records.select(row.alias("row"), "part", (F.col("base") + F.col("n") - 2).alias(position)).select("row.*", "part", position)


def _with_positions(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the row position over all its files.

    Spark packs files into tasks by size, so the order of tasks is not the
    order of files.  Inside a file the running id does rise with the rows:
    counts per (file, task) give every piece its offset, pieces ordered by
    file path and first id.  The rows are read once and staged."""
    marked = df.withColumn("__file", F.input_file_name()).withColumn("__mono", F.monotonically_increasing_id())
    marked = staged_table(marked.withColumn("__task", F.shiftright("__mono", 33)), "positions")
    pieces = marked.groupBy("__file", "__task").agg(F.count("*").alias("__n"), F.min("__mono").alias("__lo"))
    # one row per file piece
    earlier = Window.orderBy("__file", "__lo").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__lo")
    table = materialize(pieces.select("__file", "__task", shift.alias("__shift")))
    out = join_small(marked, table, ["__file", "__task"], known_rows=table.count())
    return out.withColumn(name, F.col("__mono") + F.col("__shift")).drop("__file", "__task", "__mono", "__shift")


def _split_name(part: str = "part"):
    return F.element_at(F.array(*[F.lit(s) for s in _SPLITS]), F.col(part) + 1)


def read_split_csvs(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``{base}/{name}_train.csv`` and ``_test.csv`` as one DataFrame with
    a ``split`` column; a missing file is an error.  ``doc_id`` is the row
    position (the reference's only identity): train rows first, then test
    rows, so ids are unique over both splits."""
    paths = [f"{base.rstrip('/')}/{name}_{split}.csv" for split in _SPLITS]
    for split, path in zip(_SPLITS, paths):
        _require(spark, path, f"{split.capitalize()} split")
    rows = read_csv_records(spark, paths, SPLIT_CSV, "doc_id")
    return rows.select(*SPLIT_CSV.names, _split_name().alias("split"), "doc_id")


def read_multiclass_raw(spark: SparkSession, base: str) -> DataFrame:
    """Raw ``train.csv`` / ``test.csv`` (``Generation``, ``label``) with a
    literal ``split`` per file and a file-order key (doc_id, pos=0), unique
    over both splits."""
    paths = [f"{base.rstrip('/')}/{split}.csv" for split in _SPLITS]
    for path in paths:
        _require(spark, path, "Missing split file")
    rows = read_csv_records(spark, paths, MULTICLASS_RAW, "doc_id")
    return rows.select(*MULTICLASS_RAW.names, _split_name().alias("split"), "doc_id", F.lit(0).cast("bigint").alias("pos"))


def read_nested_qa(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S3: nested Q&A records; a source without ``item_id``/``part`` gets
    part 0 and an id from the file order (sources with ids keep them; a
    source that has them on some rows only is refused by the key's users)."""
    fields = [f for f in NESTED_QA.fields if f.name not in ("item_id", "part")]
    schema = T.StructType(fields + [T.StructField("item_id", T.LongType(), True),
                                    T.StructField("part", T.IntegerType(), True)])
    df = _with_positions(spark.read.schema(schema).format(fmt).load(path), "__position")
    return df.select(F.coalesce("item_id", "__position").alias("item_id"),
                     F.coalesce("part", F.lit(0)).alias("part"), "question", "source",
                     "human_answers", "chatgpt_answers")


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One dataset, partitioned by ``split``; CSV with header and quoted
    fields on request."""
    w = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)


def write_split_csvs(df: DataFrame, base: str, name: str, order: Sequence[str] = ()) -> None:
    """S2 in the reference's layout: ``{name}_{split}.csv`` folders with
    text, label, source[, question] columns, texts as they are (blanks at
    their ends too).  With ``order`` the rows are dealt into ranges of these
    columns, so that the positions given on reading follow them."""
    for split in _SPLITS:
        cols = [c for c in ("text", "label", "source", "question") if c in df.columns]
        rows = df.where(F.col("split") == split)
        rows = rows.orderBy(*order) if order else rows
        (rows.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{base.rstrip('/')}/{name}_{split}.csv"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    _require(spark, path, "Dataset")
    return spark.read.parquet(path)


def save_features(df: DataFrame, path: str) -> None:
    """Long-form or sparse-row features (with the label carried
    beside them), or dense embeddings, as Parquet by split when present."""
    w = df.write.mode("overwrite")
    if "split" in df.columns:
        w = w.partitionBy("split")
    w.parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    _require(spark, path, "Features")
    return spark.read.parquet(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON; the result is a handful of rows, so one
    file is written."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_vector_table(spark: SparkSession, path: str, dim: int, fmt: str = "text") -> DataFrame:
    """A published token-vector table as (token, vec): lines ``token v1 ..
    v_dim`` (a first line with two counts, as some tools write, is passed
    over), or Parquet with the columns of ``VECTORS``.

    The last ``dim`` fields are the vector, so a token may hold blanks; lines
    with fewer fields raise, as do fields that are no numbers.  Of several
    lines of one token the greatest vector is kept, so a lookup gives one row
    per token."""
    _require(spark, path, "Vector table")
    if fmt == "parquet":
        rows = spark.read.schema(VECTORS).parquet(path)
    else:
        fields = F.split(F.regexp_replace("value", r"[ \r]+$", ""), " ")
        lines = spark.read.option("lineSep", "\n").text(path).where(F.trim(F.col("value")) != "").select("value", fields.alias("f"))
        lines = lines.where((F.size("f") != 2) | F.lit(int(dim) == 1))
        short = F.raise_error(F.concat(F.lit("not a token and "), F.lit(f"{int(dim)} numbers: "), F.substring("value", 1, 80)))
        n = F.size("f") - F.lit(int(dim))
        rows = lines.select(F.when(n >= 1, F.array_join(F.slice("f", F.lit(1), n), " ")).otherwise(short.cast("string")).alias("token"),
                            F.transform(F.slice("f", n + 1, F.lit(int(dim))), lambda v: v.try_cast("float")).alias("vec"))
        wrong = F.raise_error(F.concat(F.lit("no number in the vector of "), F.col("token"))).cast("array<float>")
        rows = rows.select("token", F.when(F.exists("vec", lambda v: v.isNull()), wrong).otherwise(F.col("vec")).alias("vec"))
    return rows.groupBy("token").agg(F.max("vec").alias("vec"))


def write_vector_table(vectors: DataFrame, path: str) -> None:
    """S12 as text lines ``token v1 .. v_dim``; floats are written so that
    they read back as they were."""
    line = F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda v: v.cast("string")), " "))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)
