"""Scans of the driver tables and the corpus shapes built from them.

The reference works on a nested Q&A corpus, a raw multi-class corpus and a
flat labelled corpus.  The driver tables stand in for them (FIXTURES.md):
every builder here is a lazy DataFrame over the parquet scans, so column
pruning and filters reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "labels", "conversations", "embeddings", "benchmark", "pages")


# Unset (the default): scans keep their splits.  A local run over a one-row-group
# file may ask for at least so many partitions.
MIN_SCAN_PARTITIONS = "spark.lexicarta.minScanPartitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a text table; the splits are the files' own unless the session
    sets ``MIN_SCAN_PARTITIONS``."""
    df = read_table(spark, sf_dir, name)
    wanted = int(spark.conf.get(MIN_SCAN_PARTITIONS, "0"))
    return df.repartition(wanted) if wanted else df


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat labelled corpus: ``documents JOIN labels USING (doc_id)``.

    ``label = quality``; ``question`` is null (the multi-class shape).
    Both sides grow with the data, so no broadcast is forced: AQE turns the
    join into a broadcast at run time only when the labels side is small.
    """
    docs = read_text_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return (docs.join(labels, "doc_id")
            .select("doc_id", "text", F.col("label").cast("int").alias("label"), "source",
                    F.lit(None).cast("string").alias("question")))


def unlabelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_text_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def nested_qa(spark: SparkSession, sf_dir: str, part_size: int = 256) -> DataFrame:
    """Nested Q&A corpus built from ``conversations``.

    One item per conversation: ``question`` = first user turn, human answers =
    user turns, machine answers = assistant turns, ``source = 'conv' ||
    (conv_id % 5)``.  The answer arrays are cut into parts of ``part_size``
    turns, so no conversation (however long) is collected into one record;
    the (item, label, part, index) order equals the unsliced turn order.
    """
    conv = read_text_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    question = (conv.where(F.col("role") == "user")
                .groupBy("conv_id")
                .agg(F.min_by("text", "turn").alias("question")))
    parts = (conv.where(F.col("role").isin("user", "assistant"))
             .withColumn("part", F.floor(F.col("turn") / part_size).cast("int"))
             .groupBy("conv_id", "part")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))
    parts = parts.select(
        "conv_id", "part",
        F.transform(F.filter("turns", lambda t: t["role"] == "user"), lambda t: t["text"]).alias("human_answers"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]).alias("chatgpt_answers"),
    )
    return (parts.join(question, "conv_id", "left")
            .select(F.col("conv_id").alias("item_id"), "part", "question",
                    F.concat(F.lit("conv"), (F.col("conv_id") % 5).cast("string")).alias("source"),
                    "human_answers", "chatgpt_answers"))


def multiclass_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw multi-class corpus built from ``conversations``: ``Generation`` =
    text, ``label`` = role (``user`` is the human class); the two supplied
    splits are ``conv_id % 5 = 0`` (test) and the rest (train).  The row key
    is (doc_id = conv_id, pos = turn), which is also the file order."""
    conv = read_text_table(spark, sf_dir, "conversations")
    return conv.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"),
        F.col("text").alias("Generation"),
        F.when(F.col("role") == "user", F.lit("human")).otherwise(F.col("role")).alias("label"),
        F.when(F.col("conv_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )


def given_splits(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two given splits for a keyed corpus: ``key % 5 = 0`` is test."""
    return df.withColumn("split", F.when(F.col(key) % 5 == 0, F.lit("test")).otherwise(F.lit("train")))


def dense_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense features with a binary label: ``embeddings`` with
    ``label % 2``, key ``vec_id`` renamed to ``doc_id``."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("features"),
                      (F.col("label") % 2).cast("int").alias("label"))


def prediction_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction set over the labelled corpus: ``prediction = n_chars % 2``,
    ``probability = (doc_id % 101) / 100`` (has ties)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return (docs.join(labels, "doc_id")
            .select("doc_id", "source", F.col("label").cast("int").alias("label"),
                    (F.col("n_chars") % 2).cast("int").alias("prediction"),
                    ((F.col("doc_id") % 101).cast("double") / F.lit(100.0)).alias("probability")))
