"""Streaming use of the stateless operators.

The reference has no streaming; its cleaning, length filter, binarising
and frozen-vocabulary lookup are row-local, so they run unchanged on a
streaming DataFrame (the vocabulary join is stream-static and broadcast,
its size bounded by ``max_features``).  First-wins dedupe is not offered on
streams: it needs an event time and ``dropDuplicatesWithinWatermark``,
which the corpora do not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as X
from ..operators import corpus as C
from ..operators.vocab import TermVectorizerModel
from ..session import ensure_checkpoint_dir


def cleaned_stream(spark: SparkSession, path: str, schema: StructType, min_chars: int = C.MIN_CHARS_MULTICLASS,
                   text_col: str = "text", fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """readStream -> clean (P1) -> length filter (F1)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = r.load(path)
    return C.min_length(df.withColumn(text_col, X.clean_text(text_col)), min_chars, text_col)


def featurize_stream(stream: DataFrame, model: TermVectorizerModel, key: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Apply a fitted vocabulary to a stream: long form (key, term_idx,
    value) of counts or un-normalised weights (the L2 norm needs a
    per-document regroup, which a stream does not get without state)."""
    return model._weighted(stream, key, text_col, ())


def start_to_parquet(stream: DataFrame, sink_path: str, name: str, checkpoint: str | None = None,
                     available_now: bool = True) -> StreamingQuery:
    """writeStream to Parquet with a checkpoint under the session's shared
    checkpoint folder (exactly-once file sink, restartable after failure)."""
    spark = stream.sparkSession
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = stream.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.queryName(name).start()


def with_arrival_time(stream: DataFrame) -> DataFrame:
    return stream.withColumn("arrived_at", F.current_timestamp())
