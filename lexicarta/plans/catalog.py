"""Named datasets.  ``hc3`` (nested Q&A path, stratified split),
``turingbench`` (multi-class path, given splits) and ``combined`` (their
union, tagged by corpus), each one DataFrame with a ``split`` column,
registered as temp views so SQL users see the same names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as FX
from ..operators import corpus as C
from ..operators import split as S
from ..sources import files
from ..sources import tables as T

DATASETS = ("hc3", "turingbench", "combined")
#: The dataset that is all others together.
UNION = "combined"


def qa_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA path end to end: flatten -> clean -> >= 20 -> dedupe -> split
    (label x source, 20 % test, seed 42).  The row key is the answer's
    position (item, label, part, index); the split is fitted on the key and
    the strata and applied lazily."""
    nested = T.nested_qa(spark, sf_dir)
    position = ("item_id", "label", "part", "idx")
    keyed = lambda df: df.withColumn("key", F.concat_ws("-", *position))
    narrow = keyed(C.prepare_qa(nested, C.MIN_CHARS_QA, keep=[*position, "source"]))
    model = S.fit_split(narrow, ("label", "source"), key="key", test_size=0.2, seed=42)
    return model.transform(keyed(C.prepare_qa(nested, C.MIN_CHARS_QA)))


def multiclass_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-class path: given splits, per-split dedupe, >= 50 chars."""
    return C.prepare_multiclass(T.multiclass_raw(spark, sf_dir), C.MIN_CHARS_MULTICLASS)


def combined_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + M5: both corpora, missing columns NULL, duplicates kept; key
    (corpus, original key columns) as one ``row_key`` string; the reference
    shuffles each combined split, which here is a reproducible
    ``shuffle_rank`` inside each split (seed 42)."""
    c = C.combine({"hc3": qa_dataset(spark, sf_dir), "turingbench": multiclass_dataset(spark, sf_dir)})
    c = c.withColumn("row_key", F.concat_ws(":", "corpus",
                                            F.coalesce(F.col("key"), F.concat_ws("-", "doc_id", "pos"))))
    return S.shuffled_rank(c, key="row_key", by=["split"])


def load_dataset(spark: SparkSession, sf_dir: str, name: str, register: bool = True, domain: str | None = None,
                 domains: Iterable[str] = FX.QA_DOMAINS) -> DataFrame:
    """S5 + F2: a named dataset; ``domain`` keeps one domain of the Q&A corpus
    in both splits, which are those of the whole corpus."""
    builders = {"hc3": qa_dataset, "turingbench": multiclass_dataset, "combined": combined_dataset}
    _check(name, builders, domain)
    df = C.domain_filter(builders[name](spark, sf_dir), domain, domains)
    if register:
        df.createOrReplaceTempView(name)
    return df


def load_splits(spark: SparkSession, sf_dir: str, name: str, domain: str | None = None,
                domains: Iterable[str] = FX.QA_DOMAINS) -> tuple[DataFrame, DataFrame]:
    """The reference's (train, test) pair; the filter on ``split`` is a
    partition filter when the dataset is read back from a partitioned
    write."""
    return pair(load_dataset(spark, sf_dir, name, False, domain, domains))


def read_dataset(spark: SparkSession, base: str, name: str, domain: str | None = None,
                 domains: Iterable[str] = FX.QA_DOMAINS) -> DataFrame:
    """S1 + S5 + F2 from the processed CSV files under ``base``: ``hc3``,
    ``turingbench`` or their union, tagged by corpus and shuffled inside each
    split by a reproducible ``shuffle_rank``."""
    _check(name, DATASETS, domain)
    if name != "combined":
        return C.domain_filter(files.read_split_csvs(spark, base, name), domain, domains)
    c = C.combine({corpus: files.read_split_csvs(spark, base, corpus) for corpus in ("hc3", "turingbench")})
    c = c.withColumn("row_key", F.concat_ws(":", "corpus", "doc_id"))
    return S.shuffled_rank(c, key="row_key", by=["split"])


def pair(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("split") == "train"), df.where(F.col("split") == "test")


def _check(name: str, known: Iterable[str], domain: str | None) -> None:
    if name not in known:
        raise ValueError(f"unknown dataset {name!r}; choose from {DATASETS}")
    if domain is not None and name != "hc3":
        raise ValueError(f"{name} has no domains")
