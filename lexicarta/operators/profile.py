"""Corpus profiling: label distribution, length stats, null counts,
domain x label crosstab, row funnel, per-dataset summary, head sample.

Each profile is one aggregate (partial aggregation on the map side, a
tiny final stage); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_NAMES = {0: "human", 1: "ai"}


def label_distribution(df: DataFrame, label_col: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """A1: rows per label, largest first (null labels are not counted)."""
    return (df.where(F.col(label_col).isNotNull())
            .groupBy(*keys, label_col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(*keys, F.desc("n"), label_col))


def length_stats(df: DataFrame, text_col: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """A2: row count and mean text length in code points."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.avg(F.length(text_col)).alias("avg_chars"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A3: nulls per column, only columns with at least one null; one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns
    ])).alias("s")).select("s.*")
    return stacked.where(F.col("n_null") > 0)


def domain_label_crosstab(df: DataFrame, source_col: str = "source", label_col: str = "label",
                          labels: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per source, one count column per label (missing = 0).

    Pivot values are given, so Spark does not run an extra job to find them.
    """
    piv = (df.where(F.col(source_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(source_col).pivot(label_col, list(labels)).count())
    piv = piv.na.fill(0, [str(v) for v in labels])
    return piv.select(source_col, *[F.col(str(v)).alias(f"n_{LABEL_NAMES.get(v, v)}") for v in labels])


def row_funnel(raw_rows: DataFrame, firsts: DataFrame, min_chars: int, split: DataFrame | None = None) -> DataFrame:
    """A5: rows at each stage: raw -> flattened -> after length -> after
    dedupe [-> train / test].

    ``firsts`` has one row per distinct text with its length and number of
    rows (``corpus.distinct_texts``); as all rows of a text have its length,
    three stages are sums over that one narrow table."""
    long_enough = F.col("n_chars") >= F.lit(int(min_chars))
    sums = firsts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("flattened"),
                      F.coalesce(F.sum(F.when(long_enough, F.col("n_rows"))), F.lit(0)).alias("after_length"),
                      F.count_if(long_enough).alias("after_dedupe"))
    steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(c).alias("stage"), F.col(c).alias("n_rows")) for i, c in enumerate(sums.columns)]
    out = raw_rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(0).alias("step"), F.lit("raw").alias("stage"), "n_rows")
    out = out.unionByName(sums.select(F.inline(F.array(*steps))))
    if split is not None:
        sp = split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
        out = out.unionByName(sp.select(F.when(F.col("split") == "train", F.lit(4)).otherwise(F.lit(5)).alias("step"),
                                        F.col("split").alias("stage"), "n_rows"))
    return out


def corpus_summary(tagged: DataFrame, keys: Sequence[str] = ("dataset", "split"), text_col: str = "text",
                   label_col: str = "label", union: str | None = None) -> DataFrame:
    """Per dataset and split: rows, label counts, mean length, nulls.
    ``union`` adds a dataset of this name, all others (the first key) put
    together, from the sums of the others: the rows are read once."""
    first, *rest = keys
    sums = tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label_col) == 0).alias("n_label0"),
        F.count_if(F.col(label_col) == 1).alias("n_label1"),
        F.sum(F.length(text_col)).alias("__chars"),
        F.count(text_col).alias("__texts"),
    )
    if union is not None:
        numbers = [c for c in sums.columns if c not in keys]
        twice = sums.withColumn(first, F.explode(F.array(F.col(first), F.lit(union))))
        sums = twice.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers])
    mean = F.when(F.col("__texts") > 0, F.col("__chars").cast("double") / F.col("__texts"))
    return sums.select(first, *rest, "n_rows", "n_label0", "n_label1", mean.alias("avg_chars"),
                       (F.col("n_rows") - F.col("__texts")).alias("n_null_text"))


def load_summary(df: DataFrame, keys: Sequence[str] = ("split",), text_col: str = "text", label_col: str = "label") -> DataFrame:
    """A1-A3 of a dataset as it is loaded: (keys.., measure, value) with the
    rows, the mean length, the rows of each label and the nulls of each column
    that has any.  One scan: counts per (keys, label), then one row per label
    and measure."""
    columns = [c for c in df.columns if c not in keys]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"__null_{i}") for i, c in enumerate(columns)]
    per_label = df.groupBy(*keys, F.col(label_col).cast("string").alias("__label")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.length(text_col)).alias("__chars"), F.count(text_col).alias("__texts"), *nulls)
    number = lambda c: F.sum(c).cast("double")
    # one entry per label
    labels = F.collect_list(F.when(F.col("__label").isNotNull(), F.struct(
        F.concat(F.lit("label "), "__label").alias("measure"), F.col("__n").cast("double").alias("value"))))
    whole = per_label.groupBy(*keys).agg(
        labels.alias("__labels"), number("__n").alias("__rows"), (number("__chars") / number("__texts")).alias("__mean"),
        *[number(f"__null_{i}").alias(f"__null_{i}") for i in range(len(columns))])
    entry = lambda name, c: F.struct(F.lit(name).alias("measure"), F.col(c).alias("value"))
    fixed = F.array(entry("rows", "__rows"), entry("mean length", "__mean"))
    empty = F.array(*[entry(f"nulls {c}", f"__null_{i}") for i, c in enumerate(columns)])
    all_ = F.concat("__labels", fixed, F.filter(empty, lambda e: e["value"] > 0))
    return whole.select(*keys, F.inline(all_))


def head_sample(df: DataFrame, n: int = 3, width: int = 200, order_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """First ``n`` texts by key, cut to ``width`` characters.  The limit is
    the feature (a peek), and ``orderBy().limit()`` is a TakeOrdered, no
    global sort."""
    return (df.orderBy(order_col).limit(n)
            .select(order_col, F.substring(text_col, 1, width).alias("text_head")))
