"""Reproducible splits: stratified train/test (exact sizes), stratified
subsample, validation carve-out, unstratified split, shuffled ranking.

Sizes follow the reference's library: ``n_test = ceil(test_size * n)``,
``n_train = n - n_test``; per stratum ``floor(c * n_train / n)`` plus one for
the strata with the largest remainders (compared as integers; ties go to
the smaller stratum key).  Inside a stratum rows are ordered by
``md5(seed || '|' || key)`` then ``key``; the first ``train_i`` rows train.

Two physical plans give the same rows:

* ``window``: ``row_number()`` per stratum.  Simple, but one stratum is one
  task, so a stratum holding a third of the data is a third of the job.
* ``bucket`` (default): count rows per (stratum, 16-bit md5 prefix), find the
  one boundary bucket per stratum from those counts, rank only that
  bucket's rows to get the cut-off (hash, key), and assign every row with a
  narrow comparison against a per-stratum table.  No task ever holds a
  whole stratum.  ``fit_split`` reads the key and the strata only and gives
  these cut-offs as a ``SplitModel``, which is applied lazily, to the rows it
  was fitted on, to others or to a stream, and can be saved.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed as FX
from ..session import materialize
from .joins import join_small


def _order_hash(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _stratum(strata: Sequence[str]):
    """Stratum key, never null: rows with a null part form one stratum, whose
    key '' sorts first; all other keys get a prefix, which keeps their order
    and lets the plain equality joins below match every row."""
    parts = []
    for i, c in enumerate(strata):
        if i:
            parts.append(F.lit("_"))
        parts.append(F.col(c).cast("string"))
    return F.coalesce(F.concat(F.lit("="), *parts), F.lit(""))


def allocation(counts: DataFrame, n_train_expr) -> DataFrame:
    """Per-stratum train sizes by largest remainder.

    ``counts``: (stratum, c).  ``n_train_expr(n)`` gives the total train size
    as a Column of the total ``n``.  Products use DECIMAL(38,0) so
    ``c * n_train`` cannot overflow.  The windows run over the counts table
    (one row per stratum), not over the data.
    """
    dec = "decimal(38,0)"
    w_all = Window.partitionBy()
    a = (counts
         .withColumn("n", F.sum("c").over(w_all))
         .withColumn("n_train", n_train_expr(F.col("n")).cast("bigint")))
    prod = F.col("c").cast(dec) * F.col("n_train").cast(dec)
    a = (a.withColumn("base", F.floor(prod / F.col("n").cast(dec)).cast("bigint"))
          .withColumn("rem", (prod % F.col("n").cast(dec)).cast(dec)))
    a = a.withColumn("leftover", F.col("n_train") - F.sum("base").over(w_all))
    a = a.withColumn("rk", F.row_number().over(
        Window.orderBy(F.desc("rem"), F.asc_nulls_first("stratum"))))
    return a.select("stratum", "c", (F.col("base") + F.when(F.col("rk") <= F.col("leftover"), 1).otherwise(0))
                    .cast("bigint").alias("train_i"))


def _n_train_rule(test_size: float | None, test_rows: int | None, train_rows: int | None,
                  min_test: int | None = None):
    def rule(n):
        if train_rows is not None:
            return F.least(F.lit(int(train_rows)).cast("bigint"), n)
        if test_rows is not None:
            return n - F.least(F.lit(int(test_rows)).cast("bigint"), n)
        n_test = F.ceil(F.lit(float(test_size)) * n.cast("double")).cast("bigint")
        if min_test is not None:
            n_test = F.greatest(n_test, F.lit(int(min_test)).cast("bigint"))
        return n - n_test
    return rule


def stratified_split(df: DataFrame, strata: Sequence[str] = ("label", "source"), *, key: str = "doc_id",
                     test_size: float | None = FX.TEST_SIZE, test_rows: int | None = None,
                     train_rows: int | None = None, seed: int = FX.SEED, method: str = "bucket",
                     bucket_hex: int = 4, strict: bool = False, split_col: str = "split",
                     labels: tuple[str, str] = ("train", "test"), min_test: int | None = None,
                     n_train_rule=None) -> DataFrame:
    """M1 (and M2-M4 through the size arguments): add ``split_col``.

    ``key`` must be unique.  ``strict=True`` rejects strata with one member
    (as the reference's library does); otherwise they follow the same rule.
    """
    if n_train_rule is None and test_size is None and test_rows is None and train_rows is None:
        raise ValueError("give test_size, test_rows or train_rows")
    rule = n_train_rule or _n_train_rule(test_size, test_rows, train_rows, min_test)

    if method == "window":
        tr, te = labels
        rows = df.withColumn("__stratum", _stratum(strata)).withColumn("__h", _order_hash(key, seed))
        counts = rows.groupBy(F.col("__stratum").alias("stratum")).agg(F.count(F.lit(1)).alias("c"))
        _check_strict(counts, strict)
        alloc = allocation(counts, rule)
        out = join_small(rows, alloc.select(F.col("stratum").alias("__stratum"), "train_i"), "__stratum", "left", known_rows=counts.count())
        rn = F.row_number().over(Window.partitionBy("__stratum").orderBy("__h", key))
        out = out.withColumn(split_col, F.when(rn <= F.col("train_i"), F.lit(tr)).otherwise(F.lit(te)))
        return out.drop("__stratum", "__h", "train_i")
    if method != "bucket":
        raise ValueError(f"unknown method {method!r}")
    return fit_split(df, strata, key=key, rule=rule, seed=seed, bucket_hex=bucket_hex, strict=strict,
                     split_col=split_col, labels=labels).transform(df)


@dataclass
class SplitModel:
    """One cut-off (hash, key) per stratum: rows up to it train.

    ``cutoffs``: (stratum, hash, key), null where no row of the stratum trains.
    Rows of strata that the fit has not seen train by the overall ``share``."""

    cutoffs: DataFrame
    strata: list[str]
    key: str
    seed: int
    share: float
    n_strata: int
    split_col: str = "split"
    labels: tuple[str, str] = ("train", "test")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (also a stream) with ``split_col``; a narrow comparison."""
        cut = self.cutoffs.select(F.col("stratum").alias("__stratum"), F.col("hash").alias("__hcut"), F.col("key").alias("__kcut"),
                                  F.lit(True).alias("__seen"))
        rows = df.withColumn("__stratum", _stratum(self.strata)).withColumn("__h", _order_hash(self.key, self.seed))
        rows = join_small(rows, cut, "__stratum", "left", known_rows=self.n_strata)
        known = (F.col("__h") < F.col("__hcut")) | ((F.col("__h") == F.col("__hcut")) & (F.col(self.key) <= F.col("__kcut")))
        low = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") < F.lit(self.share * 2.0 ** 32)
        trains = F.coalesce(F.when(F.col("__seen"), known).otherwise(low), F.lit(False))
        out = rows.withColumn(self.split_col, F.when(trains, F.lit(self.labels[0])).otherwise(F.lit(self.labels[1])))
        return out.drop("__stratum", "__h", "__hcut", "__kcut", "__seen")

    def save(self, path: str) -> None:
        """Cut-offs as Parquet, the rest as one JSON row beside them."""
        self.cutoffs.write.mode("overwrite").parquet(f"{path.rstrip('/')}/cutoffs")
        fields = {k: v for k, v in vars(self).items() if k != "cutoffs"}
        self.cutoffs.sparkSession.createDataFrame([(json.dumps(fields),)], "params string").coalesce(1).write.mode("overwrite").text(
            f"{path.rstrip('/')}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SplitModel:
        fields = json.loads(spark.read.text(f"{path.rstrip('/')}/params").first()[0])
        fields["labels"] = tuple(fields["labels"])
        return SplitModel(spark.read.parquet(f"{path.rstrip('/')}/cutoffs"), **fields)


def fit_split(df: DataFrame, strata: Sequence[str] = ("label", "source"), *, key: str = "doc_id", rule=None,
              test_size: float = FX.TEST_SIZE, seed: int = FX.SEED, bucket_hex: int = 4, strict: bool = False,
              split_col: str = "split", labels: tuple[str, str] = ("train", "test")) -> SplitModel:
    """Cut-offs of the stratified split of ``df``, of which only the key and
    the strata are read (and checkpointed: two narrow columns).  ``rule`` gives
    the train size as a Column of the row count; by default a ``test_size``
    share tests."""
    rule = rule or _n_train_rule(test_size, None, None)
    rows = materialize(df.select(F.col(key), _stratum(strata).alias("stratum")))
    rows = rows.withColumn("hash", _order_hash(key, seed)).withColumn("b", F.substring("hash", 1, int(bucket_hex)))
    # at most strata x 16^bucket_hex rows
    bcnt = materialize(rows.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("cnt")))
    counts = bcnt.groupBy("stratum").agg(F.sum("cnt").alias("c"))
    _check_strict(counts, strict)
    alloc = materialize(allocation(counts, rule))
    sizes = alloc.agg(F.count(F.lit(1)).alias("strata"), F.sum("c").alias("n"), F.sum("train_i").alias("train")).first()
    running = Window.partitionBy("stratum").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = join_small(bcnt, alloc.select("stratum", "train_i"), "stratum", known_rows=sizes["strata"]).withColumn("upto", F.sum("cnt").over(running))
    # boundary bucket: the first one that reaches train_i
    need = F.struct("b", (F.col("train_i") - F.col("upto") + F.col("cnt")).alias("need"))
    edge = materialize(upto.where(F.col("upto") >= F.col("train_i")).groupBy("stratum").agg(F.min_by(need, "b").alias("x"))
                       .select("stratum", F.col("x.b").alias("edge"), F.col("x.need").alias("need")))
    near = join_small(rows, edge, "stratum", known_rows=sizes["strata"]).where((F.col("b") == F.col("edge")) & (F.col("need") > 0))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("hash", key))
    cut = near.withColumn("place", place).where(F.col("place") == F.col("need")).select("stratum", "hash", F.col(key).alias("key"))
    cutoffs = materialize(edge.select("stratum").join(cut, "stratum", "left"))
    return SplitModel(cutoffs, list(strata), key, seed, (sizes["train"] or 0) / max(1, sizes["n"] or 0), sizes["strata"], split_col, tuple(labels))


def _check_strict(counts: DataFrame, strict: bool) -> None:
    if strict:
        bad = counts.where(F.col("c") < 2).limit(1).collect()
        if bad:
            raise ValueError(f"stratum {bad[0]['stratum']!r} has a single member")


def stratified_subsample(df: DataFrame, max_samples: int, strata: Sequence[str] = ("label",),
                         key: str = "doc_id", seed: int = 42, **kw) -> DataFrame:
    """M2: keep a stratified sample of ``max_samples`` rows (all rows when
    the input is not larger)."""
    s = stratified_split(df, strata, key=key, train_rows=max_samples, test_size=None, seed=seed, **kw)
    return s.where(F.col("split") == "train").drop("split")


def validation_split(df: DataFrame, val_ratio: float = FX.VAL_RATIO, strata: Sequence[str] = ("label",),
                     key: str = "doc_id", seed: int = FX.SEED, **kw) -> DataFrame:
    """M3: carve a stratified validation set out of a training set;
    ``split`` is 'train' or 'val'."""
    return stratified_split(df, strata, key=key, test_size=val_ratio, seed=seed,
                            labels=("train", "val"), **kw)


def random_split(df: DataFrame, val_fraction: float = FX.RANDOM_VAL_FRACTION, key: str = "doc_id",
                 seed: int = FX.SEED,
                 **kw) -> DataFrame:
    """M4: unstratified split with ``n_val = max(1, int(fraction * n))``;
    ``split`` is 'train' or 'val'."""
    def rule(n):
        n_val = F.greatest(F.floor(F.lit(float(val_fraction)) * n.cast("double")).cast("bigint"),
                           F.lit(1).cast("bigint"))
        return n - F.least(n_val, n)
    return stratified_split(df, (), key=key, seed=seed, labels=("train", "val"), n_train_rule=rule, **kw)


def shuffled_rank(df: DataFrame, key: str = "doc_id", seed: int = FX.SEED, bucket_hex: int = 4,
                  rank_col: str = "shuffle_rank", by: Sequence[str] = ()) -> DataFrame:
    """M5: reproducible shuffle.  ``rank`` (1-based, within each ``by``
    group, e.g. per split) orders rows by ``md5(seed|key)`` then key.  The
    rank is built from per-bucket counts (16-bit hash prefix: at most 65,536
    rows per group) plus a rank inside each bucket, so no single task sorts
    a whole group."""
    by = list(by)
    h = _order_hash(key, seed)
    rows = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, int(bucket_hex)))
    bcnt = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offs = bcnt.withColumn("__off", F.sum("__cnt").over(w) - F.col("__cnt")).select(*by, "__b", "__off")
    n_buckets = 16 ** int(bucket_hex)
    out = join_small(rows, offs, [*by, "__b"], known_rows=None if by else min(n_buckets, 1 << 20))
    rn = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key))
    return out.withColumn(rank_col, (F.col("__off") + rn).cast("bigint")).drop("__h", "__b", "__off")


def expected_sizes(n: int, test_size: float) -> tuple[int, int]:
    """Driver-side helper for tests: (n_train, n_test)."""
    n_test = math.ceil(test_size * n)
    return n - n_test, n_test
