"""Classification metrics: confusion matrix, accuracy, weighted / macro
precision, recall and F1, ROC-AUC, per-domain breakdown, report and model
comparison table.

Conventions of the reference's library: classes are those seen in
``label`` or ``prediction`` of the group; a 0/0 precision, recall or F1
is 0; weighted averages use the true support; macro F1 is the plain mean
over the classes; ROC-AUC counts ties as one half and is NULL for a group
with a single true class (the library raises there).

Plan: one pass over the predictions builds (group, label, prediction, score)
counts with map-side partial aggregation, checkpointed; everything else is
computed on those rows.  For the AUC they are dealt once by ranges of the
score: a task ranks its range alone, for every group and for all of them, and
the ranges' totals are the offsets between tasks.  Overall and per-domain
metrics share the pass, the ranges and the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

METRIC_COLUMNS = ("accuracy", "f1_weighted", "f1_macro", "precision_weighted", "recall_weighted")


def confusion_counts(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """(keys.., label, prediction, n) for the pairs that occur.  Rows with a
    null label or prediction are no pairs (see ``excluded_rows``)."""
    return df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(*keys, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Dense (keys.., label, prediction, n) over the classes seen in
    either column of the group, zero cells included.  The class list of a
    group is tiny, so the dense grid is built from it, not from the data."""
    conf = confusion_counts(df, keys, label, prediction)
    classes = conf.groupBy(*keys).agg(F.array_sort(F.array_union(
        F.collect_set(F.col(label)), F.collect_set(F.col(prediction)))).alias("__cls"))
    grid = (classes.select(*keys, F.explode("__cls").alias(label), "__cls")
            .select(*keys, label, F.explode("__cls").alias(prediction)))
    out = grid.join(conf, [*keys, label, prediction], "left")
    return out.select(*keys, label, prediction, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def _scored(score: str):
    return F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))


def excluded_rows(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str | None = "probability") -> DataFrame:
    """One row of counts: what the metrics leave out (null label or
    prediction) and what only the AUC leaves out (null or NaN score)."""
    unusable = F.col(label).isNull() | F.col(prediction).isNull()
    unranked = ~unusable & ~_scored(score) if score is not None else F.lit(False)
    return df.agg(F.count_if(unusable).alias("n_unusable"), F.count_if(unranked).alias("n_unranked"))


def metrics_from_counts(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A12-A14 from (keys.., label, prediction, n).  Every count is one row of
    its true class and one of its predicted class; both sums by class and by
    group use the one exchange by group."""
    keys = list(keys)
    side = lambda cls, support, tp, pred: F.struct(cls.alias("cls"), support.alias("support"), tp.alias("tp"), pred.alias("pred_n"))
    n, none = F.col("n").cast("double"), F.lit(0.0)
    true_side = side(F.col("label"), n, F.when(F.col("label") == F.col("prediction"), n).otherwise(none), none)
    sides = conf.repartition(*keys).select(*keys, F.inline(F.array(true_side, side(F.col("prediction"), none, none, n))))
    per_class = sides.groupBy(*keys, "cls").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "pred_n")])
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    den = F.col("pred_n") + F.col("support")
    f1 = F.when(den > 0, F.lit(2.0) * F.col("tp") / den).otherwise(F.lit(0.0))
    per_class = per_class.select(*keys, "support", "tp", prec.alias("p"), rec.alias("r"), f1.alias("f1"))
    tot = F.sum("support")
    return per_class.groupBy(*keys).agg(
        tot.cast("bigint").alias("n"),
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("support") * F.col("f1")) / tot).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("support") * F.col("p")) / tot).alias("precision_weighted"),
        (F.sum(F.col("support") * F.col("r")) / tot).alias("recall_weighted"),
    )


def score_counts(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                 score: str = "probability") -> DataFrame:
    """(keys.., score, pos, neg): one row per distinct score of a group.  Rows
    with a null label or a null or NaN score cannot be ranked and are left out."""
    return df.where(F.col(label).isNotNull() & _scored(score)).groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _dealt_by_score(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of the score; ``__part`` numbers the ranges in
    rising order.  Equal scores share a range."""
    return rows.repartitionByRange("score").withColumn("__part", F.spark_partition_id())


def _range_sums(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., __part, p, n, u) of ``ranked(keys.., __part, score, pos,
    neg)``: positives, negatives, and the pairs won inside the range
    (W3: ``pos * (neg below + neg / 2)``)."""
    w = Window.partitionBy(*keys, "__part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(w), F.lit(0)).cast("double")
    won = F.col("pos") * (below + F.col("neg") * F.lit(0.5))
    return (ranked.select(*keys, "__part", "pos", "neg", won.alias("won")).groupBy(*keys, "__part")
            .agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"), F.sum("won").alias("u")))


def _auc_from_ranges(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., roc_auc): the negatives of the ranges before are the offset of
    a range; a few rows per group."""
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0.0))
    won = sums.select(*keys, "p", "n", (F.col("u") + F.col("p") * before).alias("won"))
    pairs = F.sum("p") * F.sum("n")
    return won.groupBy(*keys).agg(F.when(pairs > 0, F.sum("won") / pairs).alias("roc_auc"))


def auc_from_score_counts(sc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact ROC-AUC (ties count one half) per group from distinct-score
    counts: AUC = sum(pos * (neg below + neg / 2)) / (P * N).

    No task holds all the scores of a group: each ranks one range of scores,
    and ranges are put together by their totals.  ``sc`` is read twice (the
    ranges are found from a sample): pass a materialised table."""
    keys = list(keys) or ["__all"]
    ranked = _dealt_by_score(sc if keys != ["__all"] else sc.withColumn("__all", F.lit(1)))
    return _auc_from_ranges(_range_sums(ranked, keys), keys).drop("__all")


def roc_auc(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "probability") -> DataFrame:
    """ROC-AUC of ``score`` (probability of class 1) per group."""
    return auc_from_score_counts(materialize(score_counts(df, keys, label, score)), keys)


def prediction_counts(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                      prediction: str = "prediction", score: str | None = "probability") -> DataFrame:
    """The single pass over the predictions: (keys.., label, prediction[,
    score], n), checkpointed.  Confusion counts and distinct-score counts are
    both sums over it, so every metric below reads this table, not the data.
    Its size is bounded by the distinct (group, label, prediction, score)
    combinations."""
    cols = [*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")]
    if score is not None:
        cols.append(F.col(score).cast("double").alias("score"))
    used = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return materialize(used.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")))


#: Group names of the tables behind a report: all rows, or one domain.
_OVERALL, _DOMAIN = "o", "d"


def _report(pc: DataFrame, domains: bool, overall: bool, scored: bool) -> DataFrame:
    """(scope, domain, metrics..) from ``prediction_counts`` by domain."""
    def groups(by_domain: DataFrame, all_rows: DataFrame) -> DataFrame:
        parts = []
        if domains:
            parts.append(by_domain.where(F.col("domain").isNotNull()).withColumn("g", F.concat(F.lit(_DOMAIN), F.col("domain").cast("string"))))
        if overall:
            parts.append(all_rows.withColumn("g", F.lit(_OVERALL)))
        columns = ["g", *[c for c in all_rows.columns if c != "domain"]]
        return parts[0].select(columns) if len(parts) == 1 else parts[0].select(columns).unionByName(parts[1].select(columns))

    conf = pc.groupBy("domain", "label", "prediction").agg(F.sum("n").cast("bigint").alias("n"))
    out = metrics_from_counts(groups(conf, conf), ["g"])
    if scored:
        dealt = _dealt_by_score(pc.where(_scored("score")).select("domain", "label", "score", "n"))
        is_positive = F.col("label") == 1
        # sums by (range, score) need no further exchange
        ranked = dealt.groupBy("domain", "__part", "score").agg(
            F.sum(F.when(is_positive, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(is_positive, F.lit(0)).otherwise(F.col("n"))).alias("neg"))
        together = ranked.groupBy("__part", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        sums = groups(_range_sums(ranked, ["domain"]), _range_sums(together, []))
        out = out.join(_auc_from_ranges(sums, ["g"]), "g", "left")
    name = F.when(F.col("g") != _OVERALL, F.substring("g", 2, 1 << 30))
    columns = [*METRIC_COLUMNS, *(["roc_auc"] if scored else [])]
    return out.select(F.when(name.isNull(), F.lit("overall")).otherwise(F.lit("domain")).alias("scope"), name.alias("domain"), "n", *columns)


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | None = "probability") -> DataFrame:
    """A12-A15 over the whole set: one row, from one pass over the data."""
    pc = prediction_counts(df, (), label, prediction, score).withColumn("domain", F.lit(None).cast("string"))
    return _report(pc, False, True, score is not None).drop("scope", "domain")


def domain_metrics(df: DataFrame, domain: str = "source", label: str = "label",
                   prediction: str = "prediction", score: str | None = "probability",
                   include_overall: bool = True) -> DataFrame:
    """Metrics per domain (and overall) from one pass over the data.

    Output (scope, domain, n, accuracy, f1_weighted, f1_macro,
    precision_weighted, recall_weighted[, roc_auc]).  Empty domains do not
    appear (F3); rows with a null domain count only in the overall row.
    Overall and per-domain numbers are sums over the same checkpointed
    prediction counts and the same ranges of scores."""
    pc = prediction_counts(df, [F.col(domain).cast("string").alias("domain")], label, prediction, score)
    return _report(pc, True, include_overall, score is not None)


def evaluate(predictions: DataFrame, label: str = "label", prediction: str = "prediction",
             score: str | None = "probability") -> DataFrame:
    """Metrics of an already scored DataFrame (``model.transform``)."""
    return classification_metrics(predictions, label, prediction, score)


def results_table(results: dict[str, DataFrame]) -> DataFrame:
    """One row per model; columns are the union of the metric columns,
    missing ones NULL."""
    out = None
    for name, m in results.items():
        row = m.withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    if out is None:
        raise ValueError("results_table() needs at least one model")
    return out
