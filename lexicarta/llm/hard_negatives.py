"""Hard-negative mining by the threshold algorithm over sorted lists.

Every component becomes floor(256 * x), so scores are integer inner products.
The rows are read in blocks of bounded size; a block holds, per dimension, the
list of its rows in the order of that component.  For an anchor the lists are
read step by step from the end that its sign asks for (sorted access); every
row met for the first time is scored whole (random access).  No row still
unseen can score more than the threshold, the sum of anchor times last value
read over all dimensions, so a block stops as soon as the threshold falls
strictly below the least score still wanted: the k-th positive's, or, for the
windows of negatives, each window's k-th score (its lower end while fewer than
k are found).  Blocks of rows and blocks of anchors meet in a co-group; the
best of all blocks are ranked by a window.

Positives come first, from lists of the anchor's label alone; their scores
give the windows ``low * positive <= 100 * negative <= high * positive``.

Defined cases: rows whose id, label or vector is null, whose vector is empty
or holds a null or non-finite component, or a component beyond 2**16 either
way (its score might not fit a long) take no part; vectors of different
length are never compared; repeated rows are rows of their own, but rows with
the anchor's id are never its positives or negatives, equal anchor rows are
one anchor, and differing rows of one id are anchors of their own; ties go to
the smaller id; an anchor of zeros reads one list to its end; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.llm.common import Staged

#: Rows and anchors that meet in one task (expected sizes of blocks dealt by hash).
BLOCK_ROWS, BLOCK_ANCHORS = 16_384, 4_096
#: Entries of each list that the first step reads; later steps double the depth.
FIRST_STEP = 16
LARGEST = 1 << 16


def integer_rows(rows: DataFrame, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, vec array<bigint>) of the rows that take part."""
    kept = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                       F.col(vec_col).cast("array<double>").alias("vec"))
    good = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return (kept.where("vec_id is not null and label is not null").where(F.coalesce(good, F.lit(False)))
            .select("vec_id", "label", F.transform("vec", lambda x: F.floor(x * 256)).alias("vec")))


class Lists:
    """One sorted list of rows per dimension."""

    def __init__(self, vectors: np.ndarray):
        # doubles where every score is a whole number below 2**53: the same scores, faster
        small = float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2 ** 53
        self.vectors = vectors.astype(np.float64) if small else vectors
        self.order = np.argsort(vectors, 0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, 0)

    def search(self, anchor: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], float]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of every row met before the threshold fell
        strictly below what ``wanted(rows, scores)`` still asks for."""
        n = len(self.vectors)
        anchor = anchor.astype(self.vectors.dtype)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            up = np.zeros(1, np.int64)
        unseen = np.ones(n, bool)
        done, depth = 0, min(FIRST_STEP, n)
        while done < n:
            # sorted access: the next entries of every list, from the end that the anchor's sign asks for
            new = np.zeros(n, bool)
            new[self.order[n - depth: n - done, up]] = True
            new[self.order[done:depth, down]] = True
            met = np.flatnonzero(new & unseen)
            unseen[met] = False
            # random access: whole scores
            rows, scores = np.concatenate([rows, met]), np.concatenate([scores, (self.vectors[met] @ anchor).astype(np.int64)])
            threshold = self.sorted[n - depth, up] @ anchor[up] + self.sorted[depth - 1, down] @ anchor[down]
            if len(rows) == n or threshold < wanted(rows, scores):
                break
            done, depth = depth, min(2 * depth, n)
        return rows, scores


def _kth(scores: np.ndarray, k: int, fewer: float) -> float:
    return np.partition(scores, -k)[-k] if len(scores) >= k else fewer


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{vector length: (places in the table, vectors)}."""
    column = table.column("vec").combine_chunks()
    lengths = np.asarray(column.value_lengths())
    out = {}
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        out[d] = at, np.asarray(column.take(pa.array(at)).flatten(), np.int64).reshape(len(at), d)
    return out


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


_POSITIVES = "anchor bigint, positive_id bigint, positive_score bigint"
_NEGATIVES = "anchor bigint, place bigint, negative_id bigint, negative_score bigint"


def _positives(rows: pa.Table, anchors: pa.Table, k: int) -> Iterator[tuple]:
    """The best ``k`` rows of the anchor's label in this block."""
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    blocks = _by_length(rows)
    lists: dict[tuple[int, int], tuple[np.ndarray, Lists]] = {}
    keys, own, wanted_label = (anchors.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
    for d, (at, vectors) in _by_length(anchors).items():
        if d not in blocks:
            continue
        places, all_vectors = blocks[d]
        for a, vector in zip(at.tolist(), vectors):
            name = d, int(wanted_label[a])
            if name not in lists:
                same = np.flatnonzero(labels[places] == name[1])
                lists[name] = places[same], Lists(all_vectors[same])
            same, index = lists[name]
            if not len(same):
                continue
            other = ids[same] != own[a]
            found, scores = index.search(vector, lambda r, s, o=other: _kth(s[o[r]], k, -np.inf))
            found, scores = found[other[found]], scores[other[found]]
            best = _first(ids[same[found]], scores, k)
            yield from zip([keys[a]] * len(best), ids[same[found[best]]].tolist(), scores[best].tolist())


def _negatives(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> Iterator[tuple]:
    """The best ``k`` rows of another label in each window, in this block."""
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    blocks = {d: (places, Lists(vectors)) for d, (places, vectors) in _by_length(rows).items()}
    keys, own, own_label = (anchors.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
    positive = anchors.column("positive_scores").to_pylist()
    for d, (at, vectors) in _by_length(anchors).items():
        if d not in blocks:
            continue
        places, index = blocks[d]
        for a, vector in zip(at.tolist(), vectors):
            # whole scores s with low * p <= 100 * s <= high * p
            windows = [(-(-low * p // 100), high * p // 100) for p in positive[a]]
            open_ = {w for w in windows if w[0] <= w[1]}
            if not open_:
                continue
            other = (ids[places] != own[a]) & (labels[places] != own_label[a])

            def least(found, scores, other=other, open_=open_):
                scores = scores[other[found]]
                return min(_kth(scores[(scores >= lo) & (scores <= hi)], k, lo) for lo, hi in open_)

            found, scores = index.search(vector, least)
            found, scores = places[found[other[found]]], scores[other[found]]
            for place, (lo, hi) in enumerate(windows):
                inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                best = inside[_first(ids[found[inside]], scores[inside], k)]
                yield from zip([keys[a]] * len(best), [place] * len(best), ids[found[best]].tolist(), scores[best].tolist())


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, work, schema: str) -> DataFrame:
    """``work(block of rows, block of anchors)`` over all pairs of blocks.

    Rows are dealt by their place in the staged files, so repeated ids
    spread like others and a task that runs again deals them the same way."""
    rb, ab = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_anchors // BLOCK_ANCHORS))
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", dealt(rb)).withColumn("ab", upto(ab))
    right = anchors.withColumn("ab", dealt(ab)).withColumn("rb", upto(rb))
    return (left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab"))
            .applyInArrow(lambda x, y: _table(schema, list(work(x, y)) if x.num_rows and y.num_rows else []), schema))


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row that ``is_anchor`` (a condition on vec_id)
    and each of its best ``positives`` rows of the same ``label``, the best
    ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` per cent of the positive's."""
    staged = Staged(rows.sparkSession)
    usable = staged.write(integer_rows(rows, label, id_col, vec_col))
    anchors = staged.write(usable.where(is_anchor).distinct().withColumn("anchor", F.monotonically_increasing_id()))
    sizes = usable.count(), anchors.count()

    found = _met(usable, anchors, *sizes, lambda x, y: _positives(x, y, positives), _POSITIVES)
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    chosen = staged.write(found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives))
    scores = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("chosen"))
    asking = staged.write(anchors.join(scores.select("anchor", F.col("chosen.positive_score").alias("positive_scores")), "anchor"))

    found = _met(usable, asking, *sizes, lambda x, y: _negatives(x, y, negatives, low, high), _NEGATIVES)
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = ranked.join(chosen, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
