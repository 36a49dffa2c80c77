"""Token-vector features: vector table, token -> vector lookup with OOV
zeros, optional zero padding, masked mean pooling.

Long form is the canonical layout: (doc_id, pos, token, in_vocab, vec).
Only real tokens are stored; padding is produced on request.  The lookup
is a left join on ``token``: broadcast when the vector table is under a
bound in bytes, otherwise a shuffle join whose hot tokens (one word
can hold a third of all rows) are split by AQE's skew-join handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed as FX
from ..functions import sequences as S
from ..functions import text as X
from ..session import materialize
from .joins import MAX_BROADCAST_BYTES, fits_broadcast, join_small, row_bytes
from .vocab import rank_by_ranges


def vector_table_from_corpus(docs: DataFrame, embeddings: DataFrame, text_col: str = "text") -> DataFrame:
    """S12 stand-in: the most frequent whitespace tokens of ``docs`` (count
    desc, token asc) get the embedding whose ``vec_id`` equals their rank
    (0-based), as many as the embedding table has rows.  All tokens are ranked
    by ranges, so no task or driver holds the tokens that are kept."""
    k = embeddings.count()
    toks = X.explode_tokens(docs.select("doc_id", text_col), "doc_id", X.whitespace_tokens(text_col))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n_occ"))
    ranked = rank_by_ranges(counts, [F.desc("n_occ"), F.asc("token")], "rank").where(F.col("rank") < F.lit(int(k)))
    emb = embeddings.select(F.col("vec_id").alias("rank"), F.col("embedding").alias("vec"))
    # at most k rows: checkpointed, so its size check and the lookups reuse it
    return materialize(ranked.join(emb, "rank").select("token", "rank", "n_occ", "vec"))


def zeros(dim: int):
    return F.array_repeat(F.lit(0.0).cast("float"), int(dim))


def token_vectors(docs: DataFrame, vectors: DataFrame, dim: int, max_len: int = FX.TOKEN_VECTOR_MAX_LEN,
                  key: str = "doc_id",
                  text_col: str = "text", carry: Sequence[str] = (), n_vectors: int | None = None) -> DataFrame:
    """Whitespace tokens (case kept), first ``max_len`` of each
    document, each looked up in ``vectors`` (token, vec); unknown tokens get
    the zero vector (F5: ``in_vocab`` = 0)."""
    toks = X.explode_tokens(docs, key, X.truncate(X.whitespace_tokens(text_col), max_len), carry)
    v = vectors.select("token", F.col("vec").alias("__vec"))
    n = n_vectors if n_vectors is not None else v.count()
    joined = join_small(toks, v, "token", "left", known_rows=n, elements=dim)
    return joined.select(key, *carry, "pos", "token",
                         F.col("__vec").isNotNull().cast("int").alias("in_vocab"),
                         F.coalesce(F.col("__vec"), zeros(dim)).alias("vec"))


def padded_sequence(tv: DataFrame, dim: int, max_len: int = FX.TOKEN_VECTOR_MAX_LEN, key: str = "doc_id",
                    docs: DataFrame | None = None) -> DataFrame:
    """Per document an ``array<array<float>>`` of exactly ``max_len``
    vectors (real tokens in order, then zero vectors).  Each document holds at
    most ``max_len`` entries, so the per-document collect is bounded.  With
    ``docs`` given, documents without tokens get all-zero sequences."""
    entries = tv.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "vec"))).alias("__s"))
    return _padded(entries, dim, max_len, key, docs)


def _padded(entries: DataFrame, dim: int, max_len: int, key: str, docs: DataFrame | None) -> DataFrame:
    g = entries if docs is None else docs.select(key).join(entries, key, "left")
    return g.select(key, _sequence(F.col("__s"), dim, max_len).alias("sequence"))


def _sequence(entries, dim: int, max_len: int):
    """The vectors of ordered (pos, vec) entries, zero vectors after them."""
    known = F.transform(entries, lambda e: F.coalesce(e["vec"], zeros(dim)))
    seq = F.coalesce(known, F.array().cast("array<array<float>>"))
    pad = F.array_repeat(zeros(dim), F.greatest(F.lit(int(max_len)) - F.size(seq), F.lit(0)))
    return F.slice(F.concat(seq, pad), 1, int(max_len))


def padded_documents(docs: DataFrame, vectors: DataFrame, dim: int, max_len: int = FX.TOKEN_VECTOR_MAX_LEN,
                     key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``padded_sequence`` of every document.  Documents are dealt and sorted
    as their first words; their vectors come in last (``functions/sequences.py``),
    so no sequence is sorted, spilled or shuffled.  The table is sent to the
    workers up to the broadcast bound; only vectors beyond it, those of the
    rarer words, cross the network, and are joined to the words before that."""
    words = F.array_join(X.truncate(X.whitespace_tokens(text_col), max_len), " ")
    texts = docs.where(F.col(key).isNotNull()).select(key, words.alias("__words"))
    # sorted, as they are read twice: a word has the same number both times
    bags = texts.groupBy(key).agg(F.sort_array(F.collect_list("__words")).alias("__texts"))
    bags = bags.select(key, F.array_remove("__texts", "").alias("__texts"))
    rows = docs.select(key).join(bags, key, "left")
    toks = X.explode_tokens(bags, key, F.split(F.array_join("__texts", " "), " "), pos="__slot").where(F.col("token") != "")
    near, rare, tokens = table_parts(toks, vectors, dim)
    if rare is not None:
        found = toks.join(tokens, "token", "left_anti").join(rare, "token")
        far = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__slot", "__vec"))).alias("__far"))
        rows = rows.join(far, key, "left")
    bound = near.where(F.col("token").isNotNull()).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("__vec"))).alias("__vecs"))
    shared = docs.sparkSession.sparkContext.broadcast(S.packed_table(bound.toArrow(), dim))

    def attach(batches):
        table = S.Vectors(shared.value)
        for batch in batches:
            yield from S.sequences(batch, table, dim, max_len)

    out = T.StructType([docs.schema[key], T.StructField("__pos", T.ArrayType(T.IntegerType())),
                        T.StructField("__v", T.ArrayType(near.schema["__vec"].dataType))])
    v = rows.select(key, "__texts", *([] if rare is None else ["__far"])).mapInArrow(attach, out)
    mixed = F.sort_array(F.arrays_zip(F.col("__pos").alias("pos"), F.col("__v").alias("vec")))
    return v.select(key, F.when(F.col("__pos").isNull(), F.col("__v")).otherwise(_sequence(mixed, dim, max_len)).alias("sequence"))


def table_parts(rows: DataFrame, vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The vector table (token, __vec) in two parts, and the tokens of the
    first.  The first fits a broadcast; the others are None where the whole
    table does.  Otherwise it has the most frequent tokens (by ``n_occ``,
    counted in ``rows`` where the table lacks it)."""
    v = vectors.select("token", F.col("vec").alias("__vec"))
    n = vectors.count()
    if fits_broadcast(v, n, dim):
        return v, None, None
    if "n_occ" in vectors.columns:
        v = vectors.select("token", F.col("vec").alias("__vec"), F.col("n_occ").alias("__n"))
    else:
        counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("__n"))
        v = materialize(v.join(counts, "token", "left").fillna(0, ["__n"]))
    room = MAX_BROADCAST_BYTES // row_bytes(v.drop("__n").schema, dim)
    hist = v.groupBy("__n").agg(F.count(F.lit(1)).alias("__rows"))  # a row per distinct count
    upto = F.sum("__rows").over(Window.orderBy(F.desc("__n")))
    least = hist.select("__n", upto.alias("__upto")).where(F.col("__upto") <= room).agg(F.min("__n")).first()[0]
    common = F.lit(False) if least is None else F.coalesce(F.col("__n") >= F.lit(least), F.lit(False))
    tokens = F.broadcast(v.where(common).select("token").distinct())  # every row of a token lies on one side
    return v.join(tokens, "token", "left_semi").drop("__n"), v.join(tokens, "token", "left_anti").drop("__n"), tokens


def lookup_parts(rows: DataFrame, vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with the vector ``__vec`` of their ``token``, or null, in two
    parts: those found in a broadcast (with those that have no token), and the
    others, shuffled by token.  The second is None where the whole table fits
    a broadcast."""
    near, rare, tokens = table_parts(rows, vectors, dim)
    if rare is None:
        return rows.join(F.broadcast(near), "token", "left"), None
    found = rows.join(F.broadcast(near.withColumn("__found", F.lit(True))), "token", "left")
    found = found.where(F.col("__found") | F.col("token").isNull()).drop("__found")
    far = rows.where(F.col("token").isNotNull()).join(tokens, "token", "left_anti")
    return found, far.join(rare, "token", "left")


def mean_pool(docs: DataFrame, vectors: DataFrame, dim: int, keys: Sequence[str] = ("doc_id",), text_col: str = "text",
              mask=None) -> DataFrame:
    """(keys.., embedding array<double>): mean of the vectors of all
    whitespace tokens of each document, denominator clamped at 1e-9.

    ``mask`` is a condition on the column ``token``: tokens that fail it count
    neither above nor below.  Unknown tokens are zero vectors; a document
    without (unmasked) tokens is the zero vector.  Equal tokens are counted
    inside the document's row; their vectors are looked up and added in the
    same task (or, for the rarer tokens beyond the broadcast bound, where
    their vectors lie), so a document crosses the network as one vector per
    task and no token row is shuffled by document or kept for a sort: each
    component is a sum of its own, in a hash aggregate of a row per document.
    ``keys`` must identify a document."""
    keys = list(keys)
    d = X.with_term_counts(docs.select(*keys, X.whitespace_tokens(text_col).alias("__tokens")), "__tokens", "__bag")
    # an entry without a token keeps documents without any
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("tf")))
    rows = d.select(*keys, F.inline_outer(F.concat(F.coalesce("__bag", F.array().cast("array<struct<term:string,tf:int>>")), none)))
    rows = rows.withColumnRenamed("term", "token")
    if mask is not None:
        rows = rows.where(mask | F.col("token").isNull())
    names = [f"__s{i}" for i in range(int(dim))]

    def sums(known):
        parts = [F.sum(F.col("__vec")[i].cast("double") * F.col("tf")).alias(s) for i, s in enumerate(names)]
        counted = F.sum(F.when(F.col("token").isNotNull(), F.col("tf")).otherwise(0))
        return known.groupBy(*keys).agg(*parts, counted.alias("__total"))

    near, far = lookup_parts(rows, vectors, dim)
    out = sums(near)
    if far is not None:
        out = out.unionByName(sums(far)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in [*names, "__total"]])
    total = F.greatest(F.col("__total").cast("double"), F.lit(FX.MEAN_POOL_EPS))
    return out.select(*keys, F.array(*[F.coalesce(F.col(s), F.lit(0.0)) / total for s in names]).alias("embedding"))


def mean_pool_long(pooled: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """P23 long form (keys.., dim, value) of ``mean_pool``."""
    e = pooled.select(*keys, F.posexplode_outer("embedding").alias("dim", "value")).where(F.col("dim").isNotNull())
    return e.select(*keys, F.col("dim").cast("int").alias("dim"), "value")
