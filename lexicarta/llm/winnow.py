"""Benchmark decontamination by winnowing.

A text's words give ``k``-grams; of every run of ``window - k + 1`` grams the
smallest hash is kept as a fingerprint.  A shared window of words has the
same smallest gram on both sides, so joining fingerprints finds every shared
window; each hit is extended to the item's window and compared word by word.
An item shorter than the window is one window of its own, fingerprinted by
all its words.  DataFrame expressions only.

Defined cases: a null or wordless text has no words, windows or hits; null
item ids mark hits but are not counted as items; repeated items count once;
repeated rows are judged alike; an empty benchmark leaves all clean; empty
documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import Staged, ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; null: none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def _grams(hashes: Column, length: int) -> Column:
    """Hash of every ``length`` consecutive words."""
    heads = F.slice(hashes, 1, F.greatest(F.size(hashes) - (length - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(F.lit(length), x, *[F.get(hashes, i + j) for j in range(1, length)]))


def _minima(grams: Column, width: int) -> Column:
    """Smallest of every ``width`` consecutive values."""
    heads = F.slice(grams, 1, F.greatest(F.size(grams) - (width - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.array_min(F.slice(grams, i + 1, width)))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def item_windows(items: DataFrame, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, win, fp, off): every window of every item, the fingerprint
    it selects and the fingerprint's place in it."""
    rows = _hashed(items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = (rows.select("item_id", "words", F.explode(starts).alias("s"))
           .select("item_id", F.slice("words", F.col("s") + 1, window).alias("win")))
    hashed = cut.withColumn("hashes", F.transform("win", lambda w: F.xxhash64(w)))
    whole = hashed.where(F.size("win") == window).withColumn("grams", _grams(F.col("hashes"), k))
    long = whole.withColumn("fp", F.array_min("grams")).select(
        "item_id", "win", "fp", (F.array_position("grams", F.col("fp")) - 1).cast("int").alias("off"))
    size = F.size("hashes")
    all_words = reduce(lambda c, n: F.when(size == n, F.xxhash64(F.lit(n), *[F.get("hashes", F.lit(j)) for j in range(n)])).otherwise(c),
                       range(1, window), F.lit(None).cast("bigint"))
    short = hashed.where(size < window).select("item_id", "win", all_words.alias("fp"), F.lit(0).alias("off"))
    return long.unionByName(short)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", staged: Staged | None = None) -> DataFrame:
    """(doc_id, row_hash, n_words, n_hit, n_items, items, contaminated) of
    every document; contaminated: 20 * n_hit >= n_words > 0 with a hit."""
    staged = staged or Staged(docs.sparkSession)
    windows = staged.write(item_windows(items, window, k, item_id_col, item_text_col))
    shorter = sorted(r[0] for r in windows.select(F.size("win")).distinct().collect() if r[0] < window)  # at most window - 1 lengths
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    tokens = _hashed(texts.select("doc_id", "row_hash", words_of(F.col("text")).alias("words")))

    # fingerprints of every document, one row each
    grams = tokens.select("doc_id", "row_hash", F.size("words").alias("n_words"), "hashes", _grams(F.col("hashes"), k).alias("grams"))
    marks = F.array_distinct(_minima(F.col("grams"), window - k + 1))
    if shorter:
        marks = F.array_distinct(F.concat(marks, *[_grams(F.col("hashes"), n) for n in shorter]))
    prints = staged.write(grams.select("doc_id", "row_hash", "n_words", marks.alias("marks")))
    wanted = windows.select("fp").distinct()
    shared = (prints.select("doc_id", "row_hash", F.explode("marks").alias("fp")).join(wanted, "fp", "left_semi")
              .groupBy("doc_id", "row_hash").agg(F.collect_set("fp").alias("shared")))
    shared = staged.write(shared)

    # only documents with a shared fingerprint are read again
    near = (tokens.alias("t").join(shared.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.row_hash") == F.col("s.row_hash")))
            .select("t.doc_id", "t.row_hash", "t.words", "t.hashes", "s.shared"))
    def places(n):
        return F.transform(_grams(F.col("hashes"), n), lambda g, i: F.struct(g.alias("fp"), i.alias("p")))
    found = F.filter(F.concat(*[places(n) for n in (k, *shorter)]), lambda x: F.array_contains(F.col("shared"), x["fp"]))
    hits = near.select("doc_id", "row_hash", "words", F.explode(found).alias("x"))
    left = F.greatest(F.col("x.p") - (window - k), F.lit(0))
    hits = hits.select("doc_id", "row_hash", F.col("x.fp").alias("fp"), F.col("x.p").alias("p"), left.alias("c"),
                       F.slice("words", left + 1, 2 * window - k).alias("context"))
    key = F.xxhash64("win").alias("win_id")
    unique = windows.select(key, "win", "fp", "off").distinct()
    start = F.col("p") - F.col("off")
    # extension: the item's whole window must stand around the hit
    matched = (hits.join(unique, "fp").where(start >= F.col("c"))
               .where(F.slice("context", F.greatest(start - F.col("c"), F.lit(0)) + 1, F.size("win")) == F.col("win"))
               .select("doc_id", "row_hash", start.alias("s"), F.size("win").alias("len"), "win_id").distinct())
    matched = staged.write(matched)
    covered = (matched.select("doc_id", "row_hash", "s", "len").distinct()
               .select("doc_id", "row_hash", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("at")).distinct()
               .groupBy("doc_id", "row_hash").agg(F.count("*").alias("n_hit")))
    members = windows.where("item_id is not null").select(key, F.col("item_id").cast("string").alias("item")).distinct()
    named = (matched.select("doc_id", "row_hash", "win_id").distinct().join(members, "win_id")
             .groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("item")).alias("items")))
    out = prints.select("doc_id", "row_hash", "n_words").alias("p")
    for side in (covered, named):
        side = side.withColumnsRenamed({"doc_id": "__id", "row_hash": "__hash"})
        out = out.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_hash") == F.col("__hash")), "left").drop("__id", "__hash")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "row_hash", F.col("n_words").cast("bigint").alias("n_words"), n_hit.cast("bigint").alias("n_hit"),
                      F.size(items_).cast("bigint").alias("n_items"), items_.alias("items"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    staged = Staged(docs.sparkSession)
    bad = staged.last(decontaminate(docs, items, id_col=id_col, text_col=text_col, staged=staged, **options).where("contaminated")
                      .select("doc_id", "row_hash").distinct())
    # names are qualified: the caller's columns may have any name
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("b.row_hash"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
