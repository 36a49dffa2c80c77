"""Corpus operators: flatten, binarise, clean, length filter, first-wins
dedupe, domain filter, union of corpora, split leakage audit."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import MIN_CHARS_MULTICLASS, MIN_CHARS_QA  # noqa: F401  (re-exported)
from ..functions import text as X
from ..schema import HUMAN_LABEL
from ..session import materialize
from .joins import fits_broadcast


def flatten_qa(nested: DataFrame) -> DataFrame:
    """One row per answer of a nested Q&A item.

    Human answers get label 0, machine answers label 1; question and source
    repeat; empty arrays give no rows.  ``(item_id, label, part, idx)`` is the
    order the reference walks the items in and feeds first-wins dedupe.
    """
    def tag(arr: str, label: int) -> Column:
        return F.transform(F.coalesce(F.col(arr), F.array().cast("array<string>")),
                           lambda x, i: F.struct(x.alias("text"), F.lit(label).alias("label"),
                                                 i.alias("idx")))

    return (nested
            .select("item_id", "part", "question", "source",
                    F.inline(F.concat(tag("human_answers", 0), tag("chatgpt_answers", 1))))
            .select("item_id", "label", "part", "idx", "text", "source", "question"))


def binarise(df: DataFrame, source_col: str = "source", out: str = "label") -> DataFrame:
    """``label = (source != 'human')`` with pandas null semantics
    (a null source is not 'human', so it is class 1)."""
    return df.withColumn(out, (~F.col(source_col).eqNullSafe(F.lit(HUMAN_LABEL))).cast("int"))


def rename_multiclass(raw: DataFrame) -> DataFrame:
    """P3 + P4 + P5: ``Generation -> text``, ``label -> source``,
    binary label, text as string with null -> 'nan'."""
    df = raw.withColumnsRenamed({"label": "source"}).withColumnRenamed("Generation", "text")
    df = binarise(df)
    return df.withColumn("text", X.text_or_nan("text"))


def min_length(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """keep rows whose (already cleaned) text has >= n code points."""
    return df.where(F.length(F.col(text_col)) >= F.lit(n))


def length_funnel(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """F1 drop count: rows before, kept, dropped in one aggregate."""
    keep = F.length(F.col(text_col)) >= F.lit(n)
    return df.agg(F.count(F.lit(1)).alias("rows_in"),
                  F.count_if(keep).alias("rows_kept"),
                  F.count_if(~keep | keep.isNull()).alias("rows_dropped"))


def dedupe_first(df: DataFrame, order_cols: Sequence[str], text_col: str = "text",
                 scope: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """Drop duplicate texts, first row (by ``order_cols``, nulls first)
    wins; only the columns ``keep`` (all by default) travel and are returned.
    ``scope`` columns, e.g. ``['split']``, separate texts that may stay apart.

    Winners are found on fixed-width keys alone: the text's SHA-256 and the
    order, by hash aggregates that combine a hot text map-side.  The table of
    repeated texts and their first rows is checkpointed (the one eager step);
    under the bound in bytes it is broadcast and ``df`` is read again, its
    texts neither sorted nor shuffled.  Beyond the bound the rows that lose
    are marked, and left out by ``_without``.
    Rows equal in text and order are one row.  If the text is not kept, the
    rows are narrow and are aggregated as they are.
    """
    cols = list(keep or df.columns)
    if text_col not in cols:
        order = F.struct(*[F.col(c) for c in order_cols])
        grouped = (df.groupBy(*[F.col(c) for c in scope], F.sha2(F.col(text_col), 256).alias("__text_key"))
                   .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("__first")))
        return grouped.select("__first.*")
    keys = {"__digest": F.coalesce(F.unhex(F.sha2(F.col(text_col), 256)), F.lit(b""))}
    if scope:
        keys["__scope"] = F.to_json(F.struct(*[F.col(c) for c in scope]))
    text_key = list(keys)
    keys |= {f"__order{i}": c for i, c in enumerate(_order_codes(df, order_cols))}
    codes = [k for k in keys if k not in text_key]
    keyed = df.select(*cols, *[c.alias(k) for k, c in keys.items()])
    rows = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    first = rows.withColumn("__rows", F.col("__n"))
    for at in range(len(codes) - 1, -1, -1):  # least last code within equal earlier ones, then the one before it
        carried = [F.min_by(c, codes[at]).alias(c) for c in [*codes[at + 1:], "__n"]]
        first = first.groupBy(*text_key, *codes[:at]).agg(F.min(codes[at]).alias(codes[at]), *carried, F.sum("__rows").alias("__rows"))
    first = materialize(first.where("__rows > 1").select(
        *text_key, *[F.col(c).alias(f"{c}_first") for c in codes], (F.col("__n") > 1).alias("__repeated")))
    found = first.agg(F.count(F.lit(1)).alias("n"), F.count_if("__repeated").alias("repeated")).first()
    wins = reduce(and_, [F.col(c) == F.col(f"{c}_first") for c in codes])
    if not found["n"]:
        return keyed.select(*cols)
    if fits_broadcast(first, found["n"]):
        told = keyed.join(F.broadcast(first), text_key, "left")
        kept = told.where(F.col("__repeated").isNull() | (wins & ~F.col("__repeated")))
        again = told.where(wins & F.col("__repeated"))
    else:
        marked = materialize(rows.join(first, text_key).where(~wins | F.col("__repeated")).select(*keys, (wins & F.col("__repeated")).alias("__again")))
        kept = _without(keyed, marked.drop("__again"), list(keys))
        again = keyed.join(marked.where("__again").drop("__again"), list(keys), "left_semi")
    kept = kept.select(*cols)
    return kept.unionByName(again.dropDuplicates(text_key).select(*cols)) if found["repeated"] else kept


def _order_codes(df: DataFrame, order_cols: Sequence[str]) -> list[Column]:
    """The order as 64-bit numbers, without nulls (which come first): what
    hash aggregates can take the least of.  Two neighbouring columns of at
    most 32 bits share one.  Columns of other types are ordered as one struct."""
    kinds = [df.schema[c].dataType for c in order_cols]
    if not all(isinstance(k, T.IntegralType) for k in kinds):
        return [F.struct(*[F.col(c) for c in order_cols])]
    out, half = [], None
    for c, kind in zip(order_cols, kinds):
        if isinstance(kind, T.LongType):
            out += [half] * (half is not None)
            out.append(F.coalesce(F.col(c), F.lit(-(1 << 63))))
            half = None
            continue
        code = F.coalesce(F.col(c).cast("bigint"), F.lit(-(1 << 31)))
        if half is None:
            half = code
        else:
            out.append(F.shiftleft(half, 32).bitwiseOR(code + F.lit(1 << 31)))
            half = None
    return out + [half] * (half is not None)


#: Bits of a row filter per marked row, and at most.
_FILTER_BITS, _MOST_FILTER_BITS = 16, 1 << 28


def _without(rows: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` but those whose ``keys`` are in the large table ``marked``.  A
    bitmap of it is broadcast: rows whose bit is clear stay where they are,
    only the others are shuffled to be compared with the table."""
    n_marked = marked.count()
    size = min(_MOST_FILTER_BITS, 1 << max(15, (_FILTER_BITS * n_marked - 1).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(size)) + 1
    bitmap = (marked.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit"))
              .groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    tested = (rows.withColumn("__bucket", F.bitmap_bucket_number(place))
              .join(F.broadcast(bitmap), "__bucket", "left").withColumn("__set", is_set))
    far = tested.where("__set").select(*rows.columns).join(marked.hint("shuffle_hash"), keys, "left_anti")
    return tested.where("not __set").select(*rows.columns).unionByName(far)


def distinct_texts(df: DataFrame, order_cols: Sequence[str], keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row per distinct text, without the text: the ``keep`` columns of
    its first row, its length ``n_chars`` and its number of rows ``n_rows``."""
    sized = df.withColumn("__key", F.sha2(F.col(text_col), 256)).withColumn("__length", F.length(text_col))
    order = F.struct(*[F.col(c) for c in order_cols])
    grouped = sized.groupBy("__key").agg(
        F.min_by(F.struct(*[F.col(c) for c in keep]), order).alias("__first"),
        F.min("__length").alias("n_chars"), F.count(F.lit(1)).alias("n_rows"))
    return grouped.select("__first.*", "n_chars", "n_rows")


def domain_filter(df: DataFrame, domain: str | None, allowed: Iterable[str] | None = None,
                  source_col: str = "source") -> DataFrame:
    """keep one domain; an unknown domain is rejected up front."""
    if domain is None:
        return df
    if allowed is not None:
        allowed = sorted(set(allowed))
        if domain not in allowed:
            raise ValueError(f"no domain named {domain!r}; known domains are {', '.join(allowed)}")
    return df.where(F.col(source_col) == F.lit(domain))


def _first_of_length(df: DataFrame, order_cols: Sequence[str], min_chars: int, keep: Sequence[str] | None,
                     scope: Sequence[str] = ()) -> DataFrame:
    """First-wins dedupe, then the length test.

    The length is a function of the dedupe key (the cleaned text), so whole
    duplicate groups pass or fail together and the result is the same, while
    a filter placed before the dedupe is pushed into the scan by Catalyst
    with the cleaning regex inlined, running it twice per row.  With ``keep``
    the text's length travels instead of the text."""
    if keep is None:
        return min_length(dedupe_first(df, order_cols, scope=scope), min_chars)
    sized = df.withColumn("__length", F.length("text"))
    firsts = dedupe_first(sized, order_cols, scope=scope, keep=[*keep, "__length"])
    return firsts.where(F.col("__length") >= F.lit(min_chars)).drop("__length")


def prepare_qa(nested: DataFrame, min_chars: int = MIN_CHARS_QA, keep: Sequence[str] | None = None) -> DataFrame:
    """QA path: flatten -> clean (P2) -> first-wins dedupe -> min length.
    ``keep`` names the columns wanted when the text is not."""
    flat = flatten_qa(nested).withColumn("text", X.clean_text_qa("text"))
    return _first_of_length(flat, ["item_id", "label", "part", "idx"], min_chars, keep)


def prepare_multiclass(raw: DataFrame, min_chars: int = MIN_CHARS_MULTICLASS,
                       order_cols: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """Multi-class path, per given split: rename, binarise, clean (P1),
    dedupe inside each split (cross-split copies survive), min length."""
    df = rename_multiclass(raw).withColumn("text", X.clean_text("text"))
    return _first_of_length(df, list(order_cols), min_chars, None, scope=["split"])


def prepare_labelled(df: DataFrame, min_chars: int = MIN_CHARS_MULTICLASS,
                     cleaner=X.clean_text, keep: Sequence[str] | None = None) -> DataFrame:
    """Flat labelled corpus: clean -> first-wins by doc_id -> min length.
    ``keep`` names the columns wanted when the text is not."""
    return _first_of_length(df.withColumn("text", cleaner("text")), ["doc_id"], min_chars, keep)


def split_leakage(df: DataFrame, text_col: str = "text", split_col: str = "split") -> DataFrame:
    """D2 audit: texts present in more than one split (one row per text,
    with the number of rows per split).  Partial aggregation keeps a hot
    text to one row per map task."""
    key = F.sha2(F.col(text_col), 256)
    return (df.groupBy(key.alias("text_key"))
            .agg(F.count_if(F.col(split_col) == "train").alias("n_train"),
                 F.count_if(F.col(split_col) == "test").alias("n_test"),
                 F.min(F.length(text_col)).alias("n_chars"))
            .where((F.col("n_train") > 0) & (F.col("n_test") > 0)))


def combine(corpora: dict[str, DataFrame]) -> DataFrame:
    """R2: union of corpora by column name, missing columns null, duplicates
    kept; a ``corpus`` tag makes (corpus, doc_id) the key."""
    out = None
    for name, df in corpora.items():
        tagged = df.withColumn("corpus", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("combine() needs at least one corpus")
    return out

