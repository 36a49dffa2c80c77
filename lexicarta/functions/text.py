"""Pure Column expressions for text: cleaning, tokenising, n-grams.

All of these are built-in Spark SQL expressions (regexp, higher-order
array functions), so they stay inside whole-stage code generation and
work unchanged on streaming DataFrames.  No Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import col_of

from ..fixed import URL_TOKEN, WORD_TOKEN, WS_CLASS  # noqa: F401  (re-exported)

WS_RUN = WS_CLASS + "+"
WS_RUN2 = WS_CLASS + "{2,}"


def collapse_ws(c) -> Column:
    """Replace every whitespace run with one U+0020."""
    return F.regexp_replace(col_of(c), WS_RUN, " ")


def clean_text(c) -> Column:
    """Drop URL_<digits>, collapse whitespace, strip.

    ``F.trim`` removes U+0020 only, so it runs after the collapse, which has
    already turned every other whitespace character into U+0020.
    """
    return F.trim(collapse_ws(F.regexp_replace(col_of(c), URL_TOKEN, "")))


def clean_text_qa(c) -> Column:
    """P2 (Q&A variant): collapse whitespace first, then drop URL_<digits>;
    a removed placeholder leaves its two neighbouring spaces."""
    return F.trim(F.regexp_replace(collapse_ws(c), URL_TOKEN, ""))


def text_or_nan(c) -> Column:
    """P5: cast to string with null -> 'nan' (pandas ``astype(str)``)."""
    return F.coalesce(col_of(c).cast("string"), F.lit("nan"))


def char_length(c) -> Column:
    """Length in code points."""
    return F.length(col_of(c))


def stratum_key(label, source) -> Column:
    """P7: '<label>_<source>'; a null source keeps the key null."""
    return F.concat(col_of(label).cast("string"), F.lit("_"), col_of(source))


def whitespace_tokens(c) -> Column:
    """P10: ``str.split()``: case kept, punctuation kept, no empty tokens."""
    return F.filter(F.split(col_of(c), WS_RUN), lambda t: t != F.lit(""))


def word_tokens(c) -> Column:
    """Lower-case, then every run of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(WORD_TOKEN), 0)


def truncate(arr, max_len: int) -> Column:
    """First ``max_len`` elements."""
    return F.slice(col_of(arr), 1, int(max_len))


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def word_ngrams(tokens, n_min: int, n_max: int, sep: str = " ") -> Column:
    """All n-grams (n_min..n_max) of a token array joined by one space.

    ``sequence(1, 0)`` counts down, so each n is guarded by the array size.
    Pass a column *reference* (project the tokens first): the array is read
    inside the lambda, where an expression would be re-evaluated per n-gram.
    """
    w = col_of(tokens)

    def grams(n):
        return F.when(
            F.size(w) >= n,
            F.transform(F.sequence(F.lit(1), F.size(w) - n + 1),
                        lambda i: F.array_join(F.slice(w, i, n), sep)),
        ).otherwise(_empty_strings())

    return F.flatten(F.transform(F.sequence(F.lit(int(n_min)), F.lit(int(n_max))), grams))


def with_ngrams(df, tokens: str, n_min: int, n_max: int, out: str, sep: str = " "):
    """P14 (and P16 over code points) as projections: ``g1`` is the token
    array and ``g_k = zip_with(g_{k-1} without its tail, tokens shifted by
    k-1)``, each g_k its own column, so every n-gram is one concat of a
    shorter n-gram and one token (about twice as fast as slicing and joining
    each window).  Adds ``out`` = concat of g_n_min..g_n_max."""
    n = F.size(F.col(tokens))
    empty = _empty_strings()
    names = {1: tokens}
    d = df
    for k in range(2, int(n_max) + 1):
        ln = F.greatest(n - k + 1, F.lit(0))
        prev = F.col(names[k - 1])
        g = F.zip_with(F.slice(prev, 1, ln), F.slice(F.col(tokens), k, ln),
                       lambda a, b: F.concat(a, F.lit(sep), b))
        names[k] = f"__g{k}_{out}"
        d = d.withColumn(names[k], F.when(n >= k, g).otherwise(empty))
    parts = [F.coalesce(F.col(names[k]), empty) for k in range(int(n_min), int(n_max) + 1)]
    d = d.withColumn(out, F.concat(*parts) if len(parts) > 1 else parts[0])
    return d.drop(*[names[k] for k in range(2, int(n_max) + 1)])


def _windows(p: Column, n_min: int, n_max: int) -> Column:
    """All substrings of p with length n_min..n_max (those that fit)."""
    length = F.length(p)

    def grams(n):
        return F.when(
            length >= n,
            F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(p, i, n)),
        ).otherwise(_empty_strings())

    return F.flatten(F.transform(F.sequence(F.lit(int(n_min)), F.lit(int(n_max))), grams))


def char_wb_ngrams(c, n_min: int, n_max: int) -> Column:
    """Character n-grams inside word boundaries.

    Each lower-cased whitespace word is padded with one space on both sides;
    a padded word shorter than ``n_min`` is emitted once, whole.
    """
    words = whitespace_tokens(F.lower(col_of(c)))

    def per_word(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        short = F.when(F.length(p) < n_min, F.array(p)).otherwise(_empty_strings())
        return F.concat(short, _windows(p, n_min, n_max))

    return F.flatten(F.transform(words, per_word))


def char_text(c) -> Column:
    """Text as the ``char`` analyzer sees it: lower-cased, runs of two or
    more whitespace characters turned into one space (single ones stay)."""
    return F.regexp_replace(F.lower(col_of(c)), WS_RUN2, " ")


def code_points(c) -> Column:
    """Array of the text's code points (``(?s).`` matches one code point,
    surrogate pairs included, newlines included)."""
    return F.regexp_extract_all(col_of(c), F.lit("(?s)."), 0)


def char_ngrams(chars, n_min: int, n_max: int) -> Column:
    """Character n-grams from the projected ``code_points(char_text)``
    array.  Windows are ``slice`` + ``array_join`` over the code-point array:
    ``substring`` would rescan the string from its start for every offset."""
    chars = col_of(chars)
    return F.when(chars.isNull(), _empty_strings()).otherwise(word_ngrams(chars, n_min, n_max, sep=""))


def with_term_counts(df, arr, out: str = "terms"):
    """Count equal elements of a string array inside each row.

    Adds ``out: array<struct<term:string, tf:int>>`` sorted by term.  The
    array is sorted once and run lengths are read off the run starts, so a
    document's bag of terms is built in-row, without exploding and
    shuffling (doc, term) pairs.  The sorted array and the run starts are
    separate projections (each referenced many times), so Catalyst keeps
    them materialised instead of re-evaluating them inside the lambdas.
    """
    s_name, st_name = f"__{out}_sorted", f"__{out}_starts"
    d = df.withColumn(s_name, F.sort_array(F.filter(col_of(arr), lambda x: x.isNotNull())))
    s = F.col(s_name)
    n = F.size(s)
    d = d.withColumn(st_name, F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (n > 0) & ((i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1))))),
    ))
    starts = F.col(st_name)
    m = F.size(starts)
    d = d.withColumn(out, F.transform(
        starts,
        lambda st, j: F.struct(
            F.element_at(s, st).alias("term"),
            (F.when(j + 1 < m, F.element_at(starts, j + 2)).otherwise(n + 1) - st).cast("int").alias("tf"),
        ),
    ))
    return d.drop(s_name, st_name)


def explode_tokens(df, key: str, tokens: Column, carry=(), pos: str = "pos", out: str = "token"):
    """Long form (key, carry.., pos 0-based, token).  ``posexplode_outer``
    plus a null filter keeps Catalyst from inferring a ``size(...) > 0``
    filter that would evaluate the tokeniser twice."""
    d = df.select(key, *carry, F.posexplode_outer(tokens).alias(pos, out))
    return d.where(F.col(out).isNotNull())
