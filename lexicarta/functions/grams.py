"""N-grams counted as packed codes: character n-grams (P15, P16), word
n-grams (P14).

A run of texts is turned into code points; each gets its rank in the run's
alphabet, and an n-gram is the ranks of its characters side by side in one
64-bit code (ranks start at 1, so grams of different length never share a
code).  Grams are counted by sorting codes; only distinct ones are spelled
out again, for every document or, when a vocabulary is fitted, once per run.
Texts are lower-cased and their whitespace is normalised by Spark before.

A text longer than a run is counted piece by piece and its counts are merged,
so memory follows the run and the distinct grams.  Grams too long for one
code are counted as strings.

Word n-grams: Spark cuts the words, a run of documents turns them into numbers
of its own dictionary, and an n-gram is the number of its first n-1 words
beside its last word.  Again only distinct grams are spelled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: Code points of one run.
RUN = 1 << 17
#: Bytes of texts that are decoded at once and share an alphabet.
DECODED = 1 << 20
SPACE = 32
#: Words of one run when counted by document, and over the corpus, where a
#: longer run makes fewer rows; a longer document is a run of its own.
RUN_WORDS, CORPUS_WORDS = 1 << 18, 1 << 21


def normalised(text_col: str, analyzer: str):
    """What windows are cut from: the text, or its words with one space
    before, between and after them."""
    if analyzer == "char":
        return X.char_text(F.col(text_col))
    words = X.whitespace_tokens(F.lower(F.col(text_col)))
    return F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise(F.lit(""))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, first position of each and the end)."""
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = data.to_pybytes()[offsets[0]: offsets[-1]] if data is not None else b""
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32), starts[offsets - offsets[0]]


class Grams:
    """Counts of a run: ``doc`` (place of the text), ``code``, ``tf``."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, n_min: int, n_max: int, words: bool, alphabet: np.ndarray | None = None):
        self.alphabet = np.unique(points) if alphabet is None else alphabet
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        self.fits = self.bits * n_max <= 63
        self.n_max = n_max
        doc, code, tf = [], [], []
        for lo in range(0, len(points), RUN):
            d, c = self._windows(points, starts, lo, min(lo + RUN, len(points)), n_min, words)
            for part, x in zip((doc, code, tf), _counted(d, c, np.ones(len(d), np.int64))):
                part.append(x)
        if len(doc) == 1:
            self.doc, self.code, self.tf = doc[0], code[0], tf[0]
        else:
            self.doc, self.code, self.tf = _counted(*[np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, code, tf)])

    def _windows(self, points, starts, lo, hi, n_min, words):
        """(doc, code) of every gram that starts in [lo, hi)."""
        ranks = np.searchsorted(self.alphabet, points[lo: hi + self.n_max]).astype(np.int64) + 1
        at = np.arange(lo, hi)
        edges = np.clip(starts, lo, hi)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(edges))
        room = starts[owner + 1] - at  # characters of the text from here on
        space = points[lo: hi + self.n_max] == SPACE
        blanks = np.concatenate([[0], np.cumsum(space)])
        docs, codes = [], []
        code = np.zeros(len(at), np.int64)
        last = np.arange(len(at))  # of the window, in the piece
        for n in range(1, self.n_max + 1):
            fit = room >= n
            at, owner, room, code, last = at[fit], owner[fit], room[fit], code[fit], last[fit]
            code = (code << self.bits) | ranks[last]
            keep = np.ones(len(at), bool)
            if words:
                begin = at - lo
                keep = (blanks[last] - blanks[np.minimum(begin + 1, last)]) == 0  # no space inside
                if n < n_min:  # a padded word shorter than n_min is one gram
                    keep &= space[begin] & space[last] & (n > 2)
            elif n < n_min:
                keep[:] = False
            docs.append(owner[keep])
            codes.append(code[keep])
            if words and n == 1 and n_min == 1:  # a space between two words pads both
                twice = space[at - lo] & (at > starts[owner]) & (room > 1)
                docs.append(owner[twice])
                codes.append(code[twice])
            last = last + 1
        return np.concatenate(docs), np.concatenate(codes)

    def corpus(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, tf, df) over all texts of the run."""
        return _by_code(self.code, self.tf, np.ones(len(self.code), np.int64))

    def spell_all(self) -> pa.Array:
        """The grams of ``code``, each distinct one spelled once."""
        code, place = np.unique(self.code, return_inverse=True)
        return self.spell(code).take(pa.array(place))

    def spell(self, code: np.ndarray) -> pa.Array:
        """The grams as UTF-8 strings."""
        length = np.zeros(len(code), np.int64)
        for n in range(1, self.n_max + 1):
            length[(code >> (self.bits * (n - 1))) > 0] = n
        row = np.repeat(np.arange(len(code)), length)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        rank = (code[row] >> (self.bits * (length[row] - 1 - inside))) & ((1 << self.bits) - 1)
        letters = [chr(p).encode() for p in self.alphabet.tolist()]
        sizes = np.array([len(x) for x in letters], np.int64)
        table = np.frombuffer(b"".join(x.ljust(4, b"\0") for x in letters), np.uint8).reshape(-1, 4)
        size = sizes[rank - 1]
        data = table[rank - 1][np.arange(4)[None, :] < size[:, None]]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(length)])]
        return pa.LargeStringArray.from_buffers(len(code), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())


def _by_code(code, tf, df):
    """Sums of ``tf`` and ``df`` by code."""
    if not len(code):
        return code, tf, df
    order = np.argsort(code, kind="stable")
    code = code[order]
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[heads], np.add.reduceat(tf[order], heads), np.add.reduceat(df[order], heads)


def _counted(doc, code, tf):
    """Sums of ``tf`` by (doc, code)."""
    if not len(doc):
        return doc, code, tf
    shift = int(code.max()).bit_length()
    if shift + int(doc.max()).bit_length() <= 63:
        key = (doc << shift) | code
        if (tf == 1).all():
            key.sort()
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[heads] >> shift, key[heads] & ((1 << shift) - 1), np.diff(np.concatenate([heads, [len(key)]]))
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort((code, doc))
    doc, code, tf = doc[order], code[order], tf[order]
    heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]))
    return doc[heads], code[heads], np.add.reduceat(tf, heads)


def _as_strings(text: str, n_min: int, n_max: int, words: bool) -> Counter:
    """Grams of one text, for windows that no code can hold."""
    found = Counter()
    for part in [f" {w} " for w in text.split(" ") if w] if words else [text]:
        if words and len(part) < n_min:
            found[part] += 1
        for n in range(n_min, n_max + 1):
            found.update(part[i: i + n] for i in range(len(part) - n + 1))
    return found


def _spans(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of whole items of at most ``size``; a longer item is
    a run of its own."""
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + size, "right")) - 1)
        yield first, last
        first = last


def _runs(column: pa.Array, n_min: int, n_max: int, words: bool) -> Iterator[tuple[int, object]]:
    """(first text, counts) for runs of whole texts.  Texts are decoded a few
    runs at a time, whatever the size of the batch."""
    ends = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
    for lo, hi in _spans(np.concatenate([[0], ends]), DECODED):
        points, starts = _texts(column.slice(lo, hi - lo))
        alphabet = np.unique(points)
        for first, last in _spans(starts, RUN):
            found = Grams(points[starts[first]: starts[last]], starts[first: last + 1] - starts[first], n_min, n_max, words, alphabet)
            if not found.fits:
                found = [_as_strings(t or "", n_min, n_max, words) for t in column.slice(lo + first, last - first).to_pylist()]
            yield lo + first, found


def document_counts(df: DataFrame, analyzer: str, n_min: int, n_max: int, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keep.., term, tf): every n-gram of every document."""
    source = df.select(*keep, normalised(text_col, analyzer).alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
    names = [*keep, "term", "tf"]

    def work(batches):
        for batch in batches:
            for first, found in _runs(batch.column(len(keep)), n_min, n_max, analyzer == "char_wb"):
                if isinstance(found, Grams):
                    doc, term, tf = found.doc, found.spell_all(), found.tf
                else:
                    rows = [(k, t, n) for k, c in enumerate(found) for t, n in c.items()]
                    doc, term, tf = np.array([r[0] for r in rows], np.int64), pa.array([r[1] for r in rows], pa.string()), [r[2] for r in rows]
                at = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keep))], term, pa.array(tf, pa.int32())], names=names)

    return source.mapInArrow(work, schema)


def _stats(term: pa.Array, tf, df) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term, pa.array(tf, pa.int64()), pa.array(df, pa.int64())], names=["term", "tf", "df"])


def corpus_counts(df: DataFrame, analyzer: str, n_min: int, n_max: int, text_col: str = "text") -> DataFrame:
    """(term, tf, df): total and document frequency of every n-gram, summed
    per run before anything is spelled or shuffled."""

    def work(batches):
        for batch in batches:
            # runs decoded together share their codes (and hold their alphabet until the next ones are decoded)
            for _, group in groupby(_runs(batch.column(0), n_min, n_max, analyzer == "char_wb"), lambda run: id(getattr(run[1], "alphabet", None))):
                counts, spell = [], None
                for _, found in group:
                    if isinstance(found, Grams):
                        counts.append(found.corpus())
                        spell = found.spell
                        continue
                    total, docs = Counter(), Counter()
                    for c in found:
                        total.update(c)
                        docs.update(c.keys())
                    yield _stats(pa.array(list(total), pa.string()), list(total.values()), [docs[t] for t in total])
                if counts:
                    code, tf, n = _by_code(*[np.concatenate(x) for x in zip(*counts)])
                    yield _stats(spell(code), tf, n)

    partial = df.select(normalised(text_col, analyzer).alias("__text")).mapInArrow(work, "term string, tf bigint, df bigint")
    return partial.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


# ---------------------------------------------------------------- word n-grams

def _word_runs(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(first document, first word of each document and the end, words) of
    runs of whole documents."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    words = column.flatten()
    for first, last in _spans(starts, size):
        yield first, starts[first: last + 1] - starts[first], words.slice(starts[first], starts[last] - starts[first])


def _word_grams(starts: np.ndarray, words: pa.Array, n_min: int, n_max: int, by_doc: bool):
    """For each n: (spelled grams, place of each one's first word in the order
    of all, the documents in that order).  Grams are distinct in the run, or
    with ``by_doc`` in each document."""
    spelled = words.dictionary_encode()
    number = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bits = max(1, len(spelled.dictionary).bit_length())
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    room = starts[doc + 1] - np.arange(len(number))  # words of the document from here on
    at = np.arange(len(number))
    prefix = doc if by_doc else np.zeros(len(number), np.int64)
    for n in range(1, n_max + 1):
        fit = room[at] >= n
        at, prefix = at[fit], prefix[fit]
        if not len(at):
            return
        key = (prefix << bits) | number[at + n - 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        if n >= n_min:
            begin = at[order[heads]]
            parts = [spelled.dictionary.take(pa.array(number[begin + k])) for k in range(n)]
            yield pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0], heads, doc[at[order]]
        if n < n_max:
            prefix = np.empty(len(order), np.int64)
            prefix[order] = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(order)]])))


def _words(df: DataFrame, keep: Sequence[str], text_col: str) -> DataFrame:
    return df.select(*keep, X.word_tokens(F.col(text_col)).alias("__words"))


def word_document_counts(df: DataFrame, n_min: int, n_max: int, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keep.., term, tf): every word n-gram of every document."""
    source = _words(df, keep, text_col)
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
    names = [*keep, "term", "tf"]

    def work(batches):
        for batch in batches:
            for first, starts, words in _word_runs(batch.column(len(keep)), RUN_WORDS):
                for term, heads, docs in _word_grams(starts, words, n_min, n_max, True):
                    at = pa.array(docs[heads] + first)
                    tf = pa.array(np.diff(np.concatenate([heads, [len(docs)]])), pa.int32())
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keep))], term, tf], names=names)

    return source.mapInArrow(work, schema)


def word_corpus_counts(df: DataFrame, n_min: int, n_max: int, text_col: str = "text") -> DataFrame:
    """(term, tf, df): total and document frequency of every word n-gram,
    summed per run before anything is spelled or shuffled."""

    def work(batches):
        for batch in batches:
            for _, starts, words in _word_runs(batch.column(0), CORPUS_WORDS):
                for term, heads, docs in _word_grams(starts, words, n_min, n_max, False):
                    new = np.concatenate([[True], docs[1:] != docs[:-1]])  # the order is stable: a gram's documents ascend
                    new[heads] = True
                    tf = np.diff(np.concatenate([heads, [len(docs)]]))
                    yield _stats(term, tf, np.add.reduceat(new, heads, dtype=np.int64))

    partial = _words(df, [], text_col).mapInArrow(work, "term string, tf bigint, df bigint")
    # most grams of a run occur once in a task: dealt as they are, not hashed twice
    return partial.repartition("term").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
