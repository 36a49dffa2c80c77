"""Substring removal with repeated-phrase automata.

A window is a run of ``width`` words.  Every word covered by a window whose
words also start in a document with a smaller id is removed.

1. Confirm recurring phrases: by winnowing, every window selects the phrase
   of ``PHRASE`` words with the smallest hash inside it, a choice that depends
   on the window's words alone.  Phrases selected in two documents or more
   recur; only windows that select one of them can recur.
2. The windows that select one phrase at one place form a passage (at most
   ``2 * width - PHRASE`` words).  Equal passages become one class with its
   smallest document.
3. Passages are sharded by their phrase, so all windows with equal words
   meet in one shard.  A shard confirms which windows recur in another
   document and takes each at its smallest document alone; it compiles an
   Aho-Corasick automaton over the aligned blocks of ``width // 2`` words of
   those runs (every window holds such a block whole) and streams all its
   passages through it; every hit is extended word by word, and a common run
   of ``width`` words or more with a smaller document is covered.
4. Occurrences of a passage class in its later documents are covered whole.

Defined cases: a null text has no words and stays null; an empty text stays
empty; a document with nothing to remove keeps its text byte for byte; rows
that share an id never remove each other's words; a null id neither removes
nor is removed; an empty table gives no rows; other columns pass untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicarta.llm.common import Staged, Words, extended, grams, iter_words, mix, shuffle_partitions, signed, sliding_argmin

PHRASE = 8
#: Bytes of passages that one automaton takes at a time, whole phrases always.
AUTOMATON_BYTES = 2 << 20
#: Bits of the filter of recurring phrases: a fixed size, any answer is safe.
FILTER_BITS = 1 << 25


def _windows(words, width: int):
    """Start of every window inside one document and the place of the phrase
    that it selects."""
    flat = grams(words.hashes, PHRASE)
    m = len(words.hashes) - width + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, flat, none
    doc = np.repeat(np.arange(len(words.per_doc)), words.per_doc)
    place = sliding_argmin(flat, width - PHRASE + 1)[:m]
    start = np.flatnonzero(doc[:m] == doc[width - 1:])
    return start, place[start], flat, doc


def _phrases(docs: DataFrame, width: int) -> DataFrame:
    """(phrase, doc_id): phrases selected by the windows of each document."""

    def select(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for words in iter_words(batch.column(1), lower=False):
                start, place, flat, doc = _windows(words, width)
                if not len(start):
                    continue
                place = place[np.concatenate([[True], place[1:] != place[:-1]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(flat[place])), pa.array(ids[words.first + doc[place]].astype(np.int64))], names=["phrase", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(select, "phrase bigint, doc_id bigint")


def _filter(recurring: DataFrame) -> bytes:
    """Fixed-size bit table of the recurring phrases, OR-ed on the executors."""
    shift = np.uint64(64 - FILTER_BITS.bit_length() + 1)
    size = FILTER_BITS // 32

    def mark(batches):
        table = np.zeros(size, np.uint32)
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().view(np.uint64)) >> shift).astype(np.int64)
            np.bitwise_or.at(table, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        for k in range(16):
            yield _bits(k, table[k * size // 16:(k + 1) * size // 16])

    def merge(batches):
        tables = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(blob.as_buffer(), np.uint32)
                tables[k] = tables[k] | part if k in tables else part.copy()
        for k, table in tables.items():
            yield _bits(k, table)

    rows = (recurring.select("phrase").mapInArrow(mark, "part int, bits binary").repartition(16, "part")
            .mapInArrow(merge, "part int, bits binary").collect())
    found = {r.part: bytes(r.bits) for r in rows}
    return b"".join(found.get(k, bytes(4 * (size // 16))) for k in range(16))


def _bits(k, table):
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["part", "bits"])


def _passages(docs: DataFrame, width: int, recurring: bytes) -> DataFrame:
    """(phrase, doc_id, row_hash, at, words, passage): the run of windows that
    select a recurring phrase at one place, from word ``at`` on."""
    shift = np.uint64(64 - FILTER_BITS.bit_length() + 1)
    bits = docs.sparkSession.sparkContext.broadcast(recurring)
    names = ["phrase", "doc_id", "row_hash", "at", "words", "passage"]

    def find(batches):
        table = np.frombuffer(bits.value, np.uint32)
        for batch in batches:
            ids, row_hash = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for words in iter_words(batch.column(2), lower=False):
                start, place, flat, doc = _windows(words, width)
                if not len(start):
                    continue
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                last = np.concatenate([first[1:], [len(place)]]) - 1
                phrase = flat[place[first]]
                at = (mix(phrase) >> shift).astype(np.int64)
                keep = (table[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
                first, last, phrase = first[keep], last[keep], phrase[keep]
                a, b = start[first], start[last] + width
                owner = doc[a]
                begin, end = words.starts[a], words.ends[b - 1]
                for lo in range(0, len(a), 20_000):
                    s = slice(lo, lo + 20_000)
                    texts = [b" ".join(words.data[x:y].tobytes().split()) for x, y in zip(begin[s], end[s])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(phrase[s])), pa.array(ids[words.first + owner[s]].astype(np.int64)),
                         pa.array(row_hash[words.first + owner[s]]), pa.array((a - words.offsets[owner])[s].astype(np.int32), pa.int32()),
                         pa.array((b - a)[s].astype(np.int32), pa.int32()), pa.array(texts, pa.binary())], names=names)

    return (docs.where("doc_id is not null").select("doc_id", "row_hash", "text")
            .mapInArrow(find, "phrase bigint, doc_id bigint, row_hash bigint, at int, words int, passage binary"))


def _recurring(words, docs: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(class, from, to): runs of windows that recur in another document, each
    window at its first class only (the one with the smallest document)."""
    flat = grams(words.hashes, width)
    owner = np.repeat(np.arange(len(words.per_doc)), words.per_doc)
    start = np.flatnonzero(owner[: len(flat)] == owner[width - 1:])
    if not len(start):
        return []
    value, doc = flat[start], docs[owner[start]]
    order = np.lexsort((start, doc, value))
    heads = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
    again = np.maximum.reduceat(doc[order], heads) > doc[order[heads]]
    place = np.sort(start[order[heads[again]]])
    if not len(place):
        return []
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (owner[place[1:]] != owner[place[:-1]]), [True]]))
    first, last = place[cut[:-1]], place[cut[1:] - 1]
    base = words.offsets[owner[first]]
    return list(zip(owner[first].tolist(), (first - base).tolist(), (last - base + width).tolist()))


def _covered(classes: DataFrame, width: int) -> DataFrame:
    """(class_id, lo, hi): runs of words of a passage class that also stand
    in a passage of a smaller document."""
    block = width // 2

    def search(ids, docs, passages):
        """Passages of whole phrases."""
        import ahocorasick

        # all words of the batch are one run, as short as the passages are
        parts = list(iter_words(pa.array(passages, pa.binary()), lower=False))
        words = Words(0, np.concatenate([w.per_doc for w in parts]), None, None, np.concatenate([w.hashes for w in parts]), None)
        docs = np.array(docs)
        number = np.unique(words.hashes, return_inverse=True)[1].tolist()
        edges = words.offsets.tolist()
        texts = [tuple(number[a:b]) for a, b in zip(edges, edges[1:])]
        found: dict[tuple, list] = {}
        for k, lo, hi in _recurring(words, docs, width):
            for at in range(lo, hi - block + 1, block):
                found.setdefault(texts[k][at: at + block], []).append((int(docs[k]), k, at, lo, hi))
        if not found:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in found.items():
            places.sort()
            automaton.add_word(key, places)
        automaton.make_automaton()
        for k, text in enumerate(texts):
            own, runs = docs[k], []
            for end, places in automaton.iter(text):
                at = end - block + 1
                for first, other, there, lo, hi in places:
                    if first >= own:
                        break
                    # all windows that hold this block are covered already
                    if any(a <= max(0, end + 1 - width) and b >= min(len(text), at + width) for a, b in runs):
                        break
                    that = texts[other]
                    i, j = at, there
                    while i > 0 and j > lo and text[i - 1] == that[j - 1]:
                        i, j = i - 1, j - 1
                    x, y = end + 1, there + block
                    while x < len(text) and y < hi and text[x] == that[y]:
                        x, y = x + 1, y + 1
                    if x - i >= width:
                        runs.append([i, x])
            for a, b in _merged(runs):
                yield ids[k], a, b

    def stream(batches):
        held, size = ([], [], []), 0
        group, phrase = ([], [], []), None

        def flush():
            rows = list(search(*held))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in
                                                  enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["class_id", "lo", "hi"])

        def close():
            nonlocal size
            if len(group[0]) > 1:  # a lone class has no smaller passage to match
                for h, g in zip(held, group):
                    h.extend(g)
                size += sum(map(len, group[2]))

        for batch in batches:
            for p, *row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if p != phrase:
                    close()
                    group, phrase = ([], [], []), p
                    if size > AUTOMATON_BYTES:
                        yield from flush()
                        held, size = ([], [], []), 0
                for g, value in zip(group, row):
                    g.append(value)
        close()
        if held[0]:
            yield from flush()

    sharded = classes.select("phrase", "class_id", "first_doc", "passage").repartition(shuffle_partitions(classes.sparkSession), "phrase")
    return sharded.sortWithinPartitions("phrase").mapInArrow(stream, "class_id bigint, lo int, hi int")


def _merged(runs):
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def repeated_spans(docs: DataFrame, staged: Staged, width: int = 50) -> DataFrame:
    """(doc_id, row_hash, spans): merged word ranges to remove, packed as
    little-endian 32-bit pairs, for documents that have any."""
    recurring = (_phrases(docs, width).groupBy("phrase").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
                 .where("x < y").select("phrase"))
    found = staged.write(_passages(docs, width, _filter(recurring))
                         .withColumn("class_id", F.xxhash64("phrase", "words", "passage")))
    classes = staged.write(found.groupBy("phrase", "class_id", "passage").agg(F.min("doc_id").alias("first_doc")))
    places = found.select("class_id", "doc_id", "row_hash", "at", "words")
    firsts = classes.select("class_id", "first_doc")
    covered = staged.write(_covered(classes, width))
    # later documents of a class lose the whole passage, its first document what smaller passages cover
    # all three grow with the corpus: one plan for every size, skewed classes are split at run time
    placed = places.join(firsts.hint("merge"), "class_id")
    later = placed.where("doc_id > first_doc").select("doc_id", "row_hash", F.col("at").alias("lo"), (F.col("at") + F.col("words")).alias("hi"))
    own = (placed.where("doc_id = first_doc").join(covered.hint("merge"), "class_id")
           .select("doc_id", "row_hash", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))
    spread = later.unionByName(own).repartition(shuffle_partitions(docs.sparkSession), "doc_id", "row_hash")

    def pack(batches):
        key, lo, hi, rows = None, [], [], []
        for batch in batches:
            for d, h, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (d, h) != key:
                    if key is not None:
                        rows.append((*key, lo, hi))
                    key, lo, hi = (d, h), [], []
                if hi and a <= hi[-1]:
                    hi[-1] = max(hi[-1], b)
                else:
                    lo.append(a)
                    hi.append(b)
            if rows:
                yield _span_batch(rows)
                rows = []
        if key is not None:
            yield _span_batch([*rows, (*key, lo, hi)])

    return spread.sortWithinPartitions("doc_id", "row_hash", "lo").mapInArrow(pack, "doc_id bigint, row_hash bigint, spans binary")


def _span_batch(rows):
    spans = [np.stack([np.array(lo, "<i4"), np.array(hi, "<i4")], 1).tobytes() for _, _, lo, hi in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array(spans, pa.binary())], names=["doc_id", "row_hash", "spans"])


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of the text (kept words
    joined by one space) and with n_words, n_removed, kept_sha256 (of the kept
    words joined by one space).  Columns of those names are replaced."""
    staged = Staged(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         F.xxhash64(text_col).alias("row_hash"))
    spans = staged.last(repeated_spans(narrow, staged, width))
    added = ["n_words", "n_removed", "kept_sha256"]
    base = docs.drop(*[c for c in (*added, "__id", "__text", "__row_hash", "__spans") if c != text_col])
    schema = extended(base.schema, n_words=T.LongType(), n_removed=T.LongType(), kept_sha256=T.StringType())
    text_at = base.columns.index(text_col)

    def rewrite(batches):
        for batch in batches:
            texts, found = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1)
            n_words, n_removed, digests = [], [], []
            for i, text in enumerate(texts):
                words = text.encode().split() if text is not None else []
                removed = 0
                if found[i].is_valid:
                    spans = np.frombuffer(found[i].as_buffer(), "<i4").reshape(-1, 2)
                    kept, at = [], 0
                    for a, b in spans.tolist():
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    removed, body = len(words) - len(kept), b" ".join(kept)
                    texts[i] = body.decode()
                else:
                    body = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(removed)
                digests.append(hashlib.sha256(body).hexdigest())
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(digests, pa.string())], names=[*batch.schema.names[:-1], *added])

    marked = base.withColumn("__id", F.col(id_col).cast("bigint")).withColumn("__row_hash", F.xxhash64(text_col))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__row_hash"), F.col("spans").alias("__spans"))
    joined = marked.join(spans.hint("merge"), ["__id", "__row_hash"], "left").select(*base.columns, "__spans")
    return joined.mapInArrow(rewrite, schema)
