"""Alignment of two tokenizers by diagonal run skipping.

A text is encoded by a byte-level BPE file (A) and a piece model (B); both
end arrays hold the byte offset at which each token ends.  While the arrays
agree at the current index shift, one token of A is one token of B: stretches
of such pairs are jumped by exponential probing, comparing runs of 1, 2, 4, ..
ends at once, and the last run is halved to find where it breaks.  There an
irregular group is resolved by stepping the side that is behind until both
end together, which sets the new shift.

Links are all pairs of tokens of one group; corpus-wide counts of linked id
pairs (documents that hold them) come from one aggregate.  The most frequent
pairs, at most ``HEAD_PAIRS``, are looked up from a broadcast table; all
others are joined, so no pair that fills the corpus is a join key.

Both tokenizers never cross a single space between two other characters
(the space opens the next token), so texts are cut there and every distinct
chunk is encoded once per worker.

Defined cases: a text that is null, empty, or whose joined A or B bytes
differ from space + text has no tokens (zeros, and an empty digest); repeated
rows are documents of their own; a null id stays null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import Staged

#: Pairs in the broadcast table (16 bytes each).
HEAD_PAIRS = 1 << 18
#: Entries of the per-worker table of encoded chunks; it only saves time.
CACHE_ENTRIES = 600_000
_SPACE = "▁"
_LOOSE = re.compile(r"\s | \s|^\s|\s$")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for:
    printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenPair:
    """Both tokenizers, their tokens' bytes, and a table of encoded chunks."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        decode = byte_characters()
        entries = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=False).items())
        self.a_bytes = [b""] * (entries[-1][0] + 1)
        for i, t in entries:
            self.a_bytes[i] = bytes(decode[c] for c in t) if all(c in decode for c in t) else t.encode()
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in pieces]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.uint32) for x in (self.a_bytes, self.b_bytes))
        #: "id," and "id|" of every A id, then "id," and "id;" of every B id
        self.marked = [f"{i}{c}" for x, end in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(x)) for c in ("," + end)]
        self.table: dict[str, tuple[bytes, bytes, bool]] = {}

    def chunks(self, text: str) -> list[str]:
        """Chunks without their opening space; joined by spaces they are the text."""
        if not _LOOSE.search(text):
            return text.split(" ")
        out, open_ = [], None
        for p in text.split(" "):
            if open_ is None:
                open_ = p
            elif open_ and p and not open_[-1].isspace() and not p[0].isspace():
                out.append(open_)
                open_ = p
            else:
                open_ = open_ + " " + p
        return [*out, open_]

    def _learn(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 20_000):
            part = chunks[i: i + 20_000]
            for c, x, y in zip(part, self.a.encode_batch_fast([" " + c for c in part], add_special_tokens=False),
                               self.b.encode(part, num_threads=1)):
                x, raw = x.ids, b" " + c.encode()
                ok = b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y))
                self.table[c] = array("I", x).tobytes(), array("I", y).tobytes(), ok

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(A ids, B ids) of space + text, or None where bytes differ."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers to itself: a collection would only walk the table
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        if len(self.table) > CACHE_ENTRIES:
            self.table.clear()
        cut = [self.chunks(t) if t else [] for t in texts]
        self._learn(list(set(chain.from_iterable(cut)).difference(self.table)))
        get, out = self.table.__getitem__, []
        for chunks in cut:
            a, b, same = zip(*map(get, chunks)) if chunks else ((), (), (False,))
            # a chunk whose bytes differ is shorter or longer in one of them, or holds other bytes: so is the whole
            out.append((np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.uint32)) if all(same) else None)
        return out


def irregular_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Rows (i, i2, j, j2) of the groups that are not one token to one; all
    tokens outside them pair up in order.  The end arrays (uint32) rise to
    the same last value."""
    x, y = a_ends.tobytes(), b_ends.tobytes()
    a, b = memoryview(x).cast("I"), memoryview(y).cast("I")
    n, m = len(a), len(b)
    out = []
    i = j = 0
    while i < n:
        step = 1
        while step <= n - i and step <= m - j and x[4 * i: 4 * (i + step)] == y[4 * j: 4 * (j + step)]:
            i, j, step = i + step, j + step, 2 * step
        while step > 1:  # the run breaks inside the last probe
            step >>= 1
            if step <= n - i and step <= m - j and x[4 * i: 4 * (i + step)] == y[4 * j: 4 * (j + step)]:
                i, j = i + step, j + step
        if i == n:
            break
        p, q = i, j
        while a[p] != b[q]:
            if a[p] < b[q]:
                p += 1
            else:
                q += 1
        out.append((i, p + 1, j, q + 1))
        i, j = p + 1, q + 1
    return np.array(out, np.int64).reshape(-1, 4)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, starts[row] + 0, 1, ..) for all rows."""
    row = np.repeat(np.arange(len(starts)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[row]


#: Groups up to so many links list them one by one.
_FEW = 64


class Aligned:
    """Groups, digest and linked id pairs of one document."""

    def __init__(self, pair: TokenPair, a: np.ndarray, b: np.ndarray):
        odd = irregular_groups(np.cumsum(pair.a_size[a], dtype=np.uint32), np.cumsum(pair.b_size[b], dtype=np.uint32))
        i, i2, j, j2 = odd.T
        a, b = a.astype(np.int64), b.astype(np.int64)
        last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)  # the last of its group
        last_a[_ranges(i, i2 - i - 1)[1]] = False
        last_b[_ranges(j, j2 - j - 1)[1]] = False
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        self.n_groups = len(ends_a)

        # the digest: of every group the A ids, then the B ids, each with the mark that follows it
        marked = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        marked[np.arange(len(a)) + np.concatenate([[0], ends_b])[group_a]] = 2 * a + last_a
        marked[np.arange(len(b)) + ends_a[group_b]] = 2 * (b + len(pair.a_size)) + last_b
        text = "".join(map(pair.marked.__getitem__, marked.tolist()))
        self.sha256 = hashlib.sha256(text[:-1].encode()).hexdigest()

        n_a, n_b = i2 - i, j2 - j
        links = n_a * n_b
        self.n_links = self.n_groups - len(odd) + int(links.sum())
        lined = a * len(pair.b_size)
        alone_a, alone_b = np.ones(len(a), bool), np.ones(len(b), bool)
        alone_a[_ranges(i, n_a)[1]] = False
        alone_b[_ranges(j, n_b)[1]] = False
        few = np.flatnonzero(links <= _FEW)
        row, at = _ranges(np.zeros(len(few), np.int64), links[few])
        row = few[row]
        plain = np.concatenate([lined[alone_a] + b[alone_b], lined[i[row] + at // n_b[row]] + b[j[row] + at % n_b[row]]])
        codes, times = [plain], [np.ones(len(plain), np.int64)]
        for k in np.flatnonzero(links > _FEW):
            (p, n_p), (q, n_q) = (np.unique(v, return_counts=True) for v in (lined[i[k]: i2[k]], b[j[k]: j2[k]]))
            codes.append((p[:, None] + q[None, :]).ravel())
            times.append(np.multiply.outer(n_p, n_q).ravel())
        codes, times = np.concatenate(codes), np.concatenate(times)
        order = np.argsort(codes, kind="stable")
        codes, times = codes[order], times[order]
        heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.pairs, self.times = codes[heads], np.add.reduceat(times, heads)


_pairs: dict[tuple[str, str], TokenPair] = {}


def token_pair(byte_path: str, piece_path: str) -> TokenPair:
    """One pair per worker process and files."""
    name = byte_path, piece_path
    if name not in _pairs:
        _pairs[name] = TokenPair(*name)
    return _pairs[name]


_ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                      ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_ALIGNED_DDL = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                "pairs array<bigint>, times array<bigint>")


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: token, group and link
    numbers, the digest of the groups, and the distinct linked id pairs
    (A id * B vocabulary + B id) with their links."""

    def work(batches):
        pair = token_pair(byte_path, piece_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, size = [], 0
            for at, run in runs([t or "" for t in texts]):
                for k, tokens in enumerate(pair.encode(run), at):
                    if tokens is None:
                        rows.append((ids[k], 0, 0, 0, 0, "", [], []))
                        continue
                    found = Aligned(pair, *tokens)
                    rows.append((ids[k], len(tokens[0]), len(tokens[1]), found.n_groups, found.n_links, found.sha256, found.pairs, found.times))
                    size += len(found.pairs)
                if size > 1 << 18:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.mapInArrow(work, _ALIGNED_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(list(zip(*rows))[:6], _ALIGNED)]
    for k in (6, 7):
        offsets = np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([np.asarray(r[k], np.int64) for r in rows])))
    return pa.RecordBatch.from_arrays(columns, schema=_ALIGNED)


def runs(texts: list[str], limit: int = 1 << 20):
    """(first place, texts) of about ``limit`` characters each."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit or k == len(texts) - 1:
            yield at, texts[at: k + 1]
            at, size = k + 1, 0


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked; ``best``: no
    pair of that A id has more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / width))
    # one row per entry of A's vocabulary
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs held by 2**k documents or more, for the least k that leaves
    at most ``most`` of them: (pairs, n, best), sorted."""
    sizes = {r.k: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("pairs")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    rows = counts.where(F.floor(F.log2("n")) >= least).toArrow()
    pairs, n, best = (rows.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return pairs[order], n[order], best[order].astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
          head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256) of every document."""
    spark = docs.sparkSession
    staged = Staged(spark)
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = staged.write(aligned(plain, byte_path, piece_path).withColumn("row", F.monotonically_increasing_id()))
    counts = staged.write(pair_counts(found, len(token_pair(byte_path, piece_path).b_size)))
    table = spark.sparkContext.broadcast(_head(counts, head_pairs))

    def look_up(batches):
        keys, n, best = table.value
        for batch in batches:
            pairs, times = (batch.column(k) for k in (6, 7))
            offsets = np.asarray(pairs.offsets) - pairs.offsets[0].as_py()
            flat, weight = np.asarray(pairs.flatten()), np.asarray(times.flatten())
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            at, used = at[hit], np.where(hit, weight, 0)
            n_of, best_of = (np.zeros(len(flat), np.int64) for _ in range(2))
            n_of[hit], best_of[hit] = n[at], best[at]
            left = np.concatenate([[0], np.cumsum(~hit)])[offsets].astype(np.int32)
            rest = [pa.ListArray.from_arrays(left, v[~hit]) for v in (flat, weight)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(6)], *rest, batch.column(8), pa.array(_sums(used * best_of, offsets)),
                                              pa.array(_sums(used * n_of, offsets))], names=[*batch.schema.names, "n_best", "count_sum"])

    looked = staged.write(found.mapInArrow(look_up, _ALIGNED_DDL + ", row bigint, n_best bigint, count_sum bigint"))
    staged.drop(1)
    # rare pairs: a join whose keys are in few documents each
    rare = (looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
            .join(counts, F.col("pairs") == F.col("pair")).groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    open_ = looked.where(F.size("pairs") > 0).drop("pairs", "times").join(rare, "row")
    open_ = open_.withColumn("n_best", F.col("n_best") + F.col("more_best")).withColumn("count_sum", F.col("count_sum") + F.col("more_sum"))
    return looked.where(F.size("pairs") == 0).select(names).unionByName(open_.select(names))
