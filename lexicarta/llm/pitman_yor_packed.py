"""The Pitman-Yor sampler of ``pitman_yor`` for contexts of one and two words,
on packed state.

A chunk is some whole documents of one scan task, held as its dictionary and
the word numbers of its texts.  Word ``w`` has one 32-bit id, given by its
owner (a share of the words by hash): id modulo the owners is the owner, and
frequent words have small ids.  A request is a distinct (preceding word, word,
word before both) of a chunk, dealt to a bucket by its preceding word, so the
restaurants of one and of two preceding words lie in the same bucket.  The
frequent preceding words are dealt over several buckets by the word that
follows; only totals of their restaurants are summed across buckets.

The sampled state of a bucket holds dishes that more than one seating can
have.  A row met once has one table for good; it is a number in its dish and
its restaurants.  A sweep sends tables per word from buckets to owners, and
the corpus restaurant's probabilities per word back, both in the order of the
bucket's keys.  Answers come back in the order of a chunk's requests, which
the chunk makes again from its word numbers.

All rows of one (preceding word, word) pair are held by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import Staged, iter_words, mix
from lexicarta.llm.pitman_yor import (SYMBOLS, Settings, Spelling, _discount, _document_state, _log_spelled, _seat_spelling, _spell, seat)

#: Text bytes of one chunk, of one bucket and of one owner, on average.
CHUNK_BYTES, BUCKET_BYTES, OWNER_BYTES = 8 << 20, 8 << 20, 32 << 20
#: Preceding words met more often are dealt over several buckets.
HOT_ROWS = 1_500_000
END, START = 0, 1
_ROW_BYTES = 8  # a document's share besides its text
_SPELLED_AT_ONCE = 50_000


# ------------------------------------------------------------------- packing


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: the bytes of each place together, compressed."""
    codec, parts = pa.Codec("zstd", 1), [struct.pack("<I", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""
        body = codec.compress(raw, asbytes=True) if raw else b""
        parts += [struct.pack("<2sQQ", a.dtype.str[1:].encode(), len(a), len(body)), body]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd", 1), [], 4
    for _ in range(struct.unpack_from("<I", blob)[0]):
        kind, n, size = struct.unpack_from("<2sQQ", blob, at)
        at += 18
        dtype = np.dtype(kind.decode())
        raw = codec.decompress(blob[at: at + size], decompressed_size=n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += size
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a.astype(np.int64), prepend=0)


def _restart(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running sums that start anew where ``new`` is set."""
    sums, start = np.cumsum(steps), np.flatnonzero(new)
    return sums - np.repeat(sums[start] - steps[start], np.diff(np.append(start, len(steps))))


def pack_requests(w1, w, w2, n) -> bytes:
    """Rows in the order of (w1, w, w2), as steps within equal words before."""
    d1 = _steps(w1)
    d0 = np.where(d1 == 0, _steps(w), w)
    d2 = np.where((d1 == 0) & (d0 == 0), _steps(w2), w2)
    return pack(*(x.astype(np.uint32) for x in (d1, d0, d2, n)))


def unpack_requests(blob: bytes):
    d1, d0, d2, n = (x.astype(np.int64) for x in unpack(blob))
    return np.cumsum(d1), _restart(d0, d1 > 0), _restart(d2, (d1 > 0) | (d0 > 0)), n


# -------------------------------------------------------------------- chunks


def _chunks(narrow: DataFrame, owners: int) -> DataFrame:
    """(chunk, docs, seq, words): documents, the numbers of their words in
    the chunk's dictionary (frequent first), and its words by owner."""

    def encode(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            sums = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + _ROW_BYTES)
            at = 0
            while at < batch.num_rows:
                done = int(sums[at - 1]) if at else 0
                to = min(batch.num_rows, int(np.searchsorted(sums, done + CHUNK_BYTES - size)) + 1)
                held.append(batch.slice(at, to - at))
                size, at = size + int(sums[to - 1]) - done, to
                if size >= CHUNK_BYTES:
                    yield _encode(pa.Table.from_batches(held), (part << 32) + number, owners)
                    number, held, size = number + 1, [], 0
        if held:
            yield _encode(pa.Table.from_batches(held), (part << 32) + number, owners)

    return narrow.select("doc_id", "train", "text").mapInArrow(encode, "chunk bigint, docs binary, seq binary, words array<binary>")


def _encode(table: pa.Table, chunk: int, owners: int) -> pa.RecordBatch:
    ids, train = table.column(0), table.column(1).to_numpy().astype(np.uint8)
    found, places, spelled, per_doc, at = [], [], [], [], 0
    for words in iter_words(table.column(2), lower=True):
        unique, where, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        found.append(unique)
        places.append(inverse + at)
        at += len(unique)
        view = memoryview(words.data)
        spelled += [view[a:b].tobytes().lower() for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist())]
        per_doc.append(words.per_doc)
    per_doc = np.concatenate(per_doc)
    unique, where, inverse = np.unique(np.concatenate(found), return_index=True, return_inverse=True)
    local = inverse[np.concatenate(places)]
    met = np.bincount(local, minlength=len(unique))
    order = np.argsort(-met, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    local = rank[local]
    used = np.bincount(local, weights=np.repeat(train, per_doc), minlength=len(unique)).astype(np.uint32)
    met, where, owner = met[order].astype(np.uint32), where[order], (unique[order] % np.uint64(owners)).astype(np.uint32)
    by_owner = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by_owner], np.arange(owners + 1))
    blobs = []
    for k in (by_owner[a:b] for a, b in zip(cuts, cuts[1:])):
        text = b" ".join([spelled[i] for i in where[k].tolist()])
        blobs.append(pack(np.frombuffer(text, np.uint8), used[k], met[k]))
    docs = pack(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy().astype(np.uint8))
    seq = pack(per_doc.astype(np.uint32), train, owner, local.astype(np.uint32))
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([docs], pa.binary()), pa.array([seq], pa.binary()),
                                       pa.array([blobs], pa.list_(pa.binary()))], names=["chunk", "docs", "seq", "words"])


def _lexicon(chunks: DataFrame, owners: int, train_docs: int) -> DataFrame:
    """Per owner one row with its words, frequent ones first, and the hot ones
    of them; per owner and chunk one row with ids and training counts."""

    def merge(key, table):
        o, chunk = key[0].as_py(), table.column("chunk")
        blobs = [unpack(x) for x in table.column("blob").to_pylist()]
        texts = [x[0].tobytes() for x in blobs]
        used, met = (np.concatenate([x[k] for x in blobs]).astype(np.int64) for k in (1, 2))
        hashes = np.concatenate([w.hashes for t in texts for w in iter_words(pa.array([t], pa.large_binary()), lower=False)])
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        c = np.bincount(inverse, weights=used, minlength=len(unique)).astype(np.int64)
        all_met = np.bincount(inverse, weights=met, minlength=len(unique)).astype(np.int64)
        order = np.argsort(-all_met, kind="stable")
        ids = np.empty(len(unique), np.int64)
        ids[order] = (np.arange(len(unique)) + 2) * owners + o
        spelled = b" ".join(t for t in texts if t).split(b" ")
        own = pack(np.frombuffer(b" ".join([spelled[i] for i in where[order].tolist()]), np.uint8))
        hot = all_met > HOT_ROWS
        cuts = np.cumsum([0, *(len(x[1]) for x in blobs)])
        replies = [pack(ids[k].astype(np.uint32), c[k].astype(np.uint32)) for k in (inverse[a:b] for a, b in zip(cuts, cuts[1:]))]
        n = table.num_rows
        ends = [train_docs] if o == 0 else []
        return pa.table({"o": pa.array([o] * (n + 1), pa.int32()), "chunk": pa.concat_arrays([*chunk.chunks, pa.array([None], pa.int64())]),
                         "blob": pa.array([*replies, own], pa.binary()),
                         "hot": pa.array([None] * n + [pack(ids[hot], all_met[hot])], pa.binary()),
                         "N": pa.array([0] * n + [int(c.sum()) + sum(ends)], pa.int64()),
                         "V": pa.array([0] * n + [int((c > 0).sum()) + sum(x > 0 for x in ends)], pa.int64())})

    rows = chunks.select("chunk", F.posexplode("words").alias("o", "blob"))
    return rows.groupBy("o").applyInArrow(merge, "o int, chunk bigint, blob binary, hot binary, N bigint, V bigint")


def _numbered(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """(chunk, docs, seq, ids): chunks with the ids of their dictionaries."""

    def number(key, left, right):
        blob = left.column("seq")[0].as_py()
        owner = unpack(blob)[2]
        per = [unpack(x) for _, x in sorted(zip(right.column("o").to_pylist(), right.column("blob").to_pylist()))]
        order = np.argsort(owner, kind="stable")
        ids, c = np.zeros(len(owner), np.uint32), np.zeros(len(owner), np.uint32)
        ids[order], c[order] = (np.concatenate([x[k] for x in per]) for k in (0, 1))
        return pa.table({"chunk": left.column("chunk"), "docs": left.column("docs"), "seq": left.column("seq"), "ids": pa.array([pack(ids, c)], pa.binary())})

    return (chunks.select("chunk", "docs", "seq").groupBy("chunk").cogroup(replies.select("chunk", "o", "blob").groupBy("chunk"))
            .applyInArrow(number, "chunk bigint, docs binary, seq binary, ids binary"))


@dataclass(frozen=True)
class _Deal:
    """How requests are dealt: the buckets, and (id, salts) of hot words."""

    buckets: int
    owners: int
    hot: np.ndarray
    salts: np.ndarray

    def salts_of(self, w1: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(w1), np.int64)
        at = np.minimum(np.searchsorted(self.hot, w1), len(self.hot) - 1)
        return np.where(self.hot[at] == w1, self.salts[at], 1)

    def bucket(self, w1: np.ndarray, w: np.ndarray) -> np.ndarray:
        salt = mix(w.astype(np.uint64)) % self.salts_of(w1).astype(np.uint64)
        return (mix(w1.astype(np.uint64) + (salt << np.uint64(32))) % np.uint64(self.buckets)).astype(np.int64)


def _asked(seq: bytes, ids: np.ndarray, deal: _Deal, by_token: bool):
    """A chunk's requests by bucket: (w1, w, w2, n, cuts of the buckets), and
    if asked for the request of every token, ends included."""
    per_doc, train, _, local = unpack(seq)
    lengths = per_doc.astype(np.int64) + 1
    table = np.concatenate([np.array([END, START], np.int64), ids.astype(np.int64)])
    order = np.argsort(table)
    rank = np.empty(len(table), np.int64)
    rank[order] = np.arange(len(table))
    first = np.cumsum(lengths) - lengths
    w = np.zeros(int(lengths.sum()), np.int64)
    inside = np.ones(len(w), bool)
    inside[first + lengths - 1] = False
    w[inside] = rank[local.astype(np.int64) + 2]
    before = []
    for back in (1, 2):
        b = np.full(len(w), rank[1])
        b[back:] = w[:-back]
        for k in range(back):
            b[(first + k)[lengths > k]] = rank[1]
        before.append(b)
    k = len(table)
    key = before[0] * k + w
    if k < 1 << 21:
        pairs = None
    else:  # a chunk of one very long text
        pairs, key = np.unique(key, return_inverse=True)
    key, use = key * k + before[1], np.repeat(train, lengths)
    if by_token or k >= 1 << 20:
        unique, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, weights=use, minlength=len(unique)).astype(np.int64)
    else:  # plain sorting takes a fraction of the time
        key = np.sort(key << 1 | use)
        first = np.flatnonzero(np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1]))
        unique, n, inverse = key[first] >> 1, np.add.reduceat(key & 1, first), None
    pair, r2 = np.divmod(unique, k)
    r1, r = np.divmod(pair if pairs is None else pairs[pair], k)
    ids = table[order]
    w1, w, w2 = ids[r1], ids[r], ids[r2]
    bucket = deal.bucket(w1, w)
    dealt = np.argsort(bucket, kind="stable")
    place = np.empty(len(dealt), np.int64)
    place[dealt] = np.arange(len(dealt))
    cuts = np.searchsorted(bucket[dealt], np.arange(deal.buckets + 1))
    return w1[dealt], w[dealt], w2[dealt], n[dealt], cuts, place[inverse] if by_token else None


def _requests(numbered: DataFrame, deal: _Deal) -> DataFrame:
    """(bucket, chunk, req)."""

    def ask(batches):
        for batch in batches:
            for chunk, seq, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                w1, w, w2, n, cuts, _ = _asked(seq, unpack(ids)[0], deal, by_token=False)
                full = np.flatnonzero(np.diff(cuts))
                blobs = [pack_requests(*(x[cuts[b]: cuts[b + 1]] for x in (w1, w, w2, n))) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.int64()), pa.array(blobs, pa.binary())],
                                                 names=["bucket", "chunk", "req"])

    return numbered.select("chunk", "seq", "ids").mapInArrow(ask, "bucket int, chunk bigint, req binary")


# ------------------------------------------------------------------- buckets


@dataclass
class _Restaurants:
    """The restaurants of a bucket.  ``row_*``: dishes of two-word contexts;
    ``dish_*``: of one-word contexts.  What is settled and not listed as rows
    or dishes counts in ``ctx_n`` (all customers), ``ctx_t`` (tables),
    ``dish_n``, ``one_fixed`` and ``word_fixed`` (customers = tables).
    ``keys`` are the salted restaurants, ``key_place`` their order: first
    ``salted_one``, then ``salted_ctx``."""

    row_dish: np.ndarray
    row_ctx: np.ndarray
    row_n: np.ndarray
    ctx_n: np.ndarray
    ctx_t: np.ndarray
    dish_n: np.ndarray
    dish_one: np.ndarray
    dish_word: np.ndarray
    one_fixed: np.ndarray
    words: np.ndarray
    word_fixed: np.ndarray
    salted_one: np.ndarray
    salted_ctx: np.ndarray
    keys: np.ndarray
    key_place: np.ndarray

    def pack(self) -> bytes:
        return pack(*(getattr(self, f.name).astype(np.uint64 if f.name == "keys" else np.uint32) for f in fields(self)))

    @classmethod
    def unpack(cls, blob: bytes) -> _Restaurants:
        return cls(*(x if x.dtype == np.uint64 else x.astype(np.int64) for x in unpack(blob)))

    def customers(self, t2: np.ndarray) -> np.ndarray:
        """Of the dishes of one-word contexts."""
        return self.dish_n + np.bincount(self.row_dish, weights=t2, minlength=len(self.dish_n))

    def totals(self, t2, t1):
        """(customers, tables) of one-word and of two-word restaurants, as
        far as this bucket has them."""
        k = len(self.one_fixed)
        return ((self.one_fixed + np.bincount(self.dish_one, weights=self.customers(t2), minlength=k),
                 self.one_fixed + np.bincount(self.dish_one, weights=t1, minlength=k)),
                (self.ctx_n.astype(np.float64), self.ctx_t + np.bincount(self.row_ctx, weights=t2, minlength=len(self.ctx_t))))

    def sent(self, t2, t1) -> list[np.ndarray]:
        """Tables by word, customers and tables of salted restaurants."""
        by_word = self.word_fixed + np.bincount(self.dish_word, weights=t1, minlength=len(self.words))
        one, two = self.totals(t2, t1)
        return [by_word, *(np.concatenate([a[self.salted_one], b[self.salted_ctx]])[self.key_place] for a, b in zip(one, two))]

    def whole(self, t2, t1, summed):
        """``totals`` with the sums of salted restaurants over all buckets."""
        one, two = self.totals(t2, t1)
        for a, b, x in zip(one, two, summed):
            back = np.empty(len(x))
            back[self.key_place] = x
            a[self.salted_one], b[self.salted_ctx] = back[: len(self.salted_one)], back[len(self.salted_one):]
        return one, two

    def one_word(self, t2, t1, p0, one, s: Settings, discount: float):
        """(pull, predictive) of the dishes of one-word contexts."""
        pull = (s.context_strength + discount * one[1])[self.dish_one] * p0[self.dish_word]
        return pull, (np.maximum(self.customers(t2) - discount * t1, 0) + pull) / (s.context_strength + one[0])[self.dish_one]

    def pulls(self, p1, two, s: Settings, discount: float):
        return (s.context_strength + discount * two[1])[self.row_ctx] * p1[self.row_dish]


def _merged(rows: list, deal: _Deal):
    """All restaurants of a bucket, the request row of every row given, and
    which rows and dishes are trained and which are open to sampling."""
    w1, w, w2, n = (np.concatenate([x[k] for x in rows]) for k in range(4))
    order = np.lexsort((w2, w1 << 32 | w))
    w1, w, w2 = w1[order], w[order], w2[order]
    new_pair = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w[1:] != w[:-1])])
    new = new_pair | np.concatenate([[True], w2[1:] != w2[:-1]])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    n = np.add.reduceat(n[order], np.flatnonzero(new))
    w1, w, w2, new_pair = w1[new], w[new], w2[new], new_pair[new]
    row_dish = np.cumsum(new_pair) - 1
    one_new = np.concatenate([[True], w1[1:] != w1[:-1]])
    dish_one, dish_w = (np.cumsum(one_new) - 1)[new_pair], w[new_pair]
    contexts, row_ctx = np.unique(w1 << 32 | w2, return_inverse=True)
    words = np.unique(dish_w)
    words = words[np.argsort(words % deal.owners, kind="stable")]
    place = np.argsort(words)
    dish_word = place[np.searchsorted(words[place], dish_w)]
    ones = w1[one_new]
    salted_one, salted_ctx = np.flatnonzero(deal.salts_of(ones) > 1), np.flatnonzero(deal.salts_of(contexts >> 32) > 1)
    keys = np.concatenate([(ones[salted_one] << 32).astype(np.uint64), (contexts[salted_ctx]).astype(np.uint64)])
    key_place = np.lexsort((keys, _key_owner(keys, deal.owners)))
    d, c = len(dish_w), len(contexts)
    full = _Restaurants(row_dish, row_ctx, n, np.bincount(row_ctx, weights=n, minlength=c).astype(np.int64), np.zeros(c, np.int64), np.zeros(d, np.int64),
                        dish_one, dish_word, np.zeros(len(ones), np.int64), words, np.zeros(len(words), np.int64), salted_one, salted_ctx,
                        keys[key_place], key_place)
    open_row = n > 1
    seated = np.bincount(row_dish, weights=n > 0, minlength=d)
    open_dish = (seated > 1) | (np.bincount(row_dish, weights=open_row, minlength=d) > 0)
    return full, of, open_row, open_dish, seated.astype(np.int64)


def _key_owner(keys: np.ndarray, owners: int) -> np.ndarray:
    return (mix(keys) % np.uint64(owners)).astype(np.int64)


def _sampled(full: _Restaurants, open_row, open_dish, seated) -> _Restaurants:
    """Only what sampling can change; the rest as numbers."""
    single, fixed = full.row_n == 1, (seated == 1) & ~open_dish
    used = np.zeros(len(full.ctx_n), bool)
    used[full.row_ctx[open_row]] = True
    used[full.salted_ctx] = True
    ctx, dish = np.cumsum(used) - 1, np.cumsum(open_dish) - 1
    at = full.row_dish[open_row]
    return _Restaurants(
        dish[at], ctx[full.row_ctx[open_row]], full.row_n[open_row], full.ctx_n[used],
        np.bincount(full.row_ctx[single], minlength=len(used))[used], np.bincount(full.row_dish[single], minlength=len(open_dish))[open_dish],
        full.dish_one[open_dish], full.dish_word[open_dish], np.bincount(full.dish_one[fixed], minlength=len(full.one_fixed)),
        full.words, np.bincount(full.dish_word[fixed], minlength=len(full.words)), full.salted_one, ctx[full.salted_ctx], full.keys, full.key_place)


def _by_owner(rest: _Restaurants, owners: int, values: list[np.ndarray]) -> list[bytes]:
    """(tables by word, customers and tables by key) for each owner."""
    a = np.searchsorted(rest.words % owners, np.arange(owners + 1))
    b = np.searchsorted(_key_owner(rest.keys, owners), np.arange(owners + 1))
    kinds = (np.uint32, np.uint64, np.uint64)
    return [pack(*(x[c[o]: c[o + 1]].astype(t) for x, c, t in zip(values, (a, b, b), kinds))) for o in range(owners)]


_STATE = "bucket int, state binary, keys array<binary>, t binary, sent array<binary>, n1 bigint, n2 bigint, m1 bigint, m2 bigint"


def _state(requests: DataFrame, deal: _Deal) -> DataFrame:
    """Per bucket the sampled state, with one table per dish, the keys that
    each owner is asked for, and the counts that set the discounts."""

    def build(key, table):
        full, _, open_row, open_dish, seated = _merged([unpack_requests(x) for x in table.column("req").to_pylist()], deal)
        rest = _sampled(full, open_row, open_dish, seated)
        t2, t1 = np.ones(len(rest.row_n), np.uint32), np.ones(len(rest.dish_n), np.uint32)
        a = np.searchsorted(rest.words % deal.owners, np.arange(deal.owners + 1))
        b = np.searchsorted(_key_owner(rest.keys, deal.owners), np.arange(deal.owners + 1))
        keys = [pack(_steps(rest.words[a[o]: a[o + 1]] // deal.owners).astype(np.uint32), np.diff(rest.keys[b[o]: b[o + 1]], prepend=np.uint64(0)))
                for o in range(deal.owners)]
        count = lambda x: pa.array([int(x.sum())], pa.int64())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "state": pa.array([rest.pack()], pa.binary()),
                         "keys": pa.array([keys], pa.list_(pa.binary())), "t": pa.array([pack(t2, t1)], pa.binary()),
                         "sent": pa.array([_by_owner(rest, deal.owners, rest.sent(t2, t1))], pa.list_(pa.binary())),
                         "n1": count(full.row_n == 1), "n2": count(full.row_n == 2), "m1": count(seated == 1), "m2": count(seated == 2)})

    return requests.select("bucket", "req").groupBy("bucket").applyInArrow(build, _STATE)


def _got(owners, blobs):
    """(p by word, customers and tables by key) out of the owners' replies."""
    rows = [unpack(x) for _, x in sorted(zip(owners, blobs))]
    half, power, n, t = (np.concatenate([x[k] for x in rows]) for k in range(4))
    return np.ldexp(half.astype(np.float64), power.astype(np.int64)), (n.astype(np.float64), t.astype(np.float64))


def _sweep(state: DataFrame, tables: DataFrame, replies: DataFrame, deal: _Deal, s: Settings, discounts, number: int) -> DataFrame:
    """(bucket, t, sent) after all customers of the contexts are seated anew."""
    d2, d1 = discounts

    def sweep(key, left, right):
        b = key[0].as_py()
        rest = _Restaurants.unpack(next(x for x in left.column("state").to_pylist() if x is not None))
        t2, t1 = unpack(next(x for x in left.column("t").to_pylist() if x is not None))
        p0, summed = _got(right.column("o").to_pylist(), right.column("blob").to_pylist())
        one, two = rest.whole(t2, t1, summed)
        pull, p1 = rest.one_word(t2, t1, p0, one, s, d1)
        t2 = seat(np.random.default_rng([s.seed, number, 2, b]), rest.row_n, rest.pulls(p1, two, s, d2), d2).astype(np.uint32)
        t1 = seat(np.random.default_rng([s.seed, number, 1, b]), rest.customers(t2), pull, d1).astype(np.uint32)
        return pa.table({"bucket": pa.array([b], pa.int32()), "t": pa.array([pack(t2, t1)], pa.binary()),
                         "sent": pa.array([_by_owner(rest, deal.owners, rest.sent(t2, t1))], pa.list_(pa.binary()))})

    none = F.lit(None).cast("binary")
    left = state.select("bucket", "state", none.alias("t")).unionAll(tables.select("bucket", none.alias("state"), "t"))
    return left.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(sweep, "bucket int, t binary, sent array<binary>")


def _answers(requests: DataFrame, state: DataFrame, kept: list[tuple[DataFrame, DataFrame]], deal: _Deal, s: Settings, discounts) -> DataFrame:
    """(chunk, bucket, lp): log10 of the mean predictive over the kept states
    of every request, in its order."""
    d2, d1 = discounts
    samples = len(kept)

    def answer(key, left, right):
        chunks = left.column("chunk")
        rows = [unpack_requests(x) for x in left.column("req").to_pylist()]
        full, of, open_row, open_dish, seated = _merged(rows, deal)
        cuts = np.cumsum([0, *(len(x[0]) for x in rows)])
        del rows
        mean = np.zeros(len(full.row_n))
        sample, owner, blob = (right.column(k).to_pylist() for k in ("sample", "o", "blob"))
        for k in range(samples):
            own = [(o, x) for j, o, x in zip(sample, owner, blob) if j == k]
            t2, t1 = (full.row_n > 0).astype(np.float64), (seated > 0).astype(np.float64)
            t2[open_row], t1[open_dish] = unpack(next(x for o, x in own if o < 0))
            p0, summed = _got(*zip(*((o, x) for o, x in own if o >= 0)))
            one, two = full.whole(t2, t1, summed)
            _, p1 = full.one_word(t2, t1, p0, one, s, d1)
            mean += (np.maximum(full.row_n - d2 * t2, 0) + full.pulls(p1, two, s, d2)) / (s.context_strength + two[0])[full.row_ctx]
        lp = np.log10(np.maximum(mean / samples, 1e-300)).astype(np.float32)
        return pa.table({"chunk": chunks, "bucket": pa.array([key[0].as_py()] * len(chunks), pa.int32()),
                         "lp": pa.array([pack(lp[of[a:b]]) for a, b in zip(cuts, cuts[1:])], pa.binary())})

    right = None
    for k, (tables, replies) in enumerate(kept):
        both = tables.select("bucket", F.lit(-1).alias("o"), F.col("t").alias("blob")).unionAll(replies.select("bucket", "o", "blob"))
        both = both.select("bucket", F.lit(k).alias("sample"), "o", "blob")
        right = both if right is None else right.unionAll(both)
    return requests.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(answer, "chunk bigint, bucket int, lp binary")


# -------------------------------------------------------------------- owners


def _spelled(blob: bytes, owner: int) -> pa.Array:
    """An owner's words; the end, spelled empty, is the last of owner 0."""
    text = unpack(blob)[0].tobytes()
    return pa.array((text.split(b" ") if text else []) + ([b""] if owner == 0 else []), pa.binary())


def _keys(blob: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among an owner's words, and keys of salted restaurants."""
    steps, keys = unpack(blob)
    number = np.cumsum(steps.astype(np.int64))
    return np.where(number == 0, words - 1, number - 2), np.cumsum(keys, dtype=np.uint64)


def _links(lexicon: DataFrame, state: DataFrame) -> DataFrame:
    """(o, bucket, blob): an owner's words (bucket -1), and its keys."""
    return (lexicon.select("o", F.lit(-1).alias("bucket"), "blob")
            .unionAll(state.select(F.posexplode("keys").alias("o", "blob"), "bucket").select("o", "bucket", "blob")))


def _corpus(links: DataFrame, sent: DataFrame) -> DataFrame:
    """(o, words, corpus, N, n1, n2): customers of the corpus restaurant, and
    sums of the salted ones."""

    def count(key, left, right):
        o = key[0].as_py()
        of = dict(zip(left.column("bucket").to_pylist(), left.column("blob").to_pylist()))
        words = len(_spelled(of[-1], o))
        c = np.zeros(words, np.int64)
        keys, n, t = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0)]
        for b, blob in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist()):
            place, salted = _keys(of[b], words)
            by_word, key_n, key_t = unpack(blob)
            c[place] += by_word
            keys.append(salted), n.append(key_n), t.append(key_t)
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n, t = (np.bincount(inverse, weights=np.concatenate(x), minlength=len(unique)).astype(np.uint64) for x in (n, t))
        return pa.table({"o": pa.array([o], pa.int32()), "words": pa.array([of[-1]], pa.binary()),
                         "corpus": pa.array([pack(c.astype(np.uint32), n, t)], pa.binary()), "N": pa.array([int(c.sum())], pa.int64()),
                         "n1": pa.array([int((c == 1).sum())], pa.int64()), "n2": pa.array([int((c == 2).sum())], pa.int64())})

    values = sent.select(F.posexplode("sent").alias("o", "blob"), "bucket")
    return links.groupBy("o").cogroup(values.groupBy("o")).applyInArrow(count, "o int, words binary, corpus binary, N bigint, n1 bigint, n2 bigint")


@dataclass(frozen=True)
class _Corpus:
    """The corpus restaurant's numbers: customers, discount, and the tables
    that it had when the spelling was seated."""

    customers: int
    discount: float
    tables: float


def _replies(corpus: DataFrame, links: DataFrame, shared, at: _Corpus, s: Settings, number: int) -> DataFrame:
    """(bucket, o, blob): the corpus restaurant's predictive by word, and the
    sums by key, for what each bucket asks."""

    def reply(key, left, right):
        o = key[0].as_py()
        words = _spelled(left.column("words")[0].as_py(), o)
        c, n, t = unpack(left.column("corpus")[0].as_py())
        table, p = shared.value.table(), np.zeros(len(words))
        rng = np.random.default_rng([s.seed, number, 0, o])
        for lo in range(0, len(words), _SPELLED_AT_ONCE):
            k = slice(lo, lo + _SPELLED_AT_ONCE)
            pull = (s.word_strength + at.discount * at.tables) * np.exp(_log_spelled(words.slice(lo, _SPELLED_AT_ONCE), table))
            own = c[k].astype(np.int64)
            p[k] = (np.maximum(own - at.discount * seat(rng, own, pull, at.discount), 0) + pull) / (s.word_strength + at.customers)
        half, power = np.frexp(p)
        half, power = half.astype(np.float32), power.astype(np.int16)
        asked = [(b, *_keys(x, len(words))) for b, x in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist()) if b >= 0]
        unique = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in asked)]))
        blobs = []
        for _, place, salted in asked:
            k = np.searchsorted(unique, salted)
            blobs.append(pack(half[place], power[place], n[k], t[k]))
        return pa.table({"bucket": pa.array([x[0] for x in asked], pa.int32()), "o": pa.array([o] * len(asked), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return (corpus.select("o", "words", "corpus").groupBy("o").cogroup(links.groupBy("o"))
            .applyInArrow(reply, "bucket int, o int, blob binary"))


def _cells(corpus: DataFrame, shared, at: _Corpus, s: Settings, number: int) -> DataFrame:
    """(cell, n): customers of the leaf cells after seating all words anew."""

    def sweep(batches):
        table = shared.value.table()
        sums = np.zeros(len(table))
        for batch in batches:
            for o, blob, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rng, words, c = np.random.default_rng([s.seed, number, o]), _spelled(blob, o), unpack(counts)[0].astype(np.int64)
                used = np.flatnonzero(c > 0)
                for lo in range(0, len(used), _SPELLED_AT_ONCE):
                    k = used[lo: lo + _SPELLED_AT_ONCE]
                    cells, owner = _spell(words.take(pa.array(k)))
                    spelled = np.exp(np.bincount(owner, weights=table[cells], minlength=len(k)))
                    t = seat(rng, c[k], (s.word_strength + at.discount * at.tables) * spelled, at.discount)
                    sums += np.bincount(cells, weights=t[owner], minlength=len(table))
        cells = np.flatnonzero(sums)
        for lo in range(0, len(cells), 100_000):
            part = cells[lo: lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part].astype(np.int64))], names=["cell", "n"])

    return corpus.select("o", "words", "corpus").mapInArrow(sweep, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------- scoring


_SCORES = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(numbered: DataFrame, answers: DataFrame, deal: _Deal, total: int, types: int, end_count: int, s: Settings) -> DataFrame:
    def apply(key, left, right):
        ids, valid = unpack(left.column("docs")[0].as_py())
        seq = left.column("seq")[0].as_py()
        per_doc, train, _, local = unpack(seq)
        word_ids, c = unpack(left.column("ids")[0].as_py())
        *_, place = _asked(seq, word_ids, deal, by_token=True)
        given = np.concatenate([unpack(x)[0] for _, x in sorted(zip(right.column("bucket").to_pylist(), right.column("lp").to_pylist()))])
        given = given.astype(np.float64)[place]
        n, per_doc, local = len(per_doc), per_doc.astype(np.int64), local.astype(np.int64)
        base = np.log10((np.append(c.astype(np.int64), end_count) + 0.5) / (total + 0.5 * (types + 1)))
        owner = np.repeat(np.arange(n), per_doc)
        known = np.bincount(owner, weights=(c > 0)[local], minlength=n).astype(np.int64) + int(end_count > 0)
        low = np.bincount(owner, weights=base[local], minlength=n) + base[-1]
        at_end = np.cumsum(per_doc + 1) - 1
        inside = np.ones(len(given), bool)
        inside[at_end] = False
        seen, before, distinct = _document_state(owner * len(c) + local, np.concatenate([[0], np.cumsum(per_doc)]), owner)
        reused = np.where(seen > 0, seen - s.document_discount, 0.0)
        p = (reused + (s.document_strength + s.document_discount * distinct) * 10.0 ** given[inside]) / (s.document_strength + before)
        kinds = np.bincount(owner, weights=seen == 0, minlength=n)
        high = (np.bincount(owner, weights=np.log10(p), minlength=n) + given[at_end]
                + np.log10((s.document_strength + s.document_discount * kinds) / (s.document_strength + per_doc)))
        return pa.table({"doc_id": pa.array(ids, mask=valid == 0), "train": pa.array(train > 0), "n_tokens": per_doc + 1, "n_known": known,
                         "train_tokens": np.full(n, total, np.int64), "base_score": low, "score": high})

    return numbered.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, _SCORES)


@contextmanager
def _shuffles_end_with_their_write(spark) -> Iterator[None]:
    """Shuffle files of a step go when its result is staged, not when the
    driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(narrow: DataFrame, size: int, docs: int, train_docs: int, s: Settings) -> DataFrame:
    """``pitman_yor.score`` of (doc_id, train, text) with ``size`` text bytes."""
    spark = narrow.sparkSession
    if not docs:
        return spark.createDataFrame([], _SCORES)
    staged = Staged(spark)
    bytes_ = size + _ROW_BYTES * docs
    owners, buckets = max(1, -(-bytes_ // OWNER_BYTES)), max(1, -(-bytes_ // BUCKET_BYTES))
    with _shuffles_end_with_their_write(spark):
        chunks = staged.write(_chunks(narrow, owners))
        lexicon = staged.write(_lexicon(chunks, owners, train_docs))
        own = lexicon.where("chunk IS NULL")
        stats = own.agg(F.sum("N").alias("N"), F.sum("V").alias("V")).first()
        hot = [unpack(bytes(r.hot)) for r in own.select("hot").collect()]
        ids, met = (np.concatenate([np.array([first]), *(x[k].astype(np.int64) for x in hot)]) for k, first in ((0, START), (1, docs)))
        keep = np.flatnonzero(met > HOT_ROWS)
        keep = keep[np.argsort(ids[keep])]
        deal = _Deal(buckets, owners, ids[keep], -(-met[keep] // HOT_ROWS))
        numbered = staged.write(_numbered(chunks, lexicon.where("chunk IS NOT NULL")))
        own = staged.write(own.select("o", "blob"))
        for old in (1, 2):
            staged.drop(old)
        requests = _requests(numbered, deal)
        state = staged.write(_state(requests, deal))
        few = state.agg(*(F.sum(x).alias(x) for x in ("n1", "n2", "m1", "m2"))).first()
        discounts = _discount(few.n1, few.n2), _discount(few.m1, few.m2)
        links, tables, kept = _links(own, state), state, []
        root, spelled_tables, model = np.full(SYMBOLS, 1 / SYMBOLS), float(stats.V), None
        shared = spark.sparkContext.broadcast(Spelling({}, root))
        for number in range(s.burn_in + s.samples + 1):
            corpus = staged.write(_corpus(links, tables))
            of_corpus = staged.count
            few = corpus.agg(F.sum("N").alias("N"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
            at = _Corpus(few.N, _discount(few.n1, few.n2), spelled_tables)
            if number:
                model, root, spelled_tables = _seat_spelling(_cells(corpus, shared, at, s, number - 1), root, s, number - 1)
                at = _Corpus(at.customers, at.discount, spelled_tables)
                shared.destroy()
                shared = spark.sparkContext.broadcast(model)
            replies = staged.write(_replies(corpus, links, shared, at, s, number))
            staged.drop(of_corpus)
            if number > s.burn_in or number == s.burn_in + s.samples:
                kept.append((tables, replies))
            if number < s.burn_in + s.samples:
                after = staged.write(_sweep(state, tables, replies, deal, s, discounts, number))
                if number <= s.burn_in:  # neither tables nor replies are a kept state
                    staged.drop(of_corpus + 1)
                    if number:
                        staged.drop(of_corpus - 1)
                tables = after
        shared.destroy()
        answers = staged.write(_answers(requests, state, kept, deal, s, discounts))
        for old in range(4, staged.count):
            staged.drop(old)
    return _scored(numbered, answers, deal, int(stats.N), int(stats.V), train_docs, s)
