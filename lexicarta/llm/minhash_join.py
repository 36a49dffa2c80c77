"""MinHash near-duplicates by a multi-index Hamming join.

A document is its set of word shingles.  A signature holds, for each of
``HASHES`` hash functions, the lowest 16 bits of the set's least value; two
sets of similarity J differ in about (1 - J) of the places.  Signatures are
split into ``HASHES / CHUNK`` chunks: two that differ in at most ``LIMIT``
places differ, by the pigeonhole principle, in at most ``ERRORS`` places of
some chunk.  Each signature is filed under the keys of every chunk with
every choice of ``ERRORS`` places left out, so all pairs under the limit meet
under a key; a pair at J = 0.8 misses all keys with a chance of 1e-7, and a
pair that meets is judged whatever its distance up to the limit.

Classes (distinct sets) meet in buckets, the sets of classes under one key;
keys with the same members are one bucket.  Three rounds link them: first
every member is compared with its bucket's most central member, then the
members that are not connected yet propose their likeliest partner, last all
pairs that no link connects are judged.  Buckets are cut into blocks, and
pairs of blocks are dealt over the tasks, so no bucket is one task's.  Inside
a block, pairs pass by size, by distance of signatures (under the first chunk
in which they meet only), and by a bound on the overlap from hashed bitmaps;
what passes is confirmed on the full sets, made again from the whole texts.

Defined cases: a null or empty text, or one of separators alone, has no
shingles and no links; a text shorter than a shingle is one shingle; repeated
rows and ids are documents of their own; a null id never is a component's id
unless all its documents lack one, and such a document is kept if its
component's id is null too; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import Staged, grams, iter_words, mix, shuffle_partitions, signed

#: Places of a signature, places of a chunk, places left out of a key.
HASHES, CHUNK, ERRORS = 60, 5, 1
CHUNKS = HASHES // CHUNK
#: Signatures that differ in at most so many places always meet.
LIMIT = (ERRORS + 1) * CHUNKS - 1
#: Bitmap bits per shingle, and its least and greatest size in bits.
BITS, LEAST_BITS, MOST_BITS = 4, 1 << 10, 1 << 14
#: Members of a block of a bucket.
BLOCK = 512
#: Greatest size of the bitmap of wanted texts: 16 MB.
MOST_MARKS = 1 << 27
_TOKENS = 1 << 14

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int):
    """(place of the text, sorted distinct shingle hashes) of every text with
    a word; a text of fewer words is one shingle."""
    for words in iter_words(texts, lower=True):
        flat, offsets = grams(words.hashes, width), words.offsets
        for i in np.flatnonzero(words.per_doc):
            a, b = int(offsets[i]), int(offsets[i + 1])
            yield words.first + int(i), np.unique(flat[a: b - width + 1]) if b - a >= width else grams(words.hashes[a:b], b - a)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` 16-bit places for every set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    least = np.full((len(sets), HASHES), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(flat), _TOKENS):
        hi = min(lo + _TOKENS, len(flat))
        value = (flat[None, lo:hi] ^ _XOR[:, None]) * _ODD[:, None]
        value ^= value >> np.uint64(31)
        value *= _ODD[::-1, None]
        first = int(np.searchsorted(starts, lo, "right")) - 1
        last = int(np.searchsorted(starts, hi, "left"))
        heads = np.maximum(starts[first:last], lo) - lo
        least[first:last] = np.minimum(least[first:last], np.minimum.reduceat(value, heads, axis=1).T)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def keys(places: np.ndarray) -> np.ndarray:
    """All keys of every signature: per chunk, a hash of the places that are
    kept, for each choice of the places left out; key k belongs to chunk
    k % CHUNKS."""
    salted = mix((places.astype(np.uint64).reshape(-1, CHUNKS, CHUNK) + np.uint64(1)) * _SALT)
    total = salted.sum(2)
    out = []
    for k, left_out in enumerate(combinations(range(CHUNK), ERRORS)):
        out.append(mix(total - salted[:, :, left_out].sum(2) + np.uint64(k + 1)))
    return np.concatenate(out, 1)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the shingles that map to each bit."""
    size = LEAST_BITS
    while size < min(BITS * len(tokens), MOST_BITS):
        size *= 2
    at = (mix(tokens ^ np.uint64(0xB17)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1).tobytes()


def folded(bits: bytes, size: int = LEAST_BITS // 64) -> np.ndarray:
    """The bitmap laid over itself until it has ``size`` 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size), 0)


def differing(x: bytes, y: bytes) -> int:
    """Bits that differ once the longer bitmap is folded to the shorter: at
    most the number of shingles that one side has alone."""
    size = min(len(x), len(y)) // 8
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _class_of(tokens: np.ndarray) -> np.uint64:
    total = np.array([mix(tokens + np.uint64(0x11)).sum(dtype=np.uint64), len(tokens)], np.uint64)
    return mix(total[:1] + mix(total[1:]))[0]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row_hash, n, cls, places, bits).  The last two are null on
    all but the first of a task's equal sets: copies are combined before any
    shuffle."""

    def build(batches):
        seen = set()
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            places, bits = [None] * batch.num_rows, [None] * batch.num_rows
            held, size = [], 0

            def settle(held=held, places=places):
                for (i, _), row in zip(held, signatures([t for _, t in held])):
                    places[i] = row.tobytes()
                held.clear()

            for i, tokens in shingle_sets(batch.column(1), width):
                n[i], cls[i] = len(tokens), _class_of(tokens)
                if cls[i] in seen:
                    continue
                seen.add(cls[i])
                bits[i] = bitmap(tokens)
                held.append((i, tokens))
                size += len(tokens)
                if size > 1 << 20:
                    settle()
                    size = 0
            if held:
                settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(signed(cls), pa.int64(), mask=n == 0), pa.array(places, pa.binary()),
                 pa.array(bits, pa.binary())], names=["doc_id", "row_hash", "n", "cls", "places", "bits"])

    return docs.mapInArrow(build, "doc_id bigint, row_hash bigint, n bigint, cls bigint, places binary, bits binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), HASHES)


def _filed(classes: DataFrame) -> DataFrame:
    """(key, chunk, cls): every class under all its keys."""
    def emit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                found = signed(keys(_matrix(part.column(1).to_pylist())))
                cls = part.column(0).to_numpy()
                chunk = np.tile(np.arange(found.shape[1], dtype=np.int8) % CHUNKS, len(cls))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(chunk), pa.array(np.repeat(cls, found.shape[1]))],
                                                 names=["key", "chunk", "cls"])

    return classes.select("cls", "places").mapInArrow(emit, "key bigint, chunk tinyint, cls bigint")


def _runs(batches, width: int):
    """Column lists cut so that rows with an equal first column, by which
    they come sorted, stay together."""
    held = None
    for batch in batches:
        if batch.num_rows:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
            held = new if held is None else [np.concatenate([h, x]) for h, x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut:
                yield [x[:cut] for x in held]
                held = [x[cut:] for x in held]
    if held is not None:
        yield held


def _linkable(n_a, n_b, share):
    num, den = share
    return den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)


def _in_blocks(members: DataFrame, share: tuple[int, int], likeliest: bool) -> DataFrame:
    """Pairs (a, b) of ``members(key, chunk, cls, size, n, root, places,
    bits)`` with different roots that sizes, signatures and bitmaps let
    through.  A pair is judged under its first common chunk: the bucket of
    that chunk's key is named by the key of its least chunk."""
    num, den = share

    def compare(batches):
        for tile, cls, n, root, block, chunk, places, bits in _runs(batches, 8):
            sig = _matrix(places)
            least = np.stack([folded(x) for x in bits])
            last = np.searchsorted(tile, tile, "right")
            ahead, lag, found = np.arange(len(tile)), 0, []
            while len(ahead):
                lag += 1
                ahead = ahead[ahead + lag < last[ahead]]
                i = ahead[(root[ahead] != root[ahead + lag]) & (block[ahead] != block[ahead + lag])]
                i = i[_linkable(n[i], n[i + lag], share)]
                for at in range(0, len(i), 20_000):
                    p = i[at: at + 20_000]
                    broken = sig[p] != sig[p + lag]
                    apart = broken.sum(1)
                    near = apart <= LIMIT
                    p, apart = p[near], apart[near]
                    met = broken[near].reshape(-1, CHUNKS, CHUNK).sum(2) <= ERRORS
                    total = n[p] + n[p + lag]
                    most = (total - np.bitwise_count(least[p] ^ least[p + lag]).sum(1, dtype=np.int64)) // 2
                    good = (met.argmax(1) == chunk[p]) & ((den + num) * most >= num * total)
                    for x, d in zip(p[good].tolist(), apart[good].tolist()):
                        total = int(n[x] + n[x + lag])
                        if (den + num) * ((total - differing(bits[x], bits[x + lag])) // 2) >= num * total:
                            found.append((x, x + lag, d))
            if not found:
                continue
            i, j, d = np.array(found, np.int64).T
            if likeliest:  # the nearest partner of either side
                p, q, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
                order = np.lexsort((cls[q], d, cls[p]))
                p, q = p[order], q[order]
                head = np.concatenate([[True], cls[p][1:] != cls[p][:-1]])
                i, j = p[head], q[head]
            both = np.unique(np.sort(np.stack([cls[i], cls[j]], 1), 1), axis=0)
            for at in range(0, len(both), 100_000):
                part = both[at: at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["a", "b"])

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # rows of a block meet each other in its own tile, and those of another block in the tile of both
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "cls", "n", "root",
                         F.when(F.col("own") == F.col("other"), F.xxhash64("cls")).otherwise(F.col("own").cast("bigint")).alias("block"),
                         "chunk", "places", "bits")
    spread = dealt.repartition(shuffle_partitions(members.sparkSession), "tile").sortWithinPartitions("tile", "cls")
    return spread.mapInArrow(compare, "a bigint, b bigint").distinct()


def _near(pairs: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b, apart) of the ``pairs(a, b)`` that sizes, signatures and
    bitmaps let through."""
    num, den = share

    def judge(batches):
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
            x, y = (batch.column(k).to_pylist() for k in (4, 5))
            bits = [batch.column(k).to_pylist() for k in (6, 7)]
            apart = (_matrix(x) != _matrix(y)).sum(1)
            keep = _linkable(n_a, n_b, share) & (apart <= LIMIT)
            for k in np.flatnonzero(keep):
                total = int(n_a[k] + n_b[k])
                keep[k] = (den + num) * ((total - differing(bits[0][k], bits[1][k])) // 2) >= num * total
            yield pa.RecordBatch.from_arrays([*[batch.column(k).filter(pa.array(keep)) for k in (0, 1)], pa.array(apart[keep])],
                                             names=["a", "b", "apart"])

    side = lambda c: classes.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "places", "bits")])
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "places_a", "places_b", "bits_a", "bits_b")
            .mapInArrow(judge, "a bigint, b bigint, apart bigint"))


def _confirmed(pairs: DataFrame, bodies: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets overlap in the wanted share; the
    sets are made again from the texts, which are smaller than the sets."""
    num, den = share

    def settle(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, y = (dict(shingle_sets(part.column(k), width)) for k in (2, 3))
                keep = np.zeros(part.num_rows, bool)
                for k in range(part.num_rows):
                    both = np.concatenate([x[k], y[k]])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep[k] = den * common >= num * (len(both) - common)
                yield part.select([0, 1]).filter(pa.array(keep))

    side = lambda c: bodies.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))
    return (pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(settle, "a bigint, b bigint"))


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs(doc_id, text, row_hash)`` without most rows whose hash is not
    in ``wanted``: a bitmap of 16 bits and more a row, up to ``MOST_MARKS``
    bits; what slips through is joined away."""
    size = 64
    while size < min(16 * wanted.count(), MOST_MARKS):
        size *= 2
    slot = F.shiftrightunsigned("row_hash", 65 - size.bit_length())
    places = wanted.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = places.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    marks = docs.sparkSession.sparkContext.broadcast(table)
    shift = np.uint64(65 - size.bit_length())

    def pick(batches):
        for batch in batches:
            at = batch.column(2).to_numpy().view(np.uint64) >> shift
            keep = marks.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(keep.astype(bool)))

    return docs.mapInArrow(pick, docs.schema)


def _tops(parents: DataFrame, staged: Staged) -> DataFrame:
    """(node, root) of the forest ``parents(a, b)``, one parent a node, by
    pointer doubling."""
    now = staged.write(parents.select(F.col("a").alias("node"), F.col("b").alias("root")))
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        now = staged.write(now.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("node", "root")


def _merged(roots: DataFrame, links: DataFrame, staged: Staged) -> DataFrame:
    """``roots(node, root)`` of the forest after the ``links(a, b)``: roots
    hang themselves below their least neighbour until no link leaves a tree."""
    while True:
        left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
        ends = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y"))
        links = staged.write(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if links.isEmpty():
            return roots
        tops = _tops(links.groupBy("a").agg(F.min("b").alias("b")), staged)
        above = tops.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = staged.write(roots.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(tops))


def near_duplicates(docs: DataFrame, width: int = 4, share: tuple[int, int] = (80, 100), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.  Two sets
    are linked when ``share[1] * intersection >= share[0] * union``; ``kept``
    marks each component's least id."""
    staged = Staged(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(text_col).alias("row_hash"))
    wide = staged.write(_sets(docs, width))
    sets = staged.write(wide.select("doc_id", "row_hash", "n", "cls"))
    # a class stands for all documents with its set; its text is that of its least document
    classes = staged.write(wide.where("cls is not null").groupBy("cls", "n").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "row_hash")).alias("rep"), F.max("places").alias("places"),
        F.max("bits").alias("bits")).select("cls", "n", "least_id", "rep.*", "places", "bits"))
    staged.drop(1)

    filed = _filed(classes)
    same = filed.groupBy("key").agg(F.count("*").alias("size"), F.min("chunk").alias("chunk"), F.bit_xor(F.xxhash64("cls")).alias("who")).where("size > 1")
    buckets = same.groupBy("size", "who").agg(F.min(F.struct("chunk", "key")).alias("x")).select("x.key", "size")
    members = staged.write(filed.join(buckets, "key"))

    degrees = members.groupBy("cls").agg(F.sum(F.col("size") - 1).alias("degree"))
    wanted = staged.write(classes.join(degrees, "cls").drop("least_id"))
    signs = wanted.select("cls", "n", "places", "bits")
    same_row = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.row_hash") == F.col("w.row_hash"))
    bodies = staged.write(_marked(docs, wanted).alias("d").join(wanted.select("cls", "doc_id", "row_hash").alias("w"), same_row).select("cls", "text").dropDuplicates(["cls"]))

    # 1: every member and its bucket's most central member; that order makes the links a forest
    hubs = members.join(wanted.select("cls", "degree"), "cls").groupBy("key").agg(F.max(F.struct("degree", "cls")).alias("hub"))
    spokes = members.join(hubs, "key").select(F.col("cls").alias("a"), F.col("hub.cls").alias("b")).where("a <> b").distinct()
    nearest = _near(spokes, signs, share).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x")).select("a", "x.b")
    roots = _tops(_confirmed(nearest, bodies, width, share), staged)

    # 2 and 3: what no link connects yet
    for likeliest in (True, False):
        rooted = members.join(roots, members["cls"] == roots["node"], "left").select("key", "chunk", "cls", "size", F.coalesce("root", "cls").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        pairs = staged.write(_in_blocks(rooted.join(mixed, "key", "left_semi").join(signs, "cls"), share, likeliest))
        links = staged.write(_confirmed(pairs, bodies, width, share))
        roots = _merged(roots, links, staged)

    rooted = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "least_id", F.coalesce("root", "cls").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("cls", "component_id")
    out = sets.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
