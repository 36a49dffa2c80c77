"""N-gram Jaccard self-join: documents whose shingle sets overlap by a given
share, and the groups that these links make.

Sets are compared in size-banded tiles.  A tile holds the sets that share
one shingle of their prefix, in the order of size; each is compared with the
band of sizes that can still be linked to it.  The prefix is the part of a
set, under one global order, of which two linked sets must share a shingle;
shingles that are frequent by a counter table come last in that order, so
common passages open no tiles.  Inside a tile, bit counts of hashed bitmap
signatures bound the overlap from above; survivors are settled by
intersecting the sorted arrays.  In a first round every member of a tile
proposes its likeliest partner, a second compares all that no link
connects yet, so a group of near copies does not become all its pairs.
Every step is exact: whatever the counters say, any fixed order gives the
same links.

Sets are 64-bit hashes of shingles; a class is one distinct set (exact and
same-word copies collapse before any tile is built).

Defined cases: a null or empty text, or one of separators alone, has no
shingles and no links; a text shorter than a shingle is one shingle; repeated
rows and ids are documents of their own; a null id never is a component's
id unless all its documents lack one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import Staged, grams, iter_words, mix, shuffle_partitions, signed
from lexicarta.llm.components import connected_components

#: Counters of the frequency table and of the candidate filter: fixed size.
COUNTERS, SEGMENTS = 1 << 22, 16
FILTER_BITS = 1 << 23
SIGNATURE_BYTES = 128
#: Bits per shingle of the fine signatures, which pairs pass before their arrays are moved.
FINE = 4
#: Larger tiles are compared in blocks.
SMALL_TILE = 32


def shingle_sets(texts: pa.Array, width: int):
    """(position of the text, sorted distinct shingle hashes) of every text
    with a word; short texts are one shingle."""
    for words in iter_words(texts, lower=True):
        flat = grams(words.hashes, width)
        offsets = words.offsets
        for i in np.flatnonzero(words.per_doc):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b - a >= width:
                yield words.first + int(i), np.unique(flat[a: b - width + 1])
            else:
                yield words.first + int(i), grams(words.hashes[a:b], b - a)


def _class_of(tokens: np.ndarray) -> np.uint64:
    total = np.array([mix(tokens + np.uint64(0x9E37)).sum(dtype=np.uint64), len(tokens)], np.uint64)
    return mix(total[:1] + mix(total[1:]))[0]


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Bit per counter: its shingles are frequent.  Counts cover all texts;
    tasks' tables are summed and judged segment by segment on the executors,
    and only the bits come back."""
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)
    part = COUNTERS // SEGMENTS

    def count(batches):
        table = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for words in iter_words(batch.column(0), lower=True):
                flat = grams(words.hashes, width)
                if len(flat):
                    doc = np.repeat(np.arange(len(words.per_doc)), words.per_doc)
                    inside = doc[: len(flat)] == doc[width - 1:]
                    np.add.at(table, (flat[inside] >> shift).astype(np.int64), np.uint32(1))
        for k in range(SEGMENTS):
            yield _segment(k, zlib.compress(table[k * part:(k + 1) * part].tobytes(), 1))

    def judge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = sums.setdefault(k, np.zeros(part, np.uint64))
                table += np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint32)
        for k, table in sums.items():
            mean = float(table.mean())
            yield _segment(k, np.packbits(table > mean + 8 * mean ** 0.5 + 4).tobytes())

    rows = (docs.select("text").mapInArrow(count, "segment int, blob binary").repartition(SEGMENTS, "segment")
            .mapInArrow(judge, "segment int, blob binary").collect())
    found = {r.segment: bytes(r.blob) for r in rows}
    return np.unpackbits(np.frombuffer(b"".join(found.get(k, bytes(part // 8)) for k in range(SEGMENTS)), np.uint8)).astype(bool)


def _segment(k: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["segment", "blob"])


def _signature(tokens: np.ndarray, per_shingle: int = 1) -> bytes:
    """Hashed bitmap: each bit is the parity of the shingles that map to it.
    Larger sets get more bits, by doubling, at least so many per shingle."""
    size = 8 * SIGNATURE_BYTES
    while size < per_shingle * len(tokens):
        size *= 2
    places = (mix(tokens) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=size).astype(np.uint8) & 1).tobytes()


def _folded(signature: bytes, size: int) -> np.ndarray:
    """The signature with fewer bits: halves laid over each other."""
    bits = np.frombuffer(signature, np.uint64)
    return np.bitwise_xor.reduce(bits.reshape(-1, size // 8), axis=0)


def _differing(x: bytes, y: bytes) -> int:
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _sets(docs: DataFrame, width: int, share: tuple[int, int], frequent: np.ndarray) -> DataFrame:
    """(doc_id, row_hash, n, cls, prefix, signature).  The last two are null
    on all but the first of a task's equal sets: copies are combined before
    any shuffle."""
    num, den = share
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent).tobytes())

    def build(batches):
        hot = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        seen = set()
        for batch in batches:
            ids = batch.column(0)
            n = np.zeros(batch.num_rows, np.int64)
            cls = np.zeros(batch.num_rows, np.uint64)
            prefix, signature = ([None] * batch.num_rows for _ in range(2))
            for i, tokens in shingle_sets(batch.column(1), width):
                size = len(tokens)
                n[i], cls[i] = size, _class_of(tokens)
                if cls[i] in seen:
                    continue
                seen.add(cls[i])
                late = hot[(tokens >> shift).astype(np.int64)]
                ordered = np.concatenate([tokens[~late], tokens[late]])
                # two linked sets share at least ceil(num * size / den) of this one's shingles
                prefix[i] = signed(np.ascontiguousarray(ordered[: size - -(-num * size // den) + 1]))
                signature[i] = _signature(tokens)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(2), pa.array(n), pa.array(signed(cls), pa.int64(), mask=n == 0), pa.array(prefix, longs),
                 pa.array(signature, pa.binary())], names=["doc_id", "row_hash", "n", "cls", "prefix", "signature"])

    return docs.mapInArrow(build, "doc_id bigint, row_hash bigint, n bigint, cls bigint, prefix array<bigint>, "
                                  "signature binary")


def _candidate_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(cls, tokens, fine): sorted arrays and fine signatures of the classes
    in ``reps(doc_id)``, from the texts.  A fixed-size filter spares the other documents the work; what
    slips through is joined away later, or gives a link twice."""
    def fold(ids):
        return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)

    def mark(batches):
        table = np.zeros(FILTER_BITS // 32, np.uint32)
        for batch in batches:
            at = fold(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(table, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        yield _segment(0, table.tobytes())

    def merge(batches):
        table = np.zeros(FILTER_BITS // 32, np.uint32)
        for batch in batches:
            for blob in batch.column(1):
                table |= np.frombuffer(blob.as_py(), np.uint32)
        yield _segment(0, table.tobytes())

    marked = reps.select("doc_id").where("doc_id is not null").mapInArrow(mark, "segment int, blob binary")
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in marked.repartition(8).mapInArrow(merge, "segment int, blob binary").collect():
        table |= np.frombuffer(bytes(row.blob), np.uint32)
    packed = table.tobytes()

    def build(batches):
        wanted = np.frombuffer(packed, np.uint32)
        seen = set()
        for batch in batches:
            ids = batch.column(0)
            at = fold(ids.fill_null(0).to_numpy())
            keep = (wanted[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
            if not keep.any():
                continue
            texts = batch.column(1).filter(pa.array(keep))
            found, size = [], 0
            for _, tokens in shingle_sets(texts, width):
                cls = int(_class_of(tokens).view(np.int64))
                if cls in seen:
                    continue
                seen.add(cls)
                found.append((cls, tokens.tobytes(), _signature(tokens, FINE)))
                size += 8 * len(tokens)
                if size > 8 << 20:
                    yield _token_batch(found)
                    found, size = [], 0
            if found:
                yield _token_batch(found)

    return docs.select("doc_id", "text").mapInArrow(build, "cls bigint, tokens binary, fine binary")


def _token_batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                                      names=["cls", "tokens", "fine"])


def _whole_runs(batches, width: int):
    """Column lists cut so that rows with an equal first column stay
    together; the rows come sorted by it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        if held is not None:
            new = [np.concatenate([h, x]) for h, x in zip(held, new)]
        cut = int(np.searchsorted(new[0], new[0][-1], "left"))
        held = [x[cut:] for x in new]
        if cut:
            yield [x[:cut] for x in new]
    if held is not None:
        yield held


def _tiles(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(tile, cls, n): the members of every tile, ``rows(token, cls, n)``.

    A tile is the set of classes that share a shingle of their prefixes,
    parted wherever the next size is too large to be linked to the one before
    (no larger one can be, either); tiles with the same members are one tile,
    named by a hash of them."""
    num, den = share

    def gather(batches):
        for token, cls, n in _whole_runs(batches, 3):
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])  # copies are neighbours
            token, cls, n = token[first], cls[first], n[first]
            apart = n[1:].astype(np.int64) * num > n[:-1].astype(np.int64) * den
            heads = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | apart]))
            sizes = np.diff(np.concatenate([heads, [len(token)]]))
            name = mix(np.add.reduceat(mix(cls.view(np.uint64)), heads) + sizes.astype(np.uint64))
            once = np.zeros(len(heads), bool)
            once[np.unique(name, return_index=True)[1]] = True
            keep = np.repeat(once & (sizes > 1), sizes)
            tile = np.repeat(signed(name), sizes)[keep]
            for at in range(0, len(tile), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(tile[part]), pa.array(cls[keep][part]), pa.array(n[keep][part])],
                                                 names=["tile", "cls", "n"])

    spread = rows.select("token", "cls", "n").repartition(shuffle_partitions(rows.sparkSession), "token")
    return spread.sortWithinPartitions("token", "n", "cls").mapInArrow(gather, "tile bigint, cls bigint, n int").distinct()


def _possible(members: DataFrame, share: tuple[int, int], first: bool) -> DataFrame:
    """The pairs (a, b) of ``members(tile, cls, n, root, signature)`` with
    different roots that bit counts cannot rule out.

    A bit in which two signatures differ stands for a shingle of one side
    alone, so intersection <= (sizes - differing bits) / 2.  A tile is
    compared in the order of size, each member with those up to the largest
    size that can be linked.  In the first round every member proposes its
    likeliest partner only (per block of a large tile); the second compares
    all that are not connected by then."""
    num, den = share

    def passing(n, x, y, i, j):
        sizes = n[i] + n[j]
        most = (sizes - np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)) // 2
        return most, (den + num) * most >= num * sizes

    def small(tile, n, root, bits):
        last = np.searchsorted(tile, tile, "right")
        ahead = np.arange(len(tile))
        for lag in range(1, SMALL_TILE):
            ahead = ahead[ahead + lag < last[ahead]]
            ahead = ahead[n[ahead + lag] * num <= n[ahead] * den]
            if not len(ahead):
                return
            for at in range(0, len(ahead), 50_000):
                i = ahead[at: at + 50_000]
                i = i[root[i] != root[i + lag]]
                most, ok = passing(n, bits[i], bits[i + lag], i, i + lag)
                yield i[ok], i[ok] + lag, most[ok]

    def large(n, root, bits):
        for lo in range(0, len(n), 64):
            i = np.arange(lo, min(lo + 64, len(n)))
            end = int(np.searchsorted(n, n[i[-1]] * den // num, "right"))
            for at in range(lo, end, 2048):
                j = np.arange(at, min(at + 2048, end))
                most, ok = passing(n, bits[i][:, None], bits[j][None, :], i[:, None], j[None, :])
                ok &= (j[None, :] > i[:, None]) & (root[i][:, None] != root[j][None, :])
                ok &= n[j][None, :] * num <= n[i][:, None] * den  # the block's largest size set the end
                p, q = np.nonzero(ok)
                yield i[p], j[q], most[p, q]

    def likeliest(i, j, most):
        """The partner with the largest bound of every ``i``."""
        order = np.lexsort((j, -most, i))
        i, j = i[order], j[order]
        head = np.ones(len(i), bool)
        head[1:] = i[1:] != i[:-1]
        return i[head], j[head]

    def compare(batches):
        for tile, cls, n, root, signature in _whole_runs(batches, 5):
            n = n.astype(np.int64)
            length = np.fromiter(map(len, signature), np.int64, len(signature))
            bits = np.empty((len(signature), SIGNATURE_BYTES // 8), np.uint64)
            short = length == SIGNATURE_BYTES
            bits[short] = np.frombuffer(b"".join(signature[short]), np.uint64).reshape(-1, SIGNATURE_BYTES // 8)
            for k in np.flatnonzero(~short).tolist():
                bits[k] = _folded(signature[k], SIGNATURE_BYTES)

            def finer(i, j):
                """Of the pairs that pass, those of two long signatures that pass at full length."""
                keep = np.ones(len(i), bool)
                for k in np.flatnonzero(~short[i] & ~short[j]).tolist():
                    sizes = int(n[i[k]] + n[j[k]])
                    keep[k] = (den + num) * ((sizes - _differing(signature[i[k]], signature[j[k]])) // 2) >= num * sizes
                return keep

            heads = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            sizes = np.diff(np.concatenate([heads, [len(tile)]]))
            few = np.flatnonzero(np.repeat(sizes <= SMALL_TILE, sizes))
            near = list(small(tile[few], n[few], root[few], bits[few]))
            found = []
            if near:
                i, j, most = (np.concatenate([x[k] for x in near]) for k in range(3))
                keep = finer(few[i], few[j])
                i, j, most = i[keep], j[keep], most[keep]
                found = [(few[x], few[y]) for x, y in [likeliest(i, j, most) if first else (i, j)]]
            for h, m in zip(heads[sizes > SMALL_TILE].tolist(), sizes[sizes > SMALL_TILE].tolist()):
                own = slice(h, h + m)
                for i, j, most in large(n[own], root[own], bits[own]):
                    keep = finer(i + h, j + h)
                    i, j = likeliest(i[keep], j[keep], most[keep]) if first else (i[keep], j[keep])
                    found.append((i + h, j + h))
            if found:
                a, b = cls[np.concatenate([i for i, _ in found])], cls[np.concatenate([j for _, j in found])]
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                for at in range(0, len(both), 100_000):
                    part = both[at: at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["a", "b"])

    spread = (members.select("tile", "cls", "n", "root", "signature")
              .repartition(shuffle_partitions(members.sparkSession), "tile").sortWithinPartitions("tile", "n", "cls"))
    return spread.mapInArrow(compare, "a bigint, b bigint").distinct()


def _links(possible: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose sorted arrays intersect in the wanted share.  Fine
    signatures, a sixteenth of the arrays' size, go ahead of the arrays."""
    num, den = share

    def bound(batches):
        for batch in batches:
            sizes = [x + y for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = [(den + num) * ((n - _differing(x, y)) // 2) >= num * n
                    for n, x, y in zip(sizes, batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def settle(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    def sides(pairs, column):
        size = (F.octet_length("tokens") / 8).cast("bigint")
        left = sets.select(F.col("cls").alias("a"), size.alias("na"), F.col(column).alias("xa"))
        right = sets.select(F.col("cls").alias("b"), size.alias("nb"), F.col(column).alias("xb"))
        return pairs.join(left, "a").join(right, "b")

    close = sides(possible, "fine").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(bound, "a bigint, b bigint").distinct()
    return sides(close, "tokens").select("a", "b", "xa", "xb").mapInArrow(settle, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100),
                       id_col: str = "doc_id", text_col: str = "text", staged: Staged | None = None) -> DataFrame:
    """(doc_id, row_hash, n_shingles, group, component_id) of every document;
    ``group`` is one number per component, null without shingles.  Two sets
    are linked when ``share[1] * intersection >= share[0] * union``.  Tables
    go to ``staged``, which has none yet."""
    staged = staged or Staged(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(text_col).alias("row_hash"))
    wide = staged.write(_sets(docs, width, share, _frequent(docs, width)))
    firsts = wide.where("prefix is not null")
    sets = staged.write(wide.select("doc_id", "row_hash", "n", "cls"))
    reps = staged.write(sets.where("cls is not null").groupBy("cls", "n").agg(F.min("doc_id").alias("doc_id"))
                        .join(firsts.select("cls", "signature").dropDuplicates(["cls"]), "cls"))

    signatures = reps.select("cls", "signature")
    tiles = staged.write(_tiles(firsts.select(F.explode("prefix").alias("token"), "cls", F.col("n").cast("int").alias("n")), share))
    tiles_at = staged.count
    staged.drop(1)  # prefixes have become tiles

    def links(members: DataFrame, first: bool) -> DataFrame:
        possible = staged.write(_possible(members.join(signatures.hint("merge"), "cls"), share, first))
        ends = possible.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        arrays = staged.write(_candidate_sets(docs, reps.select("cls", "doc_id").join(ends, "cls", "left_semi"), width))
        found = staged.write(_links(possible, arrays, share))
        staged.drop(staged.count - 1)
        staged.drop(staged.count - 2)
        return found

    roots = connected_components(links(tiles.withColumn("root", F.col("cls")), True), staged)
    # what is connected by now needs no further link: tiles with two roots or more are compared again
    rooted = tiles.join(roots, tiles["cls"] == roots["node"], "left").select("tile", "cls", "n", F.coalesce("root", "cls").alias("root"))
    mixed = rooted.groupBy("tile").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("tile")
    far = links(rooted.join(mixed, "tile", "left_semi"), False)
    staged.drop(tiles_at)
    final = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(far), staged)

    rooted = reps.join(final, reps["cls"] == final["node"], "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("cls", F.col("root").alias("group"), "component_id")
    return (sets.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
            .select("doc_id", "row_hash", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the least id's (nulls
    last).  Documents without shingles stay; repeated rows of one id and text
    are one document."""
    staged = Staged(docs.sparkSession)
    found = staged.last(jaccard_components(docs, id_col=id_col, text_col=text_col, staged=staged, **options))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_hash"))
    least = found.where("group is not null").groupBy("group").agg(F.min(first).alias("x")).select("x.doc_id", "x.row_hash")
    stay = least.unionByName(found.where("group is null").select("doc_id", "row_hash").distinct())
    # names are qualified: the caller's columns may have any name
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("s.row_hash"))

    def joined(left, right, how):
        return left.alias("d").join(right.alias("s"), same, how)

    kept = joined(docs, stay, "left_semi")
    repeated = found.groupBy("doc_id", "row_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if repeated.isEmpty():  # ids are unique: no text is moved again
        return kept
    once = joined(kept, repeated, "left_semi").dropDuplicates([id_col, text_col])
    return joined(kept, repeated, "left_anti").unionByName(once)
