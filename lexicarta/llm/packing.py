"""Best-fit packing (hierarchical residual packing).

Each document is tokenised, closed with an end id and, if longer than the
sequence length, cut into full pieces (the first piece takes the remainder).
Pieces are packed best-fit-decreasing inside every partition; nearly full
bins are final, underfull bins travel on as items and are packed again with
the bins of neighbouring partitions, round after round (tree merge).

Defined cases: a null or empty text is the end id alone; the string of a
special token in a text becomes that token's id; repeated rows and
ids are packed as separate documents; an empty table gives no rows; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.common import Staged

END_ID = 2
#: Items that one task packs at a time; more items mean more tasks.
ITEMS_PER_TASK = 50_000
#: Fan-in of the merge tree.
FAN_IN = 8
#: A bin is final when its free space is at most this share of the length.
NEARLY_FULL = 0.004
#: Entries of the per-worker table of encoded chunks; it only saves time.
CACHE_ENTRIES = 400_000
#: Groups of chunks that the tokenizer encodes in one call; its results take some 200 bytes a token until they are read.
GROUPS = 20

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_BIN = "bin_id bigint, fill int, members array<struct<doc_id:bigint, piece:int, start:bigint, length:bigint, ids_crc32:bigint, offset:int, ids:binary>>"

_encoders: dict[str, ChunkEncoder] = {}
#: Other white space than single spaces and line ends between words, or a null.
_LOOSE_SPACE = (r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
#: Bytes: 1 opens a chunk, 2 opens one after a letter, 4 is a letter.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x0A]], _KIND[[0x2E, 0x2C]] = 1, 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 4


class ChunkEncoder:
    """Ids of a byte-level BPE file, through a table of encoded chunks.

    A token never crosses a single space between two non-space characters
    (the space opens the next token), a single line end (a token of its
    own), nor the place between a letter and a full stop or comma, so a text
    cut there gives the same ids as the whole text.  The file's special
    tokens hold none of these: their strings in a text stay inside a chunk
    and become their one id.

    Cuts are found on the bytes of a whole run of texts; Python sees each
    distinct chunk of a run once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab()
        #: bytes that each id stands for: a character of a byte-level token is one byte
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(special[i].encode()) if i in special else len(token)
        self.clear()

    def clear(self) -> None:
        #: entry k of the table, an Arrow array of chunks: ids[edges[k]: edges[k + 1]]
        self.table = pa.array([], pa.large_binary())
        self.edges, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text with loose white space."""
        first, *rest = text.split(" ")
        out, open_ = [], first
        for p in rest:
            if open_ and p and not open_[-1].isspace() and not p[0].isspace():
                out.append(open_)
                open_ = " " + p
            else:
                open_ = open_ + " " + p
        out.append(open_)
        return out

    def _cut(self, texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
        """Chunks of texts without loose white space, and their number per text."""
        _, offsets_buffer, data_buffer = texts.buffers()
        offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset: texts.offset + len(texts) + 1]
        data = np.frombuffer(data_buffer, np.uint8)[offsets[0]: offsets[-1]] if data_buffer is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        opens = kind == 1
        stops = np.flatnonzero(kind == 2)
        stops = stops[stops > 1]
        last, lead = data[stops - 1], data[stops - 2]
        # U+00C0 to U+023F are letters of two bytes, but for the signs of multiplication and division
        latin = (lead >= 0xC3) & (lead <= 0xC8) & (last >= 0x80) & (last < 0xC0) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        opens[stops[(kind[stops - 1] == 4) | latin]] = True
        opens[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        edges = np.append(np.flatnonzero(opens), len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        return chunks, np.diff(np.searchsorted(edges[:-1], offsets))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return []
        if len(self.table) > CACHE_ENTRIES:
            self.clear()
        loose = pc.match_substring_regex(texts, _LOOSE_SPACE)
        kept = loose.to_numpy(zero_copy_only=False)
        if not kept.any():
            return self._encoded(*self._cut(texts))
        plain = iter(self._encoded(*self._cut(texts.filter(pc.invert(loose)))))
        cut = [self.chunks(t) for t in texts.filter(loose).to_pylist()]
        other = iter(self._encoded(pa.array([c.encode() for chunks in cut for c in chunks], pa.large_binary()),
                                   np.array([len(c) for c in cut]), loose=True))
        return [next(other if k else plain) for k in kept.tolist()]

    def _encoded(self, chunks: pa.Array, per_text: np.ndarray, loose: bool = False) -> list[bytes]:
        coded = chunks.dictionary_encode()
        entry = pc.index_in(coded.dictionary, value_set=self.table).fill_null(-1).to_numpy()
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry = entry.copy()
            # entries in the order in which chunks were learned
            learned = self._learn(coded.dictionary.take(pa.array(new)).to_pylist(), loose)
            entry[new[learned]] = len(self.table) - len(new) + np.arange(len(new))
        entry = entry[coded.indices.to_numpy()]
        starts, sizes = self.edges[entry], self.edges[entry + 1] - self.edges[entry]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])].astype("<u4", copy=False)
        edges = (4 * ends[np.concatenate([[0], np.cumsum(per_text)])]).tolist()
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip(edges, edges[1:])]

    def _learn(self, chunks: list[bytes], loose: bool) -> np.ndarray:
        """Chunks of one space and what follows it are encoded many in one
        text; the places of ``chunks`` in the order of the new entries."""
        joined, alone = [], []
        for k, c in enumerate(chunks):
            (joined if c[:1] == b" " and not loose else alone).append(k)
        groups = [joined[i: i + 500] for i in range(0, len(joined), 500)] + [[k] for k in alone]
        found_ids, found_sizes = [self.ids], []
        for i in range(0, len(groups), GROUPS):
            part = [[chunks[k] for k in group] for group in groups[i: i + GROUPS]]
            for group, found in zip(part, self.tokenizer.encode_batch_fast([b"".join(g).decode() for g in part], add_special_tokens=False)):
                ids = np.array(found.ids, np.uint32)
                # a chunk's ids stand for its bytes
                after = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(c) for c in group]), "left") + 1
                found_ids.append(ids)
                found_sizes.append(np.diff(after, prepend=0) if len(group) > 1 else np.array([len(ids)]))
        order = np.array([*joined, *alone], np.int64)
        self.ids = np.concatenate(found_ids)
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(np.concatenate(found_sizes))])
        self.table = pa.concat_arrays([self.table, pa.array([chunks[k] for k in order.tolist()], pa.large_binary())])
        return order


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _runs(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``limit`` bytes, with the place of the first text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = 1024, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32, ids).
    ``ids`` is null unless ``keep_ids``."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, run in _runs(batch.column(1).fill_null("")):
                rows = [[], [], [], [], [], []]
                for k, tokens in enumerate(encoder(tokenizer_path).encode(run)):
                    tokens += end
                    n = len(tokens) // 4
                    head = n % length or length
                    edges = [0, *range(head, n + 1, length)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = tokens[4 * a: 4 * b]
                        for col, value in zip(rows, (ids[at + k], p, a, b - a, zlib.crc32(part), part if keep_ids else None)):
                            col.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(cut, _PIECES + ", ids binary")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item.  Bins with the same
    free space are stacked; a bit set finds the tightest that fits."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits, count = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_bits &= ~(1 << room)
        else:
            b, room, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        free[left].append(b)
        open_bits |= 1 << left
    return bins, offsets


def _pack_round(items: DataFrame, tasks: int, capacity: int, number: int) -> DataFrame:
    """Best-fit every partition's items (bins of earlier rounds)."""
    kinds = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                                ("ids_crc32", pa.int64()), ("offset", pa.int32()), ("ids", pa.binary())]))

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, rows, made = [], 0, 0

        def flush():
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            fill = table.column("fill").to_numpy()
            lists = table.column("members").combine_chunks()
            counts = np.diff(lists.offsets.to_numpy())
            members = lists.flatten()
            bins, offsets = best_fit(fill, capacity)
            item = np.repeat(np.arange(len(fill)), counts)
            order = np.lexsort((np.arange(len(item)), offsets[item], bins[item]))
            shifted = members.field("offset").to_numpy(zero_copy_only=False) + offsets[item]
            moved = pa.StructArray.from_arrays(
                [*[members.field(k) for k in range(5)], pa.array(shifted, pa.int32()), members.field(6)],
                fields=list(kinds.value_type)).take(pa.array(order))
            n = int(bins.max()) + 1
            ends = np.concatenate([[0], np.cumsum(np.bincount(bins[item], minlength=n))])
            ids = (number << 56) | (part << 32) | (made + np.arange(n))
            made += n
            totals = np.bincount(bins, weights=fill, minlength=n).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.int32()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), moved).cast(kinds)],
                                             names=["bin_id", "fill", "members"])
            for at in range(0, n, 5000):
                yield out.slice(at, 5000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(["fill", "members"]))
                rows += batch.num_rows
            if rows >= ITEMS_PER_TASK:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return items.select("fill", "members").repartition(tasks).mapInArrow(pack, _BIN)


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pack pieces (at most ``capacity`` long) into sequences: the pieces
    with (sequence_id, offset).

    Rounds go on until one task has merged all that is left, or nothing at
    all was merged or taken out in as few tasks as the items allow; every
    task packs at most ``ITEMS_PER_TASK`` items at a time, and a task's bins
    are merged with those of ``FAN_IN`` - 1 others in the next round.  Bins
    are taken out early when nearly full, or when their free space is below
    the smallest fill that remains.
    """
    spark = pieces.sparkSession
    staged = Staged(spark)
    spare = int(capacity * NEARLY_FULL)
    items = staged.write(pieces.select(
        F.col("length").cast("int").alias("fill"),
        F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).alias("offset"), "ids")).alias("members")))
    number, tasks, left, done = 1, None, items.count(), []
    while True:
        needed = max(1, -(-left // ITEMS_PER_TASK))
        tasks = needed if tasks is None else max(needed, tasks // FAN_IN)
        bins = staged.write(_pack_round(items, tasks, capacity, number))
        least = bins.where(F.col("fill") < capacity - spare).agg(F.min("fill").alias("n")).first().n or 0
        final = (F.col("fill") >= capacity - spare) | (F.col("fill") > capacity - least)
        count = bins.where(~final).count()
        # a lone task has merged all that is left
        if tasks == 1 or count == left and tasks == needed:
            done.append(bins)
            break
        done.append(bins.where(final))
        items, left, number = bins.where(~final), count, number + 1
    packed = reduce(DataFrame.unionByName, done)
    return packed.select("bin_id", F.explode("members").alias("m")).select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.piece").alias("piece"), F.col("m.start").alias("start"),
        F.col("m.length").alias("length"), F.col("m.ids_crc32").alias("ids_crc32"),
        F.col("bin_id").alias("sequence_id"), F.col("m.offset").cast("bigint").alias("offset"), F.col("m.ids").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents; with ``keep_ids`` every row also
    holds its little-endian 32-bit ids."""
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, keep_ids), capacity)
