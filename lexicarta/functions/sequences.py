"""Sequences of word vectors, put together by runs of documents over whole
Arrow batches: a document comes in as its words and goes out with its vectors,
and no row of a single word is made in between."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are cut into words at once, and bytes of vectors that a worker returns at once.
RUN_TEXTS, RUN_BYTES = 10_000, 8 << 20


def packed_table(table: pa.Table, dim: int) -> tuple[bytes, bytes]:
    """``table(token, vecs)``, a row per token: the tokens with their numbers
    of vectors, and the vectors, after them a zero vector and null."""
    bags = table.column(1)
    ends = pa.array([[0.0] * dim, None], bags.type.value_type.field(0).type)
    vecs = pa.concat_arrays([*(pc.struct_field(c.flatten(), 0) for c in bags.chunks), ends])
    return _written(pa.table({"token": _whole(table.column(0)), "n": pa.array(_lengths(bags))})), _written(pa.table({"vec": vecs}))


class Vectors:
    """A packed table whose vectors are numbered: those of token k are
    ``first[k]`` and the ``n[k] - 1`` after it, ``zero`` is the zero vector and
    ``none`` is null.  ``unknown`` marks the null ones."""

    def __init__(self, packed: tuple[bytes, bytes]):
        tokens, vecs = (pa.ipc.open_stream(x).read_all() for x in packed)
        self.tokens, self.n, self.vecs = _whole(tokens.column(0)), tokens.column(1).to_numpy(), _whole(vecs.column(0))
        self.first = _starts(self.n)
        self.zero, self.none = len(self.vecs) - 2, len(self.vecs) - 1
        self.unknown = _mask(self.vecs.is_null())


def _written(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


def _whole(column) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _mask(a) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _lengths(lists) -> np.ndarray:
    return _mask(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n[0] - 1, 0, 1, .. n[1] - 1, .."""
    return np.arange(n.sum()) - np.repeat(_starts(n), n)


def _runs(at: np.ndarray, most: int):
    """(start, end) of runs of rows; row k begins at ``at[k]`` of the values,
    and a run has about ``most`` values, or one row."""
    rows = len(at) - 1
    ends = np.append(np.flatnonzero(np.diff(at[1:] // most)) + 1, rows) if rows else np.zeros(0, int)
    return zip(np.append(0, ends[:-1]), ends)


def sequences(batch: pa.RecordBatch, table: Vectors, dim: int, max_len: int):
    """Batches (key, pos, v) of a batch (key, texts[, far]).

    ``texts`` are the texts of a key, words parted by one space; ``far`` are
    (slot, vec) entries of words that are not in the table, by the word's
    number in the key's texts.  ``v`` has exactly ``max_len`` vectors.  Where a
    key has several texts it has their entries up to the position of the
    ``max_len``-th, null for a word without a vector, and ``pos`` has the
    positions; it is null elsewhere."""
    for a, b in _runs(np.append(0, np.cumsum(_lengths(batch.column(1)) + 1)), RUN_TEXTS):
        yield from _sequences(batch.slice(a, b - a), table, dim, max_len)


def _sequences(batch: pa.RecordBatch, table: Vectors, dim: int, max_len: int):
    n_texts = _lengths(batch.column(1))
    cut = pc.split_pattern(batch.column(1).flatten(), " ")
    n_words = _lengths(cut)
    words = cut.flatten()
    row = np.repeat(np.repeat(np.arange(batch.num_rows), n_texts), n_words)
    pos = _steps(n_words)
    k = _mask(pc.fill_null(pc.index_in(words, value_set=table.tokens.cast(words.type)), -1))
    known = k >= 0
    n, first = np.ones(len(k), np.int64), np.full(len(k), table.none)
    n[known], first[known] = table.n[k[known]], table.first[k[known]]
    unknown, far = table.unknown, None
    if batch.num_columns > 2:
        n_far, entries = _lengths(batch.column(2)), batch.column(2).flatten()
        slots, far = pc.struct_field(entries, 0), pc.struct_field(entries, 1)
        begin = _starts(np.bincount(row, minlength=batch.num_rows))
        found = np.bincount(np.repeat(begin, n_far) + _mask(slots), minlength=len(k))
        first = np.where(found > 0, table.none + 1 + _starts(found), first)
        n = np.where(found > 0, found, n)
        unknown = np.concatenate([unknown, _mask(far.is_null())])
    source = np.repeat(first, n) + _steps(n)
    row, pos = np.repeat(row, n), np.repeat(pos, n)

    mixed = n_texts > 1
    source[unknown[source] & ~mixed[row]] = table.zero
    if mixed.any():
        order = np.lexsort((pos, row))
        row, pos, source = row[order], pos[order], source[order]
    at = _steps(np.bincount(row, minlength=batch.num_rows))
    last = np.full(batch.num_rows, max_len)
    last[row[at == max_len - 1]] = pos[at == max_len - 1]
    kept = np.where(mixed[row], pos <= last[row], at < max_len)
    row, pos, source, at = row[kept], pos[kept], source[kept], at[kept]
    start = np.append(0, np.cumsum(np.where(mixed, np.bincount(row, minlength=batch.num_rows), max_len)))
    vectors, places = np.full(start[-1], table.zero), np.zeros(start[-1], np.int32)
    vectors[start[row] + at], places[start[row] + at] = source, pos

    for a, b in _runs(start, max(1, RUN_BYTES // max(1, 4 * dim))):
        v = pa.ListArray.from_arrays(pa.array(start[a:b + 1] - start[a], pa.int32()), _taken(table, far, vectors[start[a]:start[b]]))
        if mixed[a:b].any():
            p = pa.array([places[x:y] if m else None for x, y, m in zip(start[a:b], start[a + 1:b + 1], mixed[a:b])], pa.list_(pa.int32()))
        else:
            p = pa.nulls(b - a, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), p, v], names=[batch.schema.names[0], "__pos", "__v"])


def _taken(table: Vectors, far, numbers: np.ndarray) -> pa.Array:
    """The vectors of these numbers; numbers after ``none`` are those of ``far``."""
    away = numbers > table.none
    if not away.any():
        return table.vecs.take(pa.array(numbers))
    f = numbers[away] - table.none - 1
    lo, near = f.min(), numbers[~away]
    both = pa.concat_arrays([table.vecs.take(pa.array(near)), far.slice(lo, f.max() - lo + 1)])
    order = np.empty(len(numbers), np.int64)
    order[~away], order[away] = np.arange(len(near)), len(near) + f - lo
    return both.take(pa.array(order))
