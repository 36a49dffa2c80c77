"""Language-model scores from a hierarchical Pitman-Yor model.

Words are seated in context restaurants: one per two preceding words, whose
parent is that of the one preceding word, whose parent is the corpus
restaurant of words.  That one draws new words from a spelling model:
restaurants of byte contexts (three bytes, which share parents of two bytes,
of one byte, and a root over a uniform base).  A table of a restaurant is a
customer of its parent; training tokens are customers of the restaurants of
two words only.  A text starts with start signs and ends with its end.

Seating is sampled by Gibbs sweeps: given the rest of the state, all
customers of one dish are seated anew, one after the other by the Chinese
restaurant rule (in blocks of an eighth of those already seated, within which
the chance of a new table is held fixed).  A sweep goes from the longest
contexts to the spelling.  Predictive probabilities are averaged over the
kept sweeps.

A text's score is the sum of the log10 predictive probabilities of its words
and its end, each given the words before it.  The text being scored is a
cache restaurant over the context restaurants: it is filled as the text is
read, with one table per distinct word.  That is a fixed rule of scoring;
documents are not restaurants in training and their seating is not sampled.

Word counts cover all training rows and are exact.  Documents are grouped
into chunks of bounded bytes; a chunk asks for each of its distinct words and
of its distinct (context, word) rows once and gets count and probability
back.  With two preceding words the state is packed (``pitman_yor_packed``).
With any other number rows are counted in the task and merged by (context,
word); state and totals of restaurants meet in joins whose hot keys are
salted.  No table of all words or contexts is broadcast.  The spelling model is broadcast:
byte contexts are hashed into a fixed number of restaurants, at most 17 MB a
sample.

Defined cases: a null or empty text is its end alone; without training rows
all probability comes from the spelling model's uniform base; repeated rows
count as often as they come; a null id counts as '' in the held-out rule;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicarta.llm.common import Staged, iter_words, mix, shuffle_partitions, signed

#: Text bytes of one chunk, on average.
CHUNK_BYTES = 24 << 20
SYMBOLS = 257  # bytes and the end of a word
_H2, _H3 = 16, 4  # restaurants per parent at the second and third context byte
_END_HASH = np.int64(0x1F3D5B79)
_START_HASH = np.uint64(0x2C9277B5)
#: Keys with more rows than this and than a sixteenth of a task's are salted.
HOT_ROWS = 1000


@dataclass(frozen=True)
class Settings:
    """Strengths and discounts per level (the discounts of corpus and context
    restaurants come from their counts); preceding words of the longest
    contexts; sweeps."""

    document_strength: float = 20.0
    document_discount: float = 0.9
    word_strength: float = 10.0
    context_strength: float = 1.0
    context_words: int = 2
    strength: float = 1.0
    discount: float = 0.5
    burn_in: int = 2
    samples: int = 2
    seed: int = 7


# ------------------------------------------------------------------ seating


def seat(rng, customers: np.ndarray, weight: np.ndarray, discount) -> np.ndarray:
    """Tables of each dish after seating its customers one after the other.

    ``weight`` is the pull of a new table, (strength + discount * tables of
    the restaurant) * parent's probability, held fixed while one dish is
    seated; an occupied table pulls by its customers less the discount."""
    tables = (customers > 0).astype(np.float64)
    active = np.flatnonzero(customers > 1)
    seated = 1
    while len(active):
        block = max(1, seated // 8)
        left = customers[active] - seated
        step = np.minimum(block, left).astype(np.int64)
        d = discount if np.isscalar(discount) else discount[active]
        t = tables[active]
        pull = weight[active]
        tables[active] = t + rng.binomial(step, np.clip(pull / (pull + seated - d * t), 0.0, 1.0))
        seated += block
        active = active[left > block]
    return tables


# ----------------------------------------------------------------- spelling


def _spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(leaf cell, word) of every symbol of every word, end included.

    A cell is leaf restaurant * SYMBOLS + symbol."""
    words = words.cast(pa.large_binary())
    n = len(words)
    _, offsets_buffer, data_buffer = words.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[words.offset: words.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0]: offsets[-1]] if data_buffer is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(n), lengths + 1)
    first = np.cumsum(lengths + 1) - (lengths + 1)
    place = np.arange(len(owner)) - first[owner]
    symbol = np.full(len(owner), 256, np.int64)
    symbol[place < lengths[owner]] = data
    before = []
    for back in (1, 2, 3):
        b = np.full(len(owner), 256, np.int64)
        b[back:] = symbol[:-back]
        b[place < back] = 256
        before.append(b)
    h = lambda x, m: (x * 40503 >> 5) % m
    leaf = (before[0] * _H2 + h(before[1], _H2)) * _H3 + h(before[2], _H3)
    return leaf * SYMBOLS + symbol, owner


class Spelling:
    """Predictive log probabilities of the leaf cells, one block of
    ``_H2 * _H3`` restaurants per last byte; unseen bytes use the root."""

    def __init__(self, blocks: dict[int, bytes], root: np.ndarray):
        self.blocks, self.root = blocks, root

    def table(self) -> np.ndarray:
        out = np.tile(np.log(self.root).astype(np.float32), (SYMBOLS * _H2 * _H3, 1))
        rows = _H2 * _H3
        for byte, blob in self.blocks.items():
            out[byte * rows:(byte + 1) * rows] = np.frombuffer(blob, np.float32).reshape(rows, SYMBOLS)
        return out.ravel()


def _predict(n, t, parent, s: Settings):
    """Predictive probabilities of restaurants (rows) over symbols."""
    total, tables = n.sum(1, keepdims=True), t.sum(1, keepdims=True)
    return (np.maximum(n - s.discount * t, 0) + (s.strength + s.discount * tables) * parent) / (s.strength + total)


def _sweep_level(rng, n, parent, t, s: Settings):
    """Seat all customers of a level anew, given the parents' predictive."""
    pull = (s.strength + s.discount * t.sum(1, keepdims=True)) * parent
    return seat(rng, n.ravel(), pull.ravel(), s.discount).reshape(n.shape)


def _seat_block(rng, n3: np.ndarray, root: np.ndarray, s: Settings):
    """One last byte's restaurants: leaves, their parents and the byte's own;
    returns the leaf predictive and the tables that go to the root."""
    n3 = n3.reshape(_H2 * _H3, SYMBOLS)
    t3 = (n3 > 0).astype(float)
    t2 = t1 = None
    for _ in range(2):
        n2 = t3.reshape(_H2, _H3, SYMBOLS).sum(1)
        t2 = (n2 > 0).astype(float) if t2 is None else np.minimum(t2, n2)
        n1 = t2.sum(0, keepdims=True)
        t1 = (n1 > 0).astype(float) if t1 is None else np.minimum(t1, n1)
        p1 = _predict(n1, t1, root, s)
        p2 = _predict(n2, t2, p1, s)
        t3 = _sweep_level(rng, n3, np.repeat(p2, _H3, 0), t3, s)
        n2 = t3.reshape(_H2, _H3, SYMBOLS).sum(1)
        t2 = _sweep_level(rng, n2, np.repeat(p1, _H2, 0), np.minimum(t2, n2), s)
        n1 = t2.sum(0, keepdims=True)
        t1 = _sweep_level(rng, n1, root[None, :], np.minimum(t1, n1), s)
    p1 = _predict(n1, t1, root, s)
    p3 = _predict(n3, t3, np.repeat(_predict(n2, t2, p1, s), _H3, 0), s)
    return p3, t1[0]


# ------------------------------------------------------------------ lexicon


def _chunk_words(by_chunk: DataFrame) -> DataFrame:
    """(h, chunk, n, word): distinct words of each chunk, with their count
    in its training rows."""

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(chunks, kind="stable")
            texts = batch.column(2).take(pa.array(order))
            chunks, train = chunks[order], train[order]
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for a, b in zip(cuts, cuts[1:]):
                yield from _count_texts(texts.slice(a, b - a), train[a:b], int(chunks[a]))

    return by_chunk.select("chunk", "train", "text").mapInArrow(count, "h bigint, chunk int, n bigint, word binary")


def _count_texts(texts, train, chunk):
    hashes, seen, spelled = [np.array([_END_HASH]).view(np.uint64)], [np.array([train.sum()])], [[b""]]
    for words in iter_words(texts, lower=True):
        use = np.repeat(train[words.first: words.first + len(words.per_doc)], words.per_doc)
        unique, where, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        hashes.append(unique)
        seen.append(np.bincount(inverse, weights=use, minlength=len(unique)).astype(np.int64))
        blob = words.data
        spelled.append([blob[a:b].tobytes().lower() for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist())])
    unique, where, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(seen), minlength=len(unique)).astype(np.int64)
    flat = [w for part in spelled for w in part]
    words = [flat[i] for i in where.tolist()]
    for at in range(0, len(unique), 50_000):
        k = slice(at, at + 50_000)
        m = len(unique[k])
        yield pa.RecordBatch.from_arrays([pa.array(signed(unique[k])), pa.array(np.full(m, chunk, np.int32)), pa.array(n[k]),
                                          pa.array(words[k], pa.binary())], names=["h", "chunk", "n", "word"])


def _contexts(words, depth: int):
    """(word hash, [context of one preceding word, of two, ...], document) of
    every word of a run, ends included."""
    lengths = words.per_doc + 1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]
    h = np.full(len(owner), _END_HASH).view(np.uint64)
    h[place < words.per_doc[owner]] = words.hashes
    found, context = [], np.zeros(len(h), np.uint64)
    for back in range(1, depth + 1):
        before = np.full(len(h), _START_HASH)
        before[back:] = h[:-back]
        before[place < back] = _START_HASH
        context = mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(before + np.uint64(back)))
        found.append(context)
    return h, found, owner


def _cell_key(context: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(context ^ mix(h))


def _chunk_contexts(by_chunk: DataFrame, depth: int) -> DataFrame:
    """(c1, c2, ..., h, chunk, n): distinct words after their contexts of
    each chunk, with their count in its training rows."""
    names = [f"c{k}" for k in range(1, depth + 1)] + ["h"]

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(chunks, kind="stable")
            texts = batch.column(2).take(pa.array(order))
            chunks, train = chunks[order], train[order]
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for a, b in zip(cuts, cuts[1:]):
                yield from distinct(texts.slice(a, b - a), train[a:b], int(chunks[a]))

    def distinct(texts, train, chunk):
        parts, seen = [], []
        for words in iter_words(texts, lower=True):
            h, contexts, owner = _contexts(words, depth)
            use = train[words.first: words.first + len(words.per_doc)][owner]
            unique, where, inverse = np.unique(_cell_key(contexts[-1], h), return_index=True, return_inverse=True)
            parts.append([unique, *(x[where] for x in contexts), h[where]])
            seen.append(np.bincount(inverse, weights=use, minlength=len(unique)).astype(np.int64))
        columns = [np.concatenate(x) for x in zip(*parts)]
        unique, where, inverse = np.unique(columns[0], return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(seen), minlength=len(unique)).astype(np.int64)
        for at in range(0, len(unique), 50_000):
            k = where[at: at + 50_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(signed(x[k])) for x in columns[1:]), pa.array(np.full(len(k), chunk, np.int32)),
                                              pa.array(n[at: at + 50_000])], names=[*names, "chunk", "n"])

    schema = ", ".join(f"{x} bigint" for x in names) + ", chunk int, n bigint"
    return by_chunk.select("chunk", "train", "text").mapInArrow(count, schema)


def _hot(staged: Staged, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, salts) of the keys that hold more rows than a sixteenth of a
    task's share: at most 16 a task."""
    limit = max(HOT_ROWS, rows.count() // (16 * shuffle_partitions(rows.sparkSession)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    return staged.write(counts.select(*keys, F.ceil(F.col("rows") / limit).cast("int").alias("salts")))


def _join(rows: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, deal: list[str]) -> DataFrame:
    """``rows`` with the columns of ``other`` (one row per key); the rows of a
    hot key are dealt over salts by the columns ``deal``."""
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(*deal), salts).cast("int")).drop("salts")
    right = other.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [*keys, "salt"]).drop("salt")


@dataclass
class _Level:
    """The restaurants of contexts of ``k`` words: ``rows`` (c1 .. ck, h, n
    customers, t tables, ...), the keys that are hot and the discount."""

    k: int
    rows: DataFrame
    hot_context: DataFrame
    hot_parent: DataFrame
    discount: float

    @property
    def context(self) -> str:
        return f"c{self.k}"

    @property
    def parent(self) -> list[str]:
        """The key of the parent's dish."""
        return ["h"] if self.k == 1 else [f"c{self.k - 1}", "h"]

    def weighed(self, rows: DataFrame, prior: DataFrame, s: Settings) -> DataFrame:
        """``rows`` with all customers and tables of the restaurant, and the
        ``pull`` of a new table, by the level's state."""
        totals = self.rows.groupBy(self.context).agg(F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
        met = _join(rows, prior, self.parent, self.hot_parent, [self.context, "h"])
        met = _join(met, totals, [self.context], self.hot_context, ["h"])
        return met.withColumn("pull", (F.lit(s.context_strength) + F.lit(self.discount) * F.col("all_t")) * F.col("p")).drop("p")

    def predictive(self, s: Settings):
        own = F.greatest(F.col("n") - F.lit(self.discount) * F.col("t"), F.lit(0.0))
        return (own + F.col("pull")) / (F.lit(s.context_strength) + F.col("all_n"))

    def seated(self, weighed: DataFrame, s: Settings, number: int) -> DataFrame:
        """``weighed`` with all customers seated anew, without the sums and ``pull``."""
        discount, k = self.discount, self.k
        kept = [c for c in weighed.columns if c not in ("n", "t", "all_n", "all_t", "pull")]
        schema = T.StructType([*[weighed.schema[c] for c in kept], T.StructField("n", T.LongType()), T.StructField("t", T.LongType())])

        def sweep(batches):
            from pyspark import TaskContext

            rng = np.random.default_rng([s.seed, number, k, TaskContext.get().partitionId()])
            for batch in batches:
                n, pull = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
                t = seat(rng, n, pull, discount).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(t)], names=[*kept, "n", "t"])

        ordered = weighed.select(*kept, "n", "pull").sortWithinPartitions(self.context, "h")
        return ordered.mapInArrow(sweep, schema)


def _discount(n1, n2) -> float:
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _context_levels(staged: Staged, asked: DataFrame, s: Settings) -> list[_Level]:
    """Levels of one to ``context_words`` words, one table per dish at first."""
    levels, depth = [], s.context_words
    rows = (asked.groupBy(*[f"c{k}" for k in range(1, depth + 1)], "h").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks"))
            .withColumn("t", (F.col("n") > 0).cast("bigint")).withColumn("total_p", F.lit(0.0)))
    for k in range(depth, 0, -1):
        rows = staged.write(rows)
        few = rows.agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
        parent = ["h"] if k == 1 else [f"c{k - 1}", "h"]
        levels.append(_Level(k, rows, _hot(staged, rows, [f"c{k}"]), _hot(staged, rows, parent), _discount(few.n1, few.n2)))
        rows = _customers(levels[-1]).withColumn("t", (F.col("n") > 0).cast("bigint"))
    return levels[::-1]


def _customers(level: _Level) -> DataFrame:
    """Customers that a level's tables are to its parents, per dish."""
    return level.rows.groupBy(*[f"c{j}" for j in range(1, level.k)], "h").agg(F.sum("t").alias("n"))


def _lexicon(rows: DataFrame) -> DataFrame:
    """(h, word, c, chunks): one row per word, with the chunks that ask."""

    def fold(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            h = table.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            held = table.slice(cut)
            if cut:
                yield from emit(table.slice(0, cut))
        if held is not None:
            yield from emit(held)

    def emit(table):
        table = table.combine_chunks()
        h, chunk, n = (table.column(k).to_numpy() for k in range(3))
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        c = np.add.reduceat(n, starts)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (chunk[1:] != chunk[:-1])])
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(new.astype(np.int64), starts))])
        word = table.column(3).combine_chunks().take(pa.array(starts))
        word = word.combine_chunks() if isinstance(word, pa.ChunkedArray) else word
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[starts]), word.cast(pa.binary()), pa.array(c),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chunk[new], pa.int32()))], names=["h", "word", "c", "chunks"])

    spread = rows.repartition(shuffle_partitions(rows.sparkSession), "h").sortWithinPartitions("h", "chunk")
    return spread.mapInArrow(fold, "h bigint, word binary, c bigint, chunks array<int>")


def _log_spelled(words, table) -> np.ndarray:
    cells, owner = _spell(words)
    return np.bincount(owner, weights=table[cells], minlength=len(words))


def _sweep_words(lexicon: DataFrame, model: Spelling, tables: float, discount: float, s: Settings, number: int) -> DataFrame:
    """(cell, n): customers of the leaf cells after seating all words anew."""
    shared = lexicon.sparkSession.sparkContext.broadcast(model)

    def sweep(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([s.seed, number, TaskContext.get().partitionId()])
        table = shared.value.table()
        sums = np.zeros(len(table), np.float64)
        for batch in batches:
            c = batch.column(1).to_numpy()
            cells, owner = _spell(batch.column(0))
            spelled = np.exp(np.bincount(owner, weights=table[cells], minlength=batch.num_rows))
            t = seat(rng, c, (s.word_strength + discount * tables) * spelled, discount)
            sums += np.bincount(cells, weights=t[owner], minlength=len(table))
        at = np.flatnonzero(sums)
        for lo in range(0, len(at), 100_000):
            part = at[lo: lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part].astype(np.int64))], names=["cell", "n"])

    return lexicon.where("c > 0").select("word", "c").mapInArrow(sweep, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _seat_spelling(cells: DataFrame, root: np.ndarray, s: Settings, number: int) -> tuple[Spelling, np.ndarray, float]:
    """Seat the spelling restaurants, one last byte per group (bounded), and
    the root, whose customers are one small row per byte."""
    width = _H2 * _H3 * SYMBOLS

    def block(key, table):
        byte = key[0].as_py()
        n3 = np.zeros(width)
        n3[table.column("cell").to_numpy() - byte * width] = table.column("n").to_numpy()
        predictive, t1 = _seat_block(np.random.default_rng([s.seed, number, byte]), n3, root, s)
        words = n3.reshape(-1, SYMBOLS)[:, 256].sum()
        return pa.table({"byte": pa.array([byte], pa.int32()), "log_p": pa.array([np.log(predictive).astype(np.float32).tobytes()], pa.binary()),
                         "tables": pa.array([t1.astype(np.float64).tobytes()], pa.binary()), "words": pa.array([float(words)])})

    rows = (cells.withColumn("byte", F.floor(F.col("cell") / width).cast("int")).groupBy("byte")
            .applyInArrow(block, "byte int, log_p binary, tables binary, words double").collect())
    n0 = np.sum([np.frombuffer(r.tables, np.float64) for r in rows], axis=0) if rows else np.zeros(SYMBOLS)
    uniform = np.full((1, SYMBOLS), 1 / SYMBOLS)
    rng = np.random.default_rng([s.seed, number])
    t0 = _sweep_level(rng, n0[None, :], uniform, (n0[None, :] > 0).astype(float), s)
    new_root = _predict(n0[None, :], t0, uniform, s)[0]
    return Spelling({r.byte: bytes(r.log_p) for r in rows}, new_root), new_root, sum(r.words for r in rows)


def _corpus_predictive(words: DataFrame, model: Spelling, tables: float, customers: int, discount: float, s: Settings, number: int) -> DataFrame:
    """(h, p): the corpus restaurant's predictive of every word."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([s.seed, number, 0, TaskContext.get().partitionId()])
        table = shared.value.table()
        for batch in batches:
            c = batch.column(2).to_numpy()
            pull = (s.word_strength + discount * tables) * np.exp(_log_spelled(batch.column(1), table))
            p = (np.maximum(c - discount * seat(rng, c, pull, discount), 0) + pull) / (s.word_strength + customers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["h", "p"])

    return words.select("h", "word", "c").mapInArrow(predict, "h bigint, p double")


def _document_state(key, offsets, owner):
    """Per word of a run: how often its document held it before, how many
    words came before it, and how many distinct ones.  ``key`` differs by
    word and by document."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    seen = np.empty(len(order), np.int64)
    seen[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.concatenate([start, [len(order)]])))
    offsets = offsets[:-1]
    new = np.concatenate([[0], np.cumsum(seen == 0)])
    return seen, np.arange(len(owner)) - offsets[owner], new[:-1] - new[offsets][owner]


def score(docs: DataFrame, training: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score).

    ``training`` marks the rows to learn from; ``base_score`` is the additive
    unigram score with pseudo-count one half."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = narrow.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("docs"), F.count_if("train").alias("train")).first()
    if settings.context_words == 2:
        from lexicarta.llm import pitman_yor_packed

        return pitman_yor_packed.score(narrow, found.size or 0, found.docs, found.train, settings)
    return _score_by_rows(narrow, found.size or 0, settings)


def _score_by_rows(narrow: DataFrame, size: int, s: Settings) -> DataFrame:
    """``score`` of (doc_id, train, text) for contexts of any number of
    words, with one row per distinct (context, word) and chunk."""
    spark = narrow.sparkSession
    staged = Staged(spark)
    count = max(1, -(-size // CHUNK_BYTES))
    chunked = narrow.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int"))
    by_chunk = chunked.repartition(count, "chunk")
    lexicon = staged.write(_lexicon(_chunk_words(by_chunk)))
    stats = lexicon.agg(F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("V")).first()
    total, types, depth = stats.N or 0, stats.V or 0, s.context_words
    levels = _context_levels(staged, _chunk_contexts(by_chunk, depth), s)
    longest = levels[-1]

    def corpus() -> tuple[DataFrame, int, float]:
        """(h, word, c): words and their customers in the corpus restaurant."""
        words = staged.write(lexicon.select("h", "word").join(_customers(levels[0]), "h", "left")
                             .select("h", "word", F.coalesce("n", F.lit(0)).alias("c")))
        few = words.agg(F.sum("c").alias("N"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
        return words, few.N or 0, _discount(few.n1, few.n2)

    def longest_with_prior() -> tuple[DataFrame, list[DataFrame]]:
        """The longest contexts' rows, weighed, and each level's prior."""
        priors = [staged.write(_corpus_predictive(words, model, tables, customers, discount, s, number))]
        for level in levels[:-1]:
            p = level.weighed(level.rows, priors[-1], s).select(level.context, "h", level.predictive(s).alias("p"))
            priors.append(staged.write(p))
        return longest.weighed(longest.rows, priors[-1], s), priors

    words, customers, discount = corpus()
    root, number, before = np.full(SYMBOLS, 1 / SYMBOLS), 0, []
    model, tables = Spelling({}, root), float(types)
    for number in range(s.burn_in + s.samples):
        first = staged.count
        weighed, priors = longest_with_prior()
        if number > s.burn_in:  # the state of the sweep before is kept
            weighed = weighed.withColumn("total_p", F.col("total_p") + longest.predictive(s))
        longest.rows = staged.write(longest.seated(weighed, s, number))
        for upper, level, prior in zip(levels[::-1], levels[-2::-1], priors[-2::-1]):
            level.rows = staged.write(level.seated(level.weighed(_customers(upper), prior, s), s, number))
        words, customers, discount = corpus()
        cells = staged.write(_sweep_words(words, model, tables, discount, s, number))
        model, root, tables = _seat_spelling(cells, root, s, number)
        for old in before:
            staged.drop(old)
        before = list(range(first + 1, staged.count + 1))
    number += 1
    weighed, _ = longest_with_prior()
    mean = (F.col("total_p") + longest.predictive(s)) / max(1, s.samples)
    answers = (weighed.select(F.explode("chunks").alias("chunk"), F.col(longest.context).alias("context"), "h", F.lit(-1).cast("bigint").alias("c"),
                              F.log10(F.greatest(mean, F.lit(1e-300))).alias("lp"))
               .unionByName(lexicon.select(F.explode("chunks").alias("chunk"), F.lit(0).cast("bigint").alias("context"), "h", "c", F.lit(0.0).alias("lp"))))

    def apply(key, left, right):
        h, c, lp = right.column("h").to_numpy().view(np.uint64), right.column("c").to_numpy(), right.column("lp").to_numpy()
        of_word = c >= 0
        cell = _cell_key(right.column("context").to_numpy().view(np.uint64)[~of_word], h[~of_word])
        order = np.argsort(cell)
        cell, lp = cell[order], lp[~of_word][order]
        h, c = h[of_word], c[of_word]
        order = np.argsort(h)
        h, c = h[order], c[order]
        base = np.log10((c + 0.5) / (total + 0.5 * (types + 1)))
        end = int(np.searchsorted(h, np.array([_END_HASH]).view(np.uint64))[0])
        n = left.num_rows
        tokens, known, low, high = np.ones(n, np.int64), np.full(n, int(c[end] > 0)), np.full(n, base[end]), np.zeros(n)
        at = 0
        for texts in left.column("text").chunks:
            for words in iter_words(texts, lower=True):
                place = np.searchsorted(h, words.hashes)
                owner = np.repeat(np.arange(len(words.per_doc)), words.per_doc)
                own = slice(at + words.first, at + words.first + len(words.per_doc))
                m = len(words.per_doc)
                tokens[own] += words.per_doc
                known[own] += np.bincount(owner, weights=c[place] > 0, minlength=m).astype(np.int64)
                low[own] += np.bincount(owner, weights=base[place], minlength=m)
                h_all, contexts, _ = _contexts(words, depth)
                given = lp[np.searchsorted(cell, _cell_key(contexts[-1], h_all))]
                at_end = np.cumsum(words.per_doc + 1) - 1
                inside = np.ones(len(given), bool)
                inside[at_end] = False
                seen, before, distinct = _document_state(words.hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)), words.offsets, owner)
                reused = np.where(seen > 0, seen - s.document_discount, 0.0)
                p = (reused + (s.document_strength + s.document_discount * distinct) * 10.0 ** given[inside]) / (s.document_strength + before)
                high[own] += np.bincount(owner, weights=np.log10(p), minlength=m)
                kinds = np.bincount(owner, weights=seen == 0, minlength=m)
                high[own] += given[at_end] + np.log10((s.document_strength + s.document_discount * kinds) / (s.document_strength + words.per_doc))
            at += len(texts)
        return pa.table({"doc_id": left.column("doc_id"), "train": left.column("train"), "n_tokens": tokens, "n_known": known,
                         "train_tokens": np.full(n, total, np.int64), "base_score": low, "score": high})

    return (chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        apply, "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
