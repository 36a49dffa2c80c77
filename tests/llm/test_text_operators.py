"""Jaccard join, substring removal, decontamination, language model and
language ID against plain-Python twins, odd inputs included."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import (bucket, components, contamination, docs_frame, prose, repeats, same, sha, unigram)
from pyspark.sql import functions as F

from lexicarta.llm import langid, ngram_join, phrase_dedup, pitman_yor, winnow
from lexicarta.llm.common import PIECE, iter_words, sliding_argmin

ODD = [None, "", "   \t\n", "one", "one two three four", "One TWO three four", "a\tb\nc d\x0be f", "x" * 5000, "\u00a0 \x1c é漢 😀 word"]


def corpus(seed=0):
    """Odd texts, exact and near copies, shared passages, repeated lines."""
    rng = random.Random(seed)
    texts = list(ODD) + ["one", "", None]
    for _ in range(12):
        base = prose(rng, rng.choice((6, 30, 90, 300)))
        texts.append(" ".join(base))
        texts.append(" \n".join(base))
        for _ in range(3):
            near = list(base)
            for _ in range(rng.choice((1, 2, 8))):
                near[rng.randrange(len(near))] = f"n{rng.randrange(999)}"
            texts.append(" ".join(near))
    shared, line = prose(rng, 120, 10_000), prose(rng, 7)
    for k in range(14):
        a, b = rng.randrange(0, 50), rng.randrange(60, 121)
        texts.append(" ".join(prose(rng, 40, 10_000) + shared[a:b] + prose(rng, 10, 10_000) + line * (k % 4) * 9))
    texts.append(" ".join(["same"] * 400))
    texts.append(" ".join(["same"] * 130))
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = corpus()
    ids = list(range(100, 100 + len(texts)))
    ids[3] = None
    ids[8] = ids[7]
    texts[9], ids[9] = texts[10], ids[10]  # a repeated row
    return list(zip(ids, texts))


def frame(spark, rows):
    """Further columns carry the names that the operators use inside."""
    return (docs_frame(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("n", F.lit("x")).withColumn("cls", F.lit(1))
            .withColumn("row_hash", F.lit(2)).withColumn("words", F.lit("w")).withColumn("n_words", F.lit(-1)))


def test_words_of_long_and_odd_texts():
    texts = [*ODD, " ".join(f"v{i}" for i in range(PIECE // 4)), "y" * (PIECE + 10) + " z"]
    found = {}
    for words in iter_words(pa.array(texts), lower=True):
        off = words.offsets
        for i in range(len(words.per_doc)):
            spans = zip(words.starts[off[i]:off[i + 1]], words.ends[off[i]:off[i + 1]])
            found[words.first + i] = [words.data[a:b].tobytes() for a, b in spans]
    assert [found[i] for i in range(len(texts))] == [(t or "").encode().split() for t in texts]


def test_words_take_bounded_memory(monkeypatch):
    """Beside the words found, a worker holds little more than one piece."""
    import tracemalloc

    from lexicarta.llm import common

    texts = pa.array(["ab cdefgh ij\n" * 20_000] * 16)
    monkeypatch.setattr(common, "_tables", {})
    tracemalloc.start()
    n = sum(len(words.hashes) for words in iter_words(texts, lower=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3 * 20_000 * 16 and peak < 32 << 20


def test_only_sizes_that_can_be_linked_share_a_tile(spark):
    rows = spark.createDataFrame([(1, c, n) for c, n in enumerate((10, 11, 100, 124, 154, 1000))] + [(2, 0, 10), (2, 1, 11), (3, 7, 5), (3, 8, 7)],
                                 "token bigint, cls bigint, n int")
    tiles = {}
    for r in ngram_join._tiles(rows, (80, 100)).collect():
        tiles.setdefault(r.tile, set()).add(r.cls)
    assert sorted(map(sorted, tiles.values())) == [[0, 1], [2, 3, 4]]


def test_large_tiles_pair_only_sizes_that_can_be_linked(spark):
    rng, size = np.random.default_rng(3), {k: int(60 * 1.12 ** k) for k in range(45)}
    rows = [(1, k, n, k, bytearray(ngram_join._signature(rng.integers(0, 1 << 63, n).astype(np.uint64)))) for k, n in size.items()]
    members = spark.createDataFrame(rows, "tile bigint, cls bigint, n int, root bigint, signature binary")
    pairs = ngram_join._possible(members, (80, 100), False).collect()
    assert all(80 * max(size[r.a], size[r.b]) <= 100 * min(size[r.a], size[r.b]) for r in pairs)


def test_equal_words_hash_alike_and_others_do_not():
    texts = ["Word word WORD", "other\tword", "worde wor"]
    hashes = np.concatenate([w.hashes for w in iter_words(pa.array(texts), lower=True)])
    assert len(set(hashes[[0, 1, 2, 4]])) == 1 and len(set(hashes)) == 4


def test_sliding_argmin_takes_the_leftmost():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 6, 500).astype(np.uint64) << np.uint64(40)
    expected = [i + int(np.argmin(values[i:i + 43])) for i in range(500 - 42)]
    assert sliding_argmin(values, 43).tolist() == expected


def test_jaccard_components(spark, rows):
    got = ngram_join.jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), components(rows))


def test_jaccard_does_not_depend_on_the_counters(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "_frequent", lambda docs, width: np.arange(ngram_join.COUNTERS) % 3 == 0)
    got = ngram_join.jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), components(rows))


@pytest.mark.parametrize("small", [2, 32])
def test_jaccard_second_round_alone_finds_all(spark, rows, monkeypatch, small):
    """Without first-round links the second round must find every link, in
    small tiles and in large ones."""
    real, calls = ngram_join._links, []

    def links(pairs, sets, share):
        calls.append(1)
        found = real(pairs, sets, share)
        return found.limit(0) if len(calls) == 1 else found

    monkeypatch.setattr(ngram_join, "_links", links)
    monkeypatch.setattr(ngram_join, "SMALL_TILE", small)
    got = ngram_join.jaccard_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), components(rows))


def test_jaccard_near_copies_below_the_threshold(spark):
    """A group of copies with so many edits that only some pairs are linked."""
    rng = random.Random(9)
    base = prose(rng, 150, 10_000)
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    got = ngram_join.jaccard_components(docs_frame(spark, texts)).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), components(rows))


def test_jaccard_of_large_sets(spark):
    """Sets with longer signatures, near the threshold on both sides."""
    rng = random.Random(11)
    base = prose(rng, 2600, 10**6)
    texts = []
    for edits in (0, 5, 40, 55, 58, 60, 62, 65, 120, 900):
        t = list(base)
        for k in rng.sample(range(len(t)), edits):
            t[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t[: 2600 - edits]))
    texts += [" ".join(prose(rng, 1500, 10**6) + base[:400]), " ".join(prose(rng, 40, 10**6) + base[:400])]
    rows = list(enumerate(texts))
    got = ngram_join.jaccard_components(docs_frame(spark, texts)).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), components(rows))


def test_keep_one_of_each_group(spark, rows):
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    expected = components(rows)
    least = {(i if i is not None else -1, t) for (i, t), (_, n, c) in zip(rows, expected) if n == 0 or i == c}
    got = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) <= least | {(-1, t) for _, t in rows}
    groups = {c for _, n, c in expected if n}
    assert {g for g in groups if g is not None} <= {i for i, _ in got}


def test_substring_removal(spark, rows):
    source = frame(spark, rows)
    found = phrase_dedup.remove_repeats(source).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], repeats(rows))
    for r in found:
        if r.n_removed == 0:
            assert (r.doc_id, r.text) in rows
        else:
            assert sha(r.text) == r.kept_sha256


def test_substring_removal_with_small_automata(spark, rows, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "AUTOMATON_BYTES", 1)
    found = phrase_dedup.remove_repeats(frame(spark, rows)).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], repeats(rows))


def test_decontamination(spark, rows):
    rng = random.Random(5)
    long = [t.split() for _, t in rows if t and len(t.split()) > 60]
    items = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, " ".join(long[0][5:30])), (11, "One"), (12, "é漢 😀 word"),
             *[(20 + k, " ".join(w[s:s + 20]).upper()) for k, w in enumerate(long) for s in [rng.randrange(len(w) - 30)]]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = winnow.decontaminate(frame(spark, rows), bench).collect()
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, sha(",".join(r["items"])), r.contaminated) for r in found], contamination(rows, items))
    clean = winnow.clean_documents(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == sum(not r.contaminated for r in found)


def test_decontamination_is_native(spark, rows):
    plan = winnow.decontaminate(frame(spark, rows), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_language_model_counts(spark, rows):
    source = frame(spark, rows)
    found = pitman_yor.score(source, ~F.col("doc_id").cast("string").endswith("1")).collect()
    train = [i is not None and not str(i).endswith("1") for i, _ in rows]
    expected = [(i, *c[:3], round(c[3], 6)) for (i, _), c in zip(rows, unigram(rows, train))]
    same([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found], expected)
    assert all(r.score < 0 for r in found)


def test_language_model_prefers_its_language(spark):
    rng = random.Random(1)
    texts = [" ".join(prose(rng, 200, 80)) for _ in range(30)] + [" ".join(f"q{rng.randrange(10**6)}z" for _ in range(200))]
    found = pitman_yor.score(docs_frame(spark, texts), F.col("doc_id") < 25).collect()
    score = {r.doc_id: r.score / r.n_tokens for r in found}
    assert score[30] < min(score[k] for k in range(25, 30)) - 1


def test_predictive_probabilities_sum_to_one():
    """Over all strings up to a length, the spelling model sums towards one."""
    rng = np.random.default_rng(0)
    n3 = np.zeros((64, 257))
    n3[3, [97, 98, 256]] = [40, 5, 7]
    root = np.full(257, 1 / 257)
    p3, t1 = pitman_yor._seat_block(rng, n3, root, pitman_yor.Settings())
    assert np.allclose(p3.sum(1), 1) and t1.sum() >= 3 and p3[3, 97] > 0.5


def test_seating_matches_one_by_one():
    """Mean tables of the blocked seating against the plain process."""
    rng, n, d, pull = np.random.default_rng(3), 200, 0.6, 2.0
    plain = []
    for _ in range(400):
        t = 1
        for k in range(1, n):
            t += rng.random() < pull / (pull + k - d * t)
        plain.append(t)
    blocked = pitman_yor.seat(rng, np.full(400, n), np.full(400, pull), d)
    assert abs(np.mean(plain) - blocked.mean()) < 0.5


def test_language_id(spark):
    rng = random.Random(2)
    kinds = {"aa": "the and of that with from which", "bb": "der und die das nicht ein ist", "cc": "que los una para por con del"}
    texts, langs = [], []
    for k in range(240):
        lang = ("aa", "aa", "bb", "cc")[k % 4]
        words = kinds[lang].split()
        texts.append(" ".join(rng.choice(words) + rng.choice(("", "", words[0])) for _ in range(60)))
        langs.append(lang)
    texts += ODD + ["123 456", "The the The"]
    langs += [None] * len(ODD) + [None, "aa"]
    docs = docs_frame(spark, texts, langs=langs).withColumn("score", F.lit("clash"))
    model = langid.fit(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    assert list(model.dictionaries)[0] == "aa" and set(model.dictionaries) == set(kinds)
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(found) == len(texts)
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([found[k].lang_pred == langs[k] for k in held]) > 0.97
    for k, t in enumerate(texts):
        assert (found[k].lang_pred == "und") == (not any(map(str.isalpha, t or "")))
        assert 0 <= found[k].score <= 1
    kept = langid.predict(docs, model, keep=True)
    assert "text" in kept.columns and kept.count() == len(texts)


def test_language_id_without_labels(spark):
    docs = docs_frame(spark, ["some text", None], langs=[None, None])
    found = langid.predict(docs, langid.fit(docs, F.lit(True))).collect()
    assert {r.lang_pred for r in found} == {"und"}


def test_empty_tables(spark):
    docs = docs_frame(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.jaccard_components(docs).count() == 0
    assert phrase_dedup.remove_repeats(docs).count() == 0
    assert winnow.decontaminate(docs, bench).count() == 0
    assert pitman_yor.score(docs, F.lit(True)).count() == 0
    assert langid.predict(docs, langid.fit(docs, F.lit(True))).count() == 0
    one = docs_frame(spark, ["a b c", None])
    assert [r.n_hit for r in winnow.decontaminate(one, bench).collect()] == [0, 0]


def test_bucket_rule(spark):
    from lexicarta.llm.common import id_bucket

    ids = [0, 1, 77, None, -5]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", id_bucket(F.col("doc_id")).alias("b")).collect()
    same(got, [(i, bucket(i)) for i in ids])


def test_language_of_copies_keeps_its_dictionary(spark):
    """Languages of thousands of copies of a few texts: every distinct text
    is in the dictionary."""
    texts, langs = [], []
    for lang in range(6):
        for k in range(3):
            texts += [f"language {lang} text {k}"] * 1000
            langs += [f"l{lang}"] * 1000
    model = langid.fit(docs_frame(spark, texts, langs=langs), F.lit(True))
    assert {g: sorted(d.decode().split("\n")) for g, d in model.dictionaries.items()} == {
        f"l{g}": [f"language {g} text {k}" for k in range(3)] for g in range(6)}


def test_language_model_knows_one_and_two_preceding_words(spark):
    """The same words in trained and other order, no word twice."""
    chain = [f"w{k}" for k in range(40)]
    train = [" ".join(chain)] * 30 + ["left middle east", "right middle west"] * 30
    held = [" ".join(chain[10:20]), " ".join(chain[19:9:-1]), "left middle east", "left middle west"]
    n = len(train)
    found = pitman_yor.score(docs_frame(spark, train + held), F.col("doc_id") < n).collect()
    score = {r.doc_id - n: r.score for r in found}
    assert score[0] > score[1] + 5  # one preceding word
    assert score[2] > score[3] + 0.5  # two


def test_context_tables_are_the_parents_customers(spark):
    """After any number of seatings: tables per dish lie between one and its
    customers, and all tables of a level are its parents' customers."""
    from lexicarta.llm.common import Staged

    s = pitman_yor.Settings()
    rng = random.Random(4)
    docs = docs_frame(spark, [" ".join(prose(rng, 120, 12)) for _ in range(20)])
    by_chunk = docs.selectExpr("0 as chunk", "true as train", "text").repartition(1, "chunk")
    staged = Staged(spark)
    one, two = pitman_yor._context_levels(staged, pitman_yor._chunk_contexts(by_chunk, 2), s)
    assert two.rows.agg(F.sum("n")).first()[0] == 20 * 121
    prior = one.rows.select("c1", "h").distinct().withColumn("p", F.lit(0.05))
    two.rows = staged.write(two.seated(two.weighed(two.rows, prior, s), s, 0))
    seated = two.rows.agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.min(F.col("n") - F.col("t")).alias("least"), F.min("t").alias("t1")).first()
    assert seated.least >= 0 and seated.t1 == 1 and two.rows.count() < seated.t < seated.n == 20 * 121
    assert pitman_yor._customers(two).agg(F.sum("n")).first()[0] == seated.t


def test_filters_keep_columns_of_any_name(spark):
    """Working columns never meet the caller's, whatever they are called."""
    rng = random.Random(12)
    texts = [" ".join(prose(rng, 40)) for _ in range(6)] * 2
    docs = docs_frame(spark, texts).withColumn("row_hash", F.lit(1)).withColumn("n", F.lit("n"))
    for name in ("__id", "__hash", "__own", "group"):
        docs = docs.withColumn(name, F.lit(name))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(6))
    items = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    clean = winnow.clean_documents(docs, items).collect()
    assert sorted(r.doc_id for r in clean) == [k for k in range(12) if k % 6] and all(r["__own"] == "__own" for r in clean)
