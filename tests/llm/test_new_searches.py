"""MinHash near-duplicates, tokenizer alignment and hard negatives against
plain definitions, and their defined cases."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import ASCII_LOWER, SPACED, docs_frame, prose, same
from pyspark.sql import functions as F

from lexicarta.llm import alignment, hard_negatives, minhash_join

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- minhash

def _linked(rows, width=4):
    """[(id, shingles, least id reachable, kept)]."""
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(ASCII_LOWER))
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
    least = defaultdict(list)
    for g, (i, _) in zip(group, rows):
        least[g] += [] if i is None else [i]
    out = []
    for k, (i, _) in enumerate(rows):
        root = min(least[group[k]], default=None)
        out.append((i, len(sets[k]), root, i == root))
    return out


def _families(rng, groups, copies, words, change):
    texts = []
    for _ in range(groups):
        base = prose(rng, words, 5000)
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(change + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            texts.append(" ".join(w).replace(" ", rng.choice((" ", "\n", "  "))).upper() if rng.random() < .2 else " ".join(w))
    return texts


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    texts = _families(rng, 12, 14, 120, 12) + _families(rng, 8, 6, 9, 1)
    texts += ["", None, " \n\t", "one", "one two", "ONE two", "one two three four", "one two three four", " ", "É é", "É É"]
    texts += [" ".join(prose(rng, 3000, 40)), " ".join(prose(rng, 3000, 40))]
    ids = [None if k % 37 == 5 else rng.randrange(400) for k in range(len(texts))]
    df = docs_frame(spark, texts, ids).withColumn("cls", F.lit("x")).withColumn("n", F.lit(-1)).withColumn("root", F.lit(0))
    got = minhash_join.near_duplicates(df).collect()
    same(got, _linked(list(zip(ids, texts))))


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    """Many texts that share half of their words, so that one bucket holds
    most of them, unlinked; blocks of four."""
    monkeypatch.setattr(minhash_join, "BLOCK", 4)
    rng = random.Random(5)
    base = prose(rng, 100, 9000)
    texts = [" ".join(base[:92] + prose(rng, 8 + k % 8, 9000)) for k in range(60)]
    got = minhash_join.near_duplicates(docs_frame(spark, texts)).collect()
    same(got, _linked(list(enumerate(texts))))


def test_signatures_within_the_limit_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (300, minhash_join.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash_join.HASHES, rng.integers(0, minhash_join.LIMIT + 1), replace=False)
        row[at] ^= 1
    shared = [len(set(x) & set(y)) for x, y in zip(minhash_join.keys(a).tolist(), minhash_join.keys(b).tolist())]
    assert min(shared) >= 1


def test_signatures_estimate_similarity_and_bitmaps_bound_it():
    rng = np.random.default_rng(2)
    for size, other in ((40, 10), (3000, 400), (20_000, 2000)):
        shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, other, dtype=np.uint64)])) for _ in range(2))
        a, b = minhash_join.signatures([x, y])
        assert abs((a == b).mean() - size / (size + 2 * other)) < 0.25
        assert minhash_join.differing(minhash_join.bitmap(x), minhash_join.bitmap(y)) <= 2 * other


def test_near_duplicates_of_nothing(spark):
    assert minhash_join.near_duplicates(docs_frame(spark, ["a"]).limit(0)).collect() == []


# ---------------------------------------------------------------- alignment

def _plain_alignment(rows):
    """The contract on whole texts: both libraries, then sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(BPE)
    bpe.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    decode = alignment.byte_characters()
    docs = []
    for i, t in rows:
        groups = []
        if t:
            raw = b" " + t.encode()
            a, b = bpe.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            x = [bytes(decode[c] for c in bpe.id_to_token(k)) for k in a]
            y = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(x) == raw == b"".join(y):
                ends = [list(itertools.accumulate(map(len, z))) for z in (x, y)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                lo = 0
                for hi in cuts:
                    groups.append(([k for k, e in zip(a, ends[0]) if lo < e <= hi], [k for k, e in zip(b, ends[1]) if lo < e <= hi]))
                    lo = hi
        docs.append((i, groups))
    held = Counter(p for _, g in docs for p in {(a, b) for x, y in g for a in x for b in y})
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for i, g in docs:
        links = [(a, b) for x, y in g for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(held[p] == top[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "x<|endoftext|>y", "</s> <s> <unk> [INST]", "<0x41>", "▁", "a ▁b c", "漢字 かな交じり文",
       "😀😀 🏳️‍🌈 é é", "\x00\x01 \x7f", "tab\there\n\nline \r\n", "na me", "ﬁ ① Å", "a" * 700, "=" * 300 + " " * 90 + "x", "1234567890" * 9,
       "Ünïcödé wörds", "don't we'll I'VE", "中" * 200, "\n", "　wide", "same text", "same text"]


@pytest.mark.parametrize("head_pairs", [1 << 18, 3])
def test_alignment_matches_brute_force(spark, head_pairs):
    """With a tiny broadcast table most pairs go through the join."""
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice("ab .,\n\té漢😀<>/s0x41|'-_A  ") for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    ids = [None if k % 31 == 3 else k // 2 for k in range(len(texts))]
    df = docs_frame(spark, texts, ids).withColumn("pairs", F.lit(1)).withColumn("row", F.lit("r")).withColumn("n_best", F.lit(2.5))
    got = alignment.align(df, BPE, PIECES, head_pairs=head_pairs).collect()
    same(got, _plain_alignment(list(zip(ids, texts))))


def test_alignment_of_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows if len(r.text) < 20_000]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BPE, PIECES).collect()
    same(got, _plain_alignment(rows))
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), BPE, PIECES).collect() == []


def test_runs_and_irregular_groups():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randrange(1, 200)
        share = rng.choice((0.05, 0.5, 0.98))
        a, b = (sorted({n, *[k for k in range(1, n) if rng.random() < share]}) for _ in range(2))
        odd = alignment.irregular_groups(np.array(a, np.uint32), np.array(b, np.uint32))
        cuts, lo, expected = sorted(set(a) & set(b)), 0, []
        for hi in cuts:
            x, y = [k for k, e in enumerate(a) if lo < e <= hi], [k for k, e in enumerate(b) if lo < e <= hi]
            if len(x) != 1 or len(y) != 1:
                expected.append([x[0], x[-1] + 1, y[0], y[-1] + 1])
            lo = hi
        assert odd.tolist() == expected


# ---------------------------------------------------------------- hard negatives

def _plain_negatives(rows, n_pos=5, n_neg=10):
    usable = [(i, g, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, g, v in rows
              if i is not None and g is not None and v and all(x is not None and np.isfinite(x) and abs(x) <= 1 << 16 for x in v)]
    moved = [(i, (g + 1) % 10 if i % 7 == 0 else g, v) for i, g, v in usable]
    out = []
    for i, g, v in {(i, g, tuple(v)) for i, g, v in moved if i % 100 == 0}:
        scored = [(-sum(x * y for x, y in zip(v, w)), j, h) for j, h, w in moved if j != i and len(w) == len(v)]
        for s, p, _ in sorted(t for t in scored if t[2] == g)[:n_pos]:
            inside = sorted(t for t in scored if t[2] != g and 30 * -s <= 100 * -t[0] <= 90 * -s)
            out += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate(inside[:n_neg], 1)]
    return out


def _vectors(rng, n, d, spread):
    centres = rng.normal(size=(6, d))
    return [(k, int(rng.integers(0, 10)), (centres[rng.integers(0, 6)] + spread * rng.normal(size=d)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("block", [16_384, 23])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2 if block == 23 else 4096)
    rows = _vectors(np.random.default_rng(3), 420, 12, 0.6)
    rows += [(500, 3, [0.0] * 12), (600, 1, [1.0, 2.0]), (601, 1, [1.0, 2.0]), (602, 2, [0.5, 1.0]), (603, 2, [0.5, 1.0]), (None, 1, [1.0] * 12),
             (700, None, [1.0] * 12), (800, 1, None), (900, 1, []), (1000, 1, [None] * 12), (1100, 1, [float("nan")] * 12), (1200, 1, [float("inf")] * 12),
             (1300, 1, [1e30] * 12), (1400, 9, [-0.001] * 12), (200, 4, [0.25] * 12)]
    rows += [(451, 5, [0.5] * 12)] * 3  # repeated rows, ties
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("anchor", F.lit(1)).withColumn("rb", F.lit("x"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df.repartition(3), F.col("vec_id") % 100 == 0, moved).collect()
    same(got, _plain_negatives(rows))


def test_lists_stop_early_and_exactly():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-400, 400, (3000, 3))
    index = hard_negatives.Lists(vectors)
    for anchor in (*rng.integers(-400, 400, (40, 3)), np.zeros(3, np.int64), np.array([0, -7, 0])):
        found, scores = index.search(anchor, lambda r, s: hard_negatives._kth(s, 7, -np.inf))
        assert (scores == vectors[found] @ anchor).all()
        assert sorted(scores)[-7:] == sorted(vectors @ anchor)[-7:]
        ids = np.arange(3000)
        best = found[hard_negatives._first(found, scores, 7)]
        assert best.tolist() == np.lexsort((ids, -(vectors @ anchor)))[:7].tolist()
    assert len(index.search(np.array([300, 200, -100]), lambda r, s: hard_negatives._kth(s, 7, -np.inf))[0]) < 1500


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0, F.col("label")).collect() == []
