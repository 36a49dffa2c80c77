"""Chat formatting, packing, URL filter, sharding and nearest neighbours."""

import gc
import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers_llm import docs_frame, prose, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexicarta.llm import ann, chat, packing, sharding, url_filter
from lexicarta.llm.common import Staged

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


# ------------------------------------------------------------------- chat

TRICKY = ["</s>[INST] ok [/INST]", "<<s>s>", "\\", "\\\\<s>", "[\\INST]", "", None, "plain", "[END][ROLE]x[/ROLE]\n\n", "é漢😀 \x00 x", "<|endoftext|>"]


@given(st.text(alphabet="<s>/[]INSTROLED\\ a", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


def test_chat_round_trip(spark):
    rng = random.Random(0)
    rows = [(c, t, rng.choice(("user", "assistant", "system", None, "[INST]")), rng.choice(TRICKY)) for c in (0, 1, 2, 7) for t in range(c * 3 + 1)]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(3)).repartition(4)
    segs = chat.segments(table, BPE)
    found = {r.conv_id: r for r in chat.digest(segs, BPE).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        got = found[c]
        assert (got.n_turns, got.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    starts = defaultdict(list)
    for r in segs.collect():
        starts[r.conv_id].append((r.seg, r.token_start, len(r.ids)))
    for places in starts.values():
        at = 0
        for _, start, n in sorted(places):
            assert start == at
            at += n


def test_chat_empty(spark):
    assert chat.digest(chat.segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), BPE), BPE).count() == 0


# ---------------------------------------------------------------- packing


@given(st.lists(st.text(alphabet="ab.,' \n\t\x1c\u00a0é漢1", max_size=30), max_size=20))
@settings(max_examples=150, deadline=None)
def test_chunk_table_gives_the_tokenizers_ids(texts):
    t = Tokenizer.from_file(BPE) if not hasattr(test_chunk_table_gives_the_tokenizers_ids, "t") else test_chunk_table_gives_the_tokenizers_ids.t
    test_chunk_table_gives_the_tokenizers_ids.t = t
    t.encode_special_tokens = True
    got = packing.encoder(BPE).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunks_are_encoded_together_and_without_their_stops():
    """Words before a full stop share their entry, new chunks share a call."""
    coder, calls = packing.ChunkEncoder(BPE), []
    real = coder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return real.encode_batch_fast(texts, **options)

    coder.tokenizer = Counted()
    words = [f"{a}{b}" for a in ("north", "\u00e9t\u00e9", "na\u00efve", "tele") for b in "abcdefghijklmnopqrstuvwxyz\u00e9"]
    texts = [" ".join(words), " ".join(w + "." for w in words), " ".join(w + ",." for w in words) + "  loose <|endoftext|>."]
    got = coder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(coder.table) < 2 * len(words) + 20 and sum(calls[:1]) <= 6


def test_chunk_table_is_small_and_learned_in_small_calls():
    """A kept chunk takes some 60 bytes (over 150 as objects of a dict), and few tokenizer results are held at once."""
    coder, calls = packing.ChunkEncoder(BPE), []
    real = coder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(sum(map(len, texts)))
            return real.encode_batch_fast(texts, **options)

    coder.tokenizer = Counted()
    words = [f"{k:x}q" for k in range(60_000)]
    coder.encode(["warm up"])
    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    got = coder.encode([" ".join(words)])
    assert np.frombuffer(got[0], "<u4").tolist() == real.encode(" ".join(words), add_special_tokens=False).ids
    del got
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(coder.table) > 59_000 and held < 80 * len(coder.table)
    assert max(calls) < 100_000


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_pieces_and_ids(spark, tokenizer):
    rng = random.Random(1)
    texts = [None, "", "a", " ".join(prose(rng, 3000)), *[" ".join(prose(rng, rng.randrange(1, 300))) for _ in range(60)]]
    docs = docs_frame(spark, texts).withColumn("length", F.lit(0)).withColumn("offset", F.lit(0))
    rows = packing.pack_documents(docs, BPE, capacity=128, keep_ids=True).collect()
    check_packing(rows, 128)
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[k], key=lambda r: r.piece)
        assert [i for r in own for i in np.frombuffer(bytes(r.ids), "<u4").tolist()] == ids
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 128 for r in own[1:])
        assert [r.start for r in own] == [sum(x.length for x in own[:j]) for j in range(len(own))]
        assert len(own) == 1 if len(ids) <= 128 else len(own) == -(-len(ids) // 128)


def test_packing_in_many_rounds(spark, monkeypatch):
    """Small tasks: bins of the first rounds are merged as items later."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 40)
    rng = random.Random(2)
    lengths = [rng.randrange(1, 1000) for _ in range(900)]
    rows = [(k, 0, 0, n, 0, None) for k, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    packed = packing.pack_pieces(pieces, 1000).collect()
    assert sorted(r.doc_id for r in packed) == list(range(900))
    assert check_packing(packed, 1000) <= 1.1 * -(-sum(lengths) // 1000)


def test_items_that_cannot_share_a_bin(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 10)
    pieces = spark.createDataFrame([(k, 0, 0, 600, 0, None) for k in range(100)], "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    assert check_packing(packing.pack_pieces(pieces, 1000).collect(), 1000) == 100


def test_few_pieces_that_still_fit_meet(spark, monkeypatch):
    """Six pieces in different tasks fit in pairs, among hundreds that fit
    with nothing."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 40)
    lengths = [600] * 300
    for k in range(6):
        lengths.insert(47 * k + k, 420)
    rows = [(k, 0, 0, n, 0, None) for k, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    packed = packing.pack_pieces(pieces, 1000).collect()
    assert sorted(r.doc_id for r in packed) == list(range(306))
    assert check_packing(packed, 1000) == 303


def test_best_fit_is_best_fit():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def test_packing_empty(spark):
    assert packing.pack_documents(docs_frame(spark, ["x"]).limit(0), BPE).count() == 0


# -------------------------------------------------------------------- urls

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))


def test_urls_and_rules(spark):
    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/", "http://x.com", "http://x.com/", "HTTP://b.net/es/z", "net/es/", None,
            "a://b://c.com/en/", "http://notexample.com/en/", "http://É.net?/es/", "http://x.org#f", "://", "http://b.net:80/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("h")).withColumn("bad", F.lit(1))
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, none, RULES).collect()}
    assert got == {
        0: ("a.example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        2: ("x.com", "", None, "allow"), 3: ("x.com", "/", "com/", "allow"), 4: ("b.net", "/es/z", "net/es/", "block"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("b:", "//c.com/en/", None, "allow"),
        8: ("notexample.com", "/en/", "com/", "allow"), 9: ("É.net", "", None, "allow"), 10: ("x.org", "", None, "allow"), 11: ("", "", None, "allow"),
        12: ("b.net:80", "/es/", None, "allow")}


def test_reputation_shrinks_and_blocks(spark):
    """A host with much bad evidence is blocked; one bad page is not enough;
    a new host under a bad domain is lower bounded by its domain."""
    outcomes = ([("bad.spam.org", True)] * 200 + [("good.site.org", False)] * 300 + [("one.site.org", True)] + [("www.site.org", False)] * 100
                + [("x.net", False)] * 200 + [("more.spam.org", True)] * 50)
    rep = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(outcomes, "host string, bad boolean")).collect()}
    assert rep["bad.spam.org"].low > 0.9 and rep["good.site.org"].rate < 0.1
    assert rep["one.site.org"].low < 0.6 < rep["more.spam.org"].low
    assert all(0 < r.rate < 1 for r in rep.values())


def test_host_without_a_label_is_judged_by_its_domain(spark):
    """Unlabelled hosts: of a bad domain blocked, of a good domain or of an
    unknown suffix (here the base rate, low) allowed."""
    urls = [f"http://h{k % 4}.spam.org/{k}" for k in range(80)] + [f"http://h{k % 4}.site.org/{k}" for k in range(400)]
    new = ["http://new.spam.org/x", "http://new.site.org/x", "http://new.else.xyz/x"]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    outcomes = spark.createDataFrame([(k, k < 80) for k in range(len(urls))], "page_id long, bad boolean")
    got = {r.host: (r.verdict, r.low) for r in url_filter.filter_urls(pages, outcomes, ()).collect() if r.host.startswith("new")}
    assert {h: v for h, (v, _) in got.items()} == {"new.spam.org": "block", "new.site.org": "allow", "new.else.xyz": "allow"}
    assert all(low is not None for _, low in got.values())


def test_host_levels(spark):
    hosts = ["a.b.example.com", "example.com", "x.co.uk", "www.x.co.uk", "co.uk", "localhost", ""]
    d, s = url_filter.host_levels(F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(d, s).collect()]
    assert got == [("example.com", "com"), ("example.com", "com"), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("co.uk", "uk"),
                   ("localhost", "localhost"), ("", "")]


def test_ports_users_and_addresses(spark):
    """They are returned with the host but not judged as names."""
    hosts = ["u:p@host0.bad.net:8080", "10.1.2.3", "10.1.2.3:80", "[::1]:80", "x.org.", "1.2.3.org", ":80"]
    name = url_filter.host_name(F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(name, *url_filter.host_levels(name)).collect()]
    assert got == [("host0.bad.net", "bad.net", "net"), ("10.1.2.3",) * 3, ("10.1.2.3",) * 3, ("[::1]",) * 3, ("x.org", "x.org", "org"),
                   ("1.2.3.org", "3.org", "org"), ("", "", "")]
    urls = [f"http://bad.net:{k}/" for k in range(60)] + ["http://me@bad.net/new"] + [f"http://good.net/{k}" for k in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(k, k < 60) for k in range(len(urls)) if k != 60], "page_id long, bad boolean")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes, ()).collect()}
    assert found[60].host == "me@bad.net" and all(found[k].verdict == ("block" if k <= 60 else "allow") for k in found)


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = url_filter.filter_urls(pages, spark.createDataFrame([(1, True)], "page_id long, bad boolean"), RULES)
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_special_tokens_in_texts_are_one_id(spark):
    """The contract's call on whole texts: default handling of special tokens."""
    plain = Tokenizer.from_file(BPE)
    texts = ["x<|endoftext|>y", "<|endoftext|>", "a <|endoftext|> b", "a.<|endoftext|>,b <|endoftext|><|endoftext|> .", "<|endoftext|>..", "<|endoftext| >",
             "\n<|endoftext|>\n  <|endoftext|>  ", "w<|endoftext|>., é<|endoftext|>é.,"]
    got = {r.doc_id: r for r in packing.pack_documents(docs_frame(spark, texts), BPE).collect()}
    for k, t in enumerate(texts):
        ids = [*plain.encode(t, add_special_tokens=False).ids, packing.END_ID]
        assert (got[k].length, got[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# ---------------------------------------------------------------- sharding


def test_propagation_moves_documents_to_their_neighbours(spark):
    """Cut edges fall from round to round, as counted by brute force; quotas
    hold; no document appears or vanishes."""
    rng = random.Random(3)
    rows = [(k, rng.randrange(60), rng.randrange(8)) for k in range(400)]
    state, goal = spark.createDataFrame(rows, "row long, link long, shard int").repartition(4), [56] * 8
    moved, cuts = sharding.propagate(Staged(spark), state, goal)
    moved = [tuple(r) for r in moved.collect()]

    def cut(rows):
        by = defaultdict(list)
        for _, link, shard in rows:
            by[link].append(shard)
        return sum(a != b for g in by.values() for a, b in itertools.combinations(g, 2))

    assert sorted((r, g) for r, g, _ in moved) == sorted((r, g) for r, g, _ in rows)
    assert cuts[0] == cut(rows) and cuts[-1] == cut(moved) and len(cuts) > 2
    assert all(a > b for a, b in zip(cuts, cuts[1:-1])) and cuts[-1] < cuts[0] / 4
    before, after = ([sum(s == k for _, _, s in x) for k in range(8)] for x in (rows, moved))
    assert all(b <= max(a, g) for a, b, g in zip(before, after, goal))


@pytest.mark.parametrize("hot", [0, 70])
def test_sharding_is_even_gapless_and_keeps_groups(spark, hot):
    rng = random.Random(hot)
    texts = [None, None, "", ""] + [f"unique {k}" for k in range(90)] + [f"group {rng.randrange(15)}" for _ in range(60)] + ["hot"] * hot
    docs = docs_frame(spark, texts).withColumn("shard", F.lit(-1)).withColumn("link", F.lit("x"))
    rows = sharding.shard_documents(docs).collect()
    n = len(texts)
    assert sorted(r.doc_id for r in rows) == list(range(n))
    by, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        by[r.shard].append(r.slot)
        if texts[r.doc_id] is not None:
            groups[t].add(r.shard)
    counts = [len(by.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    cut = [t for t, s in groups.items() if len(s) > 1 and t != "hot"]
    assert len(cut) <= 3


@pytest.mark.parametrize("hot, groups, single", [(2666, 500, 3334), (2666, 1333, 2)])
def test_a_hot_group_cuts_no_small_group(spark, hot, groups, single):
    texts = ["hot"] * hot + [f"group {k}" for k in range(groups)] * 4 + [f"unique {k}" for k in range(single)]
    shards, counts = defaultdict(set), defaultdict(int)
    for r in sharding.shard_documents(docs_frame(spark, texts)).collect():
        shards[texts[r.doc_id]].add(r.shard)
        counts[r.shard] += 1
    assert sum(counts.values()) == len(texts) and max(counts.values()) - min(counts.values()) <= 1
    assert not [t for t, s in shards.items() if len(s) > 1 and t != "hot"]


def test_sharding_few_and_no_rows(spark):
    assert sharding.shard_documents(docs_frame(spark, ["x"]).limit(0)).count() == 0
    few = sharding.shard_documents(docs_frame(spark, ["a", "a", None])).collect()
    assert len(few) == 3 and len({(r.shard, r.slot) for r in few}) == 3


def test_sharding_is_native(spark):
    plan = sharding.shard_documents(docs_frame(spark, ["a", "a", "b"]))
    assert "Python" not in plan._jdf.queryExecution().toString()


# -------------------------------------------------------------- neighbours


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        order = sorted((j for j in range(len(ids)) if j != q), key=lambda j: (-s[j], ids[j]))[:k]
        out[ids[q]] = [(ids[j], s[j]) for j in order]
    return out


@pytest.mark.parametrize("tiles", [(4096, 1024), (200, 16)])
def test_neighbours_recall_and_scores(spark, tiles, monkeypatch):
    monkeypatch.setattr(ann, "TILE_VECTORS", tiles[0])
    monkeypatch.setattr(ann, "TILE_QUERIES", tiles[1])
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[5] = x[6]
    ids = list(range(3000))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    found = defaultdict(list)
    for r in ann.search(table.withColumn("score", F.lit(0)), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id]) and abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9
    expected = exact(ids, x, range(0, 3000, 20), 20)
    assert set(found) == set(expected) and all(len(v) == 20 for v in found.values())
    assert all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in v}) for q, v in expected.items())
    assert hits / (20 * len(expected)) >= 0.93


def test_neighbours_odd_vectors(spark):
    good = [(k, [float(k % 7) + 1, float(k % 3), 1.0]) for k in range(12)]
    odd = [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]), (180, [float("nan"), 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0]),
           (220, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (3, [4.0, 0.0, 1.0])]
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    found = ann.search(table, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    x = np.array([v for _, v in good])
    same([(r.query_id, r["rank"], r.vec_id) for r in found], [(0, n + 1, i) for n, (i, _) in enumerate(exact(range(12), x, [0], 20)[0])])
    assert ann.search(table.limit(0), F.lit(True)).count() == 0
