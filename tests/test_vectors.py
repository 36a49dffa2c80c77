import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicarta.functions import sequences as S
from lexicarta.operators import joins
from lexicarta.operators import vectors as VE

DOCS = [(1, "a b a c zz"), (2, "c"), (3, ""), (4, None), (5, "zz yy"), (6, "b c c d a a"), (None, "a d")]
TABLE = [("a", 5, [1.0, 2.0]), ("b", 2, [0.5, -1.0]), ("c", 4, [0.0, 3.0]), ("d", 2, [7.0, 0.25])]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string").repartition(3)


@pytest.fixture(params=["fits", "some", "none", "uncounted"])
def table(request, spark, monkeypatch):
    """A vector table that fits a broadcast, or of which two rows or none do."""
    v = spark.createDataFrame(TABLE, "token string, n_occ bigint, vec array<float>")
    if request.param == "uncounted":
        v = v.drop("n_occ")
    if request.param != "fits":
        room = (0 if request.param == "none" else 2) * joins.row_bytes(v.select("token", "vec").schema, 2)
        for module in (joins, VE):
            monkeypatch.setattr(module, "MAX_BROADCAST_BYTES", room)
    return v


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_means_whatever_part_of_the_table_is_broadcast(docs, table):
    vec = {t: v for t, _, v in TABLE}
    got = {r.doc_id: r.embedding for r in VE.mean_pool(docs, table, 2).collect()}
    for key, text in DOCS:
        words = (text or "").split()
        mean = [sum(vec.get(w, [0.0, 0.0])[k] for w in words) / max(len(words), 1e-9) for k in range(2)]
        assert got[key] == pytest.approx(mean)
    masked = {r.doc_id: r.embedding for r in VE.mean_pool(docs, table, 2, mask=F.col("token") != "a").collect()}
    assert masked[6] == pytest.approx([7.5 / 4, 5.25 / 4]) and masked[4] == [0.0, 0.0] and len(masked) == len(DOCS)


def test_sequences_whatever_part_of_the_table_is_broadcast(docs, table):
    vec = {t: v for t, _, v in TABLE}
    got = {r.doc_id: r.sequence for r in VE.padded_documents(docs.where("doc_id is not null"), table, 2, 4).collect()}
    for key, text in DOCS[:-1]:
        words = (text or "").split()[:4]
        assert got[key] == [vec.get(w, [0.0, 0.0]) for w in words] + [[0.0, 0.0]] * (4 - len(words))
    long = VE.token_vectors(docs, table, 2, 4)
    assert sorted(VE.padded_sequence(long, 2, 4, docs=docs).collect(), key=str) == sorted(VE.padded_documents(docs, table, 2, 4).collect(), key=str)


def test_sums_keep_no_rows_for_a_sort(spark, docs):
    v = spark.createDataFrame(TABLE, "token string, n_occ bigint, vec array<float>")
    assert "ObjectHashAggregate" not in plan(VE.mean_pool(docs, v, 2))


def test_vectors_are_not_shuffled_into_sequences(spark, docs):
    v = spark.createDataFrame(TABLE, "token string, n_occ bigint, vec array<float>")
    moved = [n for n in plan(VE.padded_documents(docs, v, 2, 4)).split("\n") if "Exchange hashpartitioning" in n]
    assert len(moved) == 2  # first words by document, and ids


def test_sequences_are_neither_sorted_nor_shuffled(docs, table):
    above = plan(VE.padded_documents(docs, table, 2, 4)).split("MapInArrow")[0]
    assert not any(step in above for step in ("Sort", "Exchange", "Join", "Aggregate"))


def test_sequences_of_repeated_keys_and_tokens(spark, table):
    """Rows of a key are one document by position, and so are vectors of a
    repeated token; a null vector counts as zeros."""
    more = [("a", 5, [-1.0, None]), ("b", 2, None), ("", 1, [9.0, 9.0]), (None, 1, [8.0, 8.0])]
    v = table.unionByName(spark.createDataFrame(more, "token string, n_occ bigint, vec array<float>").select(table.columns))
    rows = [(1, "a b zz c"), (1, "c a"), (1, ""), (2, "zz  c"), (2, None), (3, "b"), (None, "a"), (None, "a"), (4, " "), (7, "d"),
            (8, "d c b a"), (8, "d c b a"), *[(5, f"d{k} c a") for k in range(9)], *[(6, "a b c d") for _ in range(9)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)

    def order(entry):
        pos, vec = entry
        return pos, vec is not None, [(x is not None, x or 0.0) for x in vec or []]

    for max_len in (1, 4, 7):
        want = []
        for key, _ in rows:
            words = [x for k, text in rows if k == key and key is not None for x in enumerate((text or "").split()[:max_len])]
            found = [(pos, vec) for pos, w in words for vec in [x for t, _, x in [*TABLE, *more] if t == w] or [None]]
            found = [vec or [0.0, 0.0] for _, vec in sorted(found, key=order)][:max_len]
            want.append((key, found + [[0.0, 0.0]] * (max_len - len(found))))
        assert sorted(map(tuple, VE.padded_documents(docs, v, 2, max_len).collect()), key=str) == sorted(want, key=str)


def test_runs_of_sequences(monkeypatch):
    table = pa.table({"token": ["b", "a"], "vecs": pa.array([[{"v": [1.0, 2.0]}], [{"v": None}, {"v": [3.0, 4.0]}]], pa.list_(pa.struct([("v", pa.list_(pa.float32()))])))})
    batch = pa.RecordBatch.from_pydict({
        "key": [1, 2, 3, 4, 5], "texts": [["b zz a"], None, ["b", "a x"], [], ["x"]],
        "far": pa.array([[(1, [5.0, 5.0])], None, None, None, [(0, [6.0, 6.0]), (0, [7.0, 7.0])]], pa.list_(pa.struct([("slot", pa.int32()), ("v", pa.list_(pa.float32()))])))})
    z = [0.0, 0.0]
    want = [{"key": 1, "__pos": None, "__v": [[1.0, 2.0], [5.0, 5.0], z, [3.0, 4.0]]}, {"key": 2, "__pos": None, "__v": [z] * 4},
            {"key": 3, "__pos": [0, 0, 0, 1], "__v": [[1.0, 2.0], None, [3.0, 4.0], None]}, {"key": 4, "__pos": None, "__v": [z] * 4},
            {"key": 5, "__pos": None, "__v": [[6.0, 6.0], [7.0, 7.0], z, z]}]
    for texts, size, runs in ((10_000, 8 << 20, 1), (10_000, 1, 5), (1, 1, 5)):
        monkeypatch.setattr(S, "RUN_TEXTS", texts)
        monkeypatch.setattr(S, "RUN_BYTES", size)
        got = list(S.sequences(batch, S.Vectors(S.packed_table(table, 2)), 2, 4))
        assert [r for b in got for r in b.to_pylist()] == want
        assert len(got) == runs
    assert not list(S.sequences(batch.slice(0, 0), S.Vectors(S.packed_table(table, 2)), 2, 4))
