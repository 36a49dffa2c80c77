import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexicarta.functions import text as X
from lexicarta.operators import vocab as V


def _one(spark, col_expr, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(col_expr.alias("x")).first()["x"]


def test_clean_variants_edge_rows(spark):
    row = "  a b \n\tc URL_12 e "
    assert _one(spark, X.clean_text("t"), row) == "a b c e"
    assert _one(spark, X.clean_text_qa("t"), row) == "a b c  e"
    for fn in (X.clean_text, X.clean_text_qa):
        assert _one(spark, fn("t"), "") == ""
        assert _one(spark, fn("t"), None) is None
        assert _one(spark, fn("t"), "URL_1") == ""


def test_exotic_whitespace_is_python_whitespace(spark):
    s = "x\ty z\u001cw　v u  t"
    assert _one(spark, X.clean_text("t"), s) == " ".join(s.split())
    assert _one(spark, X.whitespace_tokens("t"), s) == s.split()


def test_text_or_nan(spark):
    assert _one(spark, X.text_or_nan("t"), None) == "nan"


def test_word_tokens_drop_single_letters_before_ngrams(spark):
    toks = _one(spark, X.word_tokens("t"), "It's a Dog_1 b 42")
    assert toks == ["it", "dog_1", "42"]
    df = spark.createDataFrame([("it's a dog",)], "t string").select(X.word_tokens("t").alias("w"))
    grams = df.select(X.word_ngrams(F.col("w"), 1, 2).alias("g")).first()["g"]
    assert "it dog" in grams


def _py_word_ngrams(tokens, n1, n2):
    out = []
    for n in range(n1, n2 + 1):
        out += [" ".join(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]
    return out


def test_word_ngrams_small_arrays(spark):
    for toks in ([], ["aa"], ["aa", "bb"], ["aa", "bb", "cc"]):
        df = spark.createDataFrame([(toks,)], "w array<string>")
        got = df.select(X.word_ngrams(F.col("w"), 1, 3).alias("g")).first()["g"]
        assert sorted(got) == sorted(_py_word_ngrams(toks, 1, 3))


def _py_char_wb(text, n1, n2):
    out = []
    for w in text.lower().split():
        w = " " + w + " "
        wl = len(w)
        for n in range(n1, n2 + 1):
            off = 0
            out.append(w[off:off + n])
            while off + n < wl:
                off += 1
                out.append(w[off:off + n])
            if off == 0:
                break
    return out


def _py_char(text, n1, n2):
    t = re.sub(r"\s\s+", " ", text.lower())
    out = []
    for n in range(n1, min(n2 + 1, len(t) + 1)):
        out += [t[i:i + n] for i in range(len(t) - n + 1)]
    return out


def test_char_ngrams_match_plain_python(spark):
    rnd = random.Random(7)
    alphabet = "abcÉé \t\n xyz.,"
    texts = ["a", "I am", "", "  ", "x \n\n y"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
                                                   for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for n1, n2 in ((2, 4), (4, 5)):
        got = {r["doc_id"]: r["__terms"] for r in V.analyze(df, "char_wb", (n1, n2)).collect()}
        for i, t in enumerate(texts):
            assert Counter(got[i]) == Counter(_py_char_wb(t, n1, n2)), (t, n1, n2)
    got = {r["doc_id"]: r["__terms"] for r in V.analyze(df, "char", (2, 4)).collect()}
    for i, t in enumerate(texts):
        assert Counter(got[i]) == Counter(_py_char(t, 2, 4)), t


def test_in_row_term_counts_equal_counter(spark):
    rnd = random.Random(3)
    docs = [[rnd.choice("abcde") for _ in range(rnd.randint(0, 30))] for _ in range(30)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, w array<string>")
    out = X.with_term_counts(df, "w", "bag").collect()
    for r in out:
        assert {e["term"]: e["tf"] for e in r["bag"]} == dict(Counter(docs[r["doc_id"]]))
        assert [e["term"] for e in r["bag"]] == sorted(set(docs[r["doc_id"]]))


def test_text_plan_has_no_python_udf(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = V.term_counts(df, "word", (1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
