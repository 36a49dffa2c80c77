"""DuckDB oracle SQL for the registered queries (same column names).

The text rules use the same explicit whitespace class as the Spark side
(RE2 reads it like Java regex).  Integer sums are cast to BIGINT and
floating results rounded to 6 places, as in the Spark queries.
"""

from __future__ import annotations

from ..functions.text import URL_TOKEN, WORD_TOKEN, WS_CLASS

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


WS = WS_CLASS + "+"
WS2 = WS_CLASS + "{2,}"


def p1(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace({e}, '{URL_TOKEN}', '', 'g'), '{WS}', ' ', 'g'))"


def p2(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace({e}, '{WS}', ' ', 'g'), '{URL_TOKEN}', '', 'g'))"


def ilen(e: str) -> str:
    return f"CAST(length({e}) AS INTEGER)"


DOCS_URL = "SELECT doc_id, source, text || ' URL_' || CAST(doc_id AS VARCHAR) || ' end' AS text FROM documents"

LABELLED = ("SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS label, d.source "
            "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")

LABELLED_PREPARED = f"""
SELECT doc_id, text, label, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM (
    SELECT doc_id, {p1('text')} AS text, label, source FROM ({LABELLED})
  ) WHERE length(text) >= 50
) WHERE rn = 1"""

QA_FLAT = """
SELECT a.item_id, a.label, a.part,
       CAST(row_number() OVER (PARTITION BY a.item_id, a.part, a.label ORDER BY a.turn) - 1 AS INTEGER) AS idx,
       'conv' || CAST(a.item_id % 5 AS VARCHAR) AS source, q.question, a.text
FROM (SELECT conv_id AS item_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS label,
             CAST(floor(turn / 256) AS INTEGER) AS part, turn, text
      FROM conversations WHERE role IN ('user', 'assistant')) a
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS question FROM conversations
           WHERE role = 'user' GROUP BY conv_id) q ON a.item_id = q.conv_id"""

QA_CLEAN = f"SELECT item_id, label, part, idx, source, question, {p2('text')} AS text FROM ({QA_FLAT})"

QA_PREPARED = f"""
SELECT item_id, label, part, idx, source, question, text FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY item_id, label, part, idx) AS rn
  FROM ({QA_CLEAN}) WHERE length(text) >= 20
) WHERE rn = 1"""

MC_RAW = """
SELECT conv_id AS doc_id, turn AS pos, text AS Generation,
       CASE WHEN role = 'user' THEN 'human' ELSE role END AS label,
       CASE WHEN conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM conversations"""

MC_BIN = f"""
SELECT doc_id, pos, label AS source,
       CAST(CASE WHEN label IS NOT DISTINCT FROM 'human' THEN 0 ELSE 1 END AS INTEGER) AS label,
       coalesce(CAST(Generation AS VARCHAR), 'nan') AS text, split
FROM ({MC_RAW})"""

MC_PREPARED = f"""
SELECT doc_id, pos, text, source, label, split FROM (
  SELECT *, row_number() OVER (PARTITION BY split, text ORDER BY doc_id, pos) AS rn FROM (
    SELECT doc_id, pos, {p1('text')} AS text, source, label, split FROM ({MC_BIN})
  ) WHERE length(text) >= 50
) WHERE rn = 1"""


oracle("clean_text", f"SELECT doc_id, {p1('text')} AS text, {ilen(p1('text'))} AS n_chars FROM ({DOCS_URL})")
oracle("clean_text_qa", f"SELECT doc_id, {p2('text')} AS text, {ilen(p2('text'))} AS n_chars FROM ({DOCS_URL})")
oracle("binarise_label", f"SELECT doc_id, pos, source, label FROM ({MC_BIN})")
oracle("flatten_qa", QA_FLAT)
oracle("min_length_filter", f"""
SELECT doc_id, {ilen('t')} AS n_chars FROM (SELECT doc_id, {p1('text')} AS t FROM documents)
WHERE length(t) >= 50""")
oracle("domain_filter", "SELECT doc_id, source, lang FROM documents WHERE source = 'src3'")
oracle("dedupe_first", f"""
SELECT doc_id, source, {ilen('t')} AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, source, {p1('text')} AS t FROM documents)
) WHERE rn = 1""")
oracle("dedupe_labelled", f"SELECT doc_id, label, source, {ilen('text')} AS n_chars FROM ({LABELLED_PREPARED})")
oracle("dedupe_per_split", f"SELECT doc_id, pos, split, label, source, {ilen('text')} AS n_chars FROM ({MC_PREPARED})")
oracle("split_leakage", f"""
SELECT sha256(text) AS text_key, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'test') AS n_test, {ilen('text')} AS n_chars
FROM (SELECT {p1('text')} AS text, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)
GROUP BY text
HAVING count(*) FILTER (WHERE split = 'train') > 0 AND count(*) FILTER (WHERE split = 'test') > 0""")

oracle("label_distribution", f"SELECT label, count(*) AS n FROM ({LABELLED_PREPARED}) WHERE label IS NOT NULL GROUP BY label")
oracle("length_stats", f"""
SELECT source, count(*) AS n_rows, round(avg(length(text)), 6) AS avg_chars
FROM ({LABELLED_PREPARED}) GROUP BY source""")

_NULL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
oracle("null_counts", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null "
    f"FROM (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
    for c in _NULL_COLS) + ") WHERE n_null > 0")
oracle("domain_label_crosstab", f"""
SELECT source, count(*) FILTER (WHERE label = 0) AS n_human, count(*) FILTER (WHERE label = 1) AS n_ai
FROM ({LABELLED_PREPARED}) WHERE source IS NOT NULL AND label IS NOT NULL GROUP BY source""")
oracle("row_funnel", f"""
SELECT 0 AS step, 'raw' AS stage, count(DISTINCT conv_id) AS n_rows FROM conversations WHERE role IN ('user', 'assistant')
UNION ALL SELECT 1, 'flattened', count(*) FROM ({QA_FLAT})
UNION ALL SELECT 2, 'after_length', count(*) FROM ({QA_CLEAN}) WHERE length(text) >= 20
UNION ALL SELECT 3, 'after_dedupe', count(*) FROM ({QA_PREPARED})""")
oracle("head_sample", "SELECT doc_id, substr(text, 1, 200) AS text_head FROM documents ORDER BY doc_id LIMIT 3")


# ---------------------------------------------------------------- splits

def split_sql(src: str, stratum: str, n_train_sql: str, labels=("train", "test"), key="doc_id",
              seed=42) -> str:
    """Window form of the exact stratified split over ``src``; adds ``split``.
    ``n_train_sql`` is an expression of the total ``n``."""
    tr, te = labels
    return f"""
WITH base AS (SELECT *, {stratum} AS stratum__, md5('{seed}|' || CAST({key} AS VARCHAR)) AS h__ FROM ({src})),
cnt AS (SELECT stratum__, count(*) AS c FROM base GROUP BY stratum__),
tot AS (SELECT sum(c) AS n FROM cnt),
tr AS (SELECT CAST({n_train_sql} AS BIGINT) AS n_train, n FROM tot),
alloc AS (SELECT stratum__, c, (c * n_train) // n AS base_i, (c * n_train) % n AS rem, n_train FROM cnt, tr),
rk AS (SELECT *, row_number() OVER (ORDER BY rem DESC, stratum__ ASC NULLS FIRST) AS rk,
              n_train - sum(base_i) OVER () AS leftover FROM alloc),
fin AS (SELECT stratum__, base_i + CASE WHEN rk <= leftover THEN 1 ELSE 0 END AS train_i FROM rk)
SELECT b.* EXCLUDE (stratum__, h__),
       CASE WHEN row_number() OVER (PARTITION BY b.stratum__ ORDER BY b.h__, b.{key}) <= f.train_i
            THEN '{tr}' ELSE '{te}' END AS split
FROM base b LEFT JOIN fin f ON b.stratum__ IS NOT DISTINCT FROM f.stratum__"""


def ceil_test(frac: float) -> str:
    return f"n - CAST(ceil(CAST({frac} AS DOUBLE) * CAST(n AS DOUBLE)) AS BIGINT)"


LABELLED_SPLIT = split_sql(f"SELECT doc_id, label, source FROM ({LABELLED_PREPARED})",
                           "CAST(label AS VARCHAR) || '_' || source", ceil_test(0.2))

oracle("stratified_split", f"SELECT doc_id, label, source, split FROM ({LABELLED_SPLIT})")
oracle("stratified_subsample", "SELECT doc_id, label, source FROM (" + split_sql(
    f"SELECT doc_id, label, source FROM ({LABELLED_PREPARED})", "CAST(label AS VARCHAR)", "least(100, n)")
    + ") WHERE split = 'train'")
oracle("validation_split", "SELECT doc_id, label, split FROM (" + split_sql(
    f"SELECT doc_id, label, source FROM ({LABELLED_SPLIT}) WHERE split = 'train'",
    "CAST(label AS VARCHAR)", ceil_test(0.1), labels=("train", "val")) + ")")
oracle("random_split", "SELECT doc_id, split FROM (" + split_sql(
    "SELECT doc_id, source FROM documents", "'all'",
    "n - least(greatest(CAST(floor(CAST(0.2 AS DOUBLE) * CAST(n AS DOUBLE)) AS BIGINT), 1), n)",
    labels=("train", "val")) + ")")
oracle("shuffled_rank", """
SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS shuffle_rank
FROM documents""")


# ---------------------------------------------------------------- tokens, n-grams, vocabulary

def ws_tokens(src: str, key: str = "doc_id", text: str = "text", lower: bool = False) -> str:
    """(key, pos, token): whitespace tokens, 0-based position."""
    t = f"lower({text})" if lower else text
    return f"""SELECT {key}, CAST(pos AS INTEGER) AS pos, token FROM (
  SELECT {key}, unnest(l) AS token, unnest(range(0, len(l))) AS pos FROM (
    SELECT {key}, list_filter(string_split_regex({t}, '{WS}'), lambda x: x <> '') AS l FROM ({src})))"""


def word_tokens(src: str, key: str = "doc_id", text: str = "text") -> str:
    return f"""SELECT {key}, CAST(pos AS INTEGER) AS pos, token FROM (
  SELECT {key}, unnest(l) AS token, unnest(range(0, len(l))) AS pos FROM (
    SELECT {key}, regexp_extract_all(lower({text}), '{WORD_TOKEN}') AS l FROM ({src})))"""


def word_ngram_terms(src: str, n1: int, n2: int, key: str = "doc_id") -> str:
    """(key, term) for word n-grams n1..n2 over the word tokens."""
    leads = []
    for n in range(1, n2 + 1):
        parts = ["token"] + [f"lead(token, {k}) OVER w" for k in range(1, n)]
        leads.append(" || ' ' || ".join(parts) + f" AS g{n}")
    grams = f"SELECT {key}, {', '.join(leads)} FROM ({word_tokens(src, key)}) WINDOW w AS (PARTITION BY {key} ORDER BY pos)"
    union = " UNION ALL ".join(f"SELECT {key}, g{n} AS term FROM g WHERE g{n} IS NOT NULL" for n in range(n1, n2 + 1))
    return f"WITH g AS ({grams}) {union}"


def char_wb_terms(src: str, n1: int, n2: int, key: str = "doc_id") -> str:
    ns = ", ".join(f"({n})" for n in range(n1, n2 + 1))
    return f"""WITH w AS (SELECT {key}, ' ' || token || ' ' AS p FROM ({ws_tokens(src, key, lower=True)}))
SELECT {key}, substr(p, i, n) AS term FROM (
  SELECT {key}, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM w, (VALUES {ns}) ns(n) WHERE length(p) >= n)
UNION ALL SELECT {key}, p AS term FROM w WHERE length(p) < {n1}"""


def char_terms(src: str, n1: int, n2: int, key: str = "doc_id", text: str = "text") -> str:
    ns = ", ".join(f"({n})" for n in range(n1, n2 + 1))
    return f"""WITH t AS (SELECT {key}, regexp_replace(lower({text}), '{WS2}', ' ', 'g') AS p FROM ({src}))
SELECT {key}, substr(p, i, n) AS term FROM (
  SELECT {key}, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM t, (VALUES {ns}) ns(n) WHERE length(p) >= n)"""


def counts_of(terms_sql: str, key: str = "doc_id") -> str:
    return f"SELECT {key}, term, CAST(count(*) AS INTEGER) AS tf FROM ({terms_sql}) GROUP BY {key}, term"


def vocab_sql(fit_src: str, terms_fn, min_df=2, max_df=0.95, max_features=50_000) -> str:
    """(term, term_idx, tf, df, idf) fitted on ``fit_src`` (doc_id, text)."""
    maxd = f"CAST({max_df} AS DOUBLE) * n" if isinstance(max_df, float) else str(max_df)
    lim = f"ORDER BY tf DESC, term LIMIT {max_features}" if max_features else ""
    return f"""WITH nd AS (SELECT count(*) AS n FROM ({fit_src})),
st AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM ({counts_of(terms_fn(fit_src))}) GROUP BY term),
kept AS (SELECT st.* FROM st, nd WHERE df >= {min_df} AND df <= {maxd} {lim})
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_idx, tf, df,
       ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM kept, nd"""


LABELLED_SPLIT_TEXT = split_sql(f"SELECT doc_id, text, label, source FROM ({LABELLED_PREPARED})",
                                "CAST(label AS VARCHAR) || '_' || source", ceil_test(0.2))
TRAIN_DOCS = f"SELECT doc_id, text, label, source FROM ({LABELLED_SPLIT_TEXT}) WHERE split = 'train'"
TEST_DOCS = f"SELECT doc_id, text, label, source FROM ({LABELLED_SPLIT_TEXT}) WHERE split = 'test'"
LABELLED_DOCS = f"SELECT doc_id, text, label, source FROM ({LABELLED_PREPARED})"


def w12(src):
    return word_ngram_terms(src, 1, 2)


def w13(src):
    return word_ngram_terms(src, 1, 3)


def cwb24(src):
    return char_wb_terms(src, 2, 4)


TFIDF_VOCAB = vocab_sql(TRAIN_DOCS, w12)


def tfidf_sql(target: str) -> str:
    return f"""WITH voc AS ({TFIDF_VOCAB}),
w AS (SELECT a.doc_id, v.term_idx, (1.0 + ln(a.tf)) * v.idf AS w
      FROM ({counts_of(w12(target))}) a JOIN voc v ON a.term = v.term),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS nr FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term_idx, round(w.w / nr.nr, 6) AS value FROM w JOIN nr ON w.doc_id = nr.doc_id"""


def count_features_sql(terms_fn, target: str) -> str:
    return f"""WITH voc AS ({vocab_sql(TRAIN_DOCS, terms_fn)})
SELECT a.doc_id, v.term_idx, CAST(a.tf AS DOUBLE) AS value
FROM ({counts_of(terms_fn(target))}) a JOIN voc v ON a.term = v.term"""


oracle("whitespace_tokens", ws_tokens("SELECT doc_id, text FROM documents"))
oracle("word_tokens", word_tokens("SELECT doc_id, text FROM documents"))
ALL_DOCS = "SELECT doc_id, text FROM documents"
oracle("word_ngrams", counts_of(w13(ALL_DOCS)))
oracle("char_wb_ngrams", counts_of(cwb24(ALL_DOCS)))
oracle("char_ngrams", counts_of(char_terms(ALL_DOCS, 2, 4)))
oracle("term_counts", counts_of(w12("SELECT doc_id, text FROM documents")))
oracle("vocabulary", f"SELECT term, term_idx, tf, df FROM ({TFIDF_VOCAB})")
oracle("vocabulary_top_k", "SELECT term, term_idx, tf, df FROM ("
       + vocab_sql("SELECT doc_id, text FROM documents", w12, 2, 0.95, 5000) + ")")
oracle("idf", f"SELECT term_idx, round(idf, 6) AS idf FROM ({TFIDF_VOCAB})")
oracle("tfidf", tfidf_sql(TRAIN_DOCS))
oracle("apply_vocabulary", tfidf_sql(TEST_DOCS))
oracle("ngram_count_features", count_features_sql(w13, TEST_DOCS))
oracle("charwb_count_features", count_features_sql(cwb24, TEST_DOCS))


# ---------------------------------------------------------------- metrics

PRED_SET = """SELECT d.doc_id, d.source, CAST(l.quality AS INTEGER) AS label,
       CAST(d.n_chars % 2 AS INTEGER) AS prediction, CAST(d.doc_id % 101 AS DOUBLE) / 100.0 AS probability
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def metrics_sql(src: str, g: str) -> str:
    """(g, n, accuracy, f1_weighted, f1_macro, precision_weighted,
    recall_weighted) per value of expression ``g`` over ``src``."""
    return f"""WITH conf AS (SELECT {g} AS g, label, prediction, count(*) AS n FROM ({src}) GROUP BY ALL),
t AS (SELECT g, label AS cls, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp
      FROM conf GROUP BY g, label),
p AS (SELECT g, prediction AS cls, sum(n) AS pred_n FROM conf GROUP BY g, prediction),
pc AS (SELECT coalesce(t.g, p.g) AS g, CAST(coalesce(support, 0) AS DOUBLE) AS support,
              CAST(coalesce(tp, 0) AS DOUBLE) AS tp, CAST(coalesce(pred_n, 0) AS DOUBLE) AS pred_n
       FROM t FULL OUTER JOIN p ON t.g IS NOT DISTINCT FROM p.g AND t.cls = p.cls),
pm AS (SELECT g, support, tp,
              CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS pr,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc,
              CASE WHEN pred_n + support > 0 THEN 2.0 * tp / (pred_n + support) ELSE 0.0 END AS f1 FROM pc)
SELECT g, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(support * f1) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro,
       round(sum(support * pr) / sum(support), 6) AS precision_weighted,
       round(sum(support * rc) / sum(support), 6) AS recall_weighted
FROM pm GROUP BY g"""


def auc_sql(src: str, g: str, score: str = "probability") -> str:
    return f"""WITH sc AS (SELECT {g} AS g, {score} AS score, count(*) FILTER (WHERE label = 1) AS pos,
                          count(*) FILTER (WHERE label <> 1) AS neg FROM ({src}) GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY g ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc)
SELECT g, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                     THEN sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) END, 6) AS roc_auc
FROM cum GROUP BY g"""


oracle("confusion_matrix", f"""WITH ps AS ({PRED_SET}),
cls AS (SELECT label AS c FROM ps UNION SELECT prediction FROM ps),
conf AS (SELECT label, prediction, count(*) AS n FROM ps GROUP BY ALL)
SELECT a.c AS label, b.c AS prediction, CAST(coalesce(conf.n, 0) AS BIGINT) AS n
FROM cls a, cls b LEFT JOIN conf ON conf.label = a.c AND conf.prediction = b.c""")
oracle("classification_metrics", f"""SELECT m.* EXCLUDE (g), a.roc_auc
FROM ({metrics_sql(PRED_SET, "1")}) m JOIN ({auc_sql(PRED_SET, "1")}) a ON m.g = a.g""")
oracle("roc_auc", f"SELECT g AS source, roc_auc FROM ({auc_sql(PRED_SET, 'source')})")
_DOM = f"""SELECT 'domain' AS scope, m.g AS domain, m.* EXCLUDE (g), a.roc_auc
FROM ({metrics_sql(PRED_SET, "source")}) m JOIN ({auc_sql(PRED_SET, "source")}) a ON m.g = a.g
WHERE m.g IS NOT NULL"""
oracle("domain_metrics", _DOM)
oracle("metrics_report", _DOM + f"""
UNION ALL SELECT 'overall', CAST(NULL AS VARCHAR), m.* EXCLUDE (g), a.roc_auc
FROM ({metrics_sql(PRED_SET, "1")}) m JOIN ({auc_sql(PRED_SET, "1")}) a ON m.g = a.g""")
oracle("results_table", f"""SELECT 'parity_rule' AS model, m.* EXCLUDE (g), a.roc_auc
FROM ({metrics_sql(PRED_SET, "1")}) m JOIN ({auc_sql(PRED_SET, "1")}) a ON m.g = a.g
UNION ALL SELECT 'threshold_rule', m.* EXCLUDE (g), CAST(NULL AS DOUBLE)
FROM ({metrics_sql('SELECT label, CAST(probability >= 0.5 AS INTEGER) AS prediction FROM (' + PRED_SET + ')', "1")}) m""")


# ---------------------------------------------------------------- linear models

def linear_sql(x_src: str, y_src: str, kind: str, epochs: int, lr: float, d_src: str, C: float = 1.0):
    """Chained CTEs of full-batch gradient descent.  ``x_src``: (doc_id, j,
    x); ``y_src``: (doc_id, y DOUBLE) with every training row; ``d_src``:
    (j) for every feature index.  Returns (ctes, final weights name,
    final bias name, list of per-epoch history CTE names)."""
    ctes = [f"x AS ({x_src})", f"y AS ({y_src})", "nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM y)",
            f"w0 AS (SELECT j, CAST(0.0 AS DOUBLE) AS w FROM ({d_src}))",
            "b0 AS (SELECT CAST(0.0 AS DOUBLE) AS b)"]
    hist = []
    for e in range(epochs):
        ctes.append(f"""z{e} AS (SELECT y.doc_id, y.y, b{e}.b + coalesce(s.s, 0.0) AS z FROM y CROSS JOIN b{e}
  LEFT JOIN (SELECT x.doc_id, sum(x.x * w{e}.w) AS s FROM x JOIN w{e} ON x.j = w{e}.j GROUP BY x.doc_id) s
  ON y.doc_id = s.doc_id)""")
        if kind == "lr":
            ctes.append(f"""r{e} AS (SELECT doc_id, y, z, 1.0 / (1.0 + exp(-z)) - y AS r,
  1.0 / (1.0 + exp(-z)) AS p FROM z{e})""")
            ctes.append(f"""h{e} AS (SELECT {e} AS epoch,
  avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS loss,
  avg(CASE WHEN CAST(p >= 0.5 AS DOUBLE) = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM r{e})""")
            upd_w = f"w.w - {lr} * (coalesce(g.g, 0.0) / nn.n)"
            upd_b = f"b{e}.b - {lr} * ((SELECT sum(r) FROM r{e}) / nn.n)"
        else:
            ctes.append(f"""r{e} AS (SELECT doc_id, y, z, CASE WHEN y = 0 THEN -1.0 ELSE 1.0 END AS ys,
  (CASE WHEN y = 0 THEN -1.0 ELSE 1.0 END) * (CASE WHEN (CASE WHEN y = 0 THEN -1.0 ELSE 1.0 END) * z < 1
     THEN 1.0 ELSE 0.0 END) AS r FROM z{e})""")
            ctes.append(f"""h{e} AS (SELECT {e} AS epoch, avg(greatest(0.0, 1.0 - ys * z)) AS loss,
  avg(CASE WHEN (CASE WHEN z < 0 THEN 0.0 ELSE 1.0 END) = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM r{e})""")
            upd_w = f"w.w - {lr} * (-({C} / nn.n) * coalesce(g.g, 0.0) + w.w)"
            upd_b = f"b{e}.b - {lr} * (-({C} / nn.n) * (SELECT sum(r) FROM r{e}))"
        ctes.append(f"""w{e + 1} AS (SELECT w.j, {upd_w} AS w FROM w{e} w CROSS JOIN nn
  LEFT JOIN (SELECT x.j, sum(x.x * r{e}.r) AS g FROM x JOIN r{e} ON x.doc_id = r{e}.doc_id GROUP BY x.j) g
  ON w.j = g.j)""")
        ctes.append(f"b{e + 1} AS (SELECT {upd_b} AS b FROM b{e} CROSS JOIN nn)")
        hist.append(f"h{e}")
    return ctes, f"w{epochs}", f"b{epochs}", hist


DENSE_X = """SELECT vec_id AS doc_id, j, CAST(x AS DOUBLE) AS x FROM (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS j FROM embeddings)"""
DENSE_Y = "SELECT vec_id AS doc_id, CAST(label % 2 AS DOUBLE) AS y FROM embeddings"
DENSE_D = f"SELECT DISTINCT j FROM ({DENSE_X})"


def _lin(kind: str, what: str) -> str:
    ctes, w, b, hist = linear_sql(DENSE_X, DENSE_Y, kind, 10, 0.01, DENSE_D)
    head = "WITH " + ",\n".join(ctes) + "\n"
    if what == "fit":
        return head + f"""SELECT CAST(-1 AS INTEGER) AS idx, round(b, 6) AS weight FROM {b}
UNION ALL SELECT CAST(j AS INTEGER), round(w, 6) FROM {w}"""
    if what == "history":
        return head + " UNION ALL ".join(
            f"SELECT CAST(epoch AS INTEGER) AS epoch, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM {h}"
            for h in hist)
    zf = f"""SELECT y.doc_id, {b}.b + coalesce(s.s, 0.0) AS z FROM y CROSS JOIN {b}
  LEFT JOIN (SELECT x.doc_id, sum(x.x * {w}.w) AS s FROM x JOIN {w} ON x.j = {w}.j GROUP BY x.doc_id) s
  ON y.doc_id = s.doc_id"""
    if kind == "lr":
        return head + f"""SELECT doc_id, round(1.0 / (1.0 + exp(-z)), 6) AS probability,
  CAST(1.0 / (1.0 + exp(-z)) >= 0.5 AS INTEGER) AS prediction FROM ({zf})"""
    return head + f"""SELECT doc_id, round(z, 6) AS raw, CASE WHEN z < 0 THEN 0 ELSE 1 END AS prediction FROM ({zf})"""


for _k in ("lr", "svm"):
    oracle(f"{_k}_fit", _lin(_k, "fit"))
    oracle(f"{_k}_history", _lin(_k, "history"))
    oracle(f"{_k}_predict", _lin(_k, "predict"))


def _tfidf_long(target: str) -> str:
    return f"""WITH voc AS ({TFIDF_VOCAB}),
w AS (SELECT a.doc_id, v.term_idx, (1.0 + ln(a.tf)) * v.idf AS w
      FROM ({counts_of(w12(target))}) a JOIN voc v ON a.term = v.term),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS nr FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term_idx AS j, w.w / nr.nr AS x FROM w JOIN nr ON w.doc_id = nr.doc_id"""


def _lr_tfidf() -> str:
    ctes, w, b, _ = linear_sql(_tfidf_long(TRAIN_DOCS), f"SELECT doc_id, CAST(label AS DOUBLE) AS y FROM ({TRAIN_DOCS})",
                               "lr", 10, 0.01, f"SELECT term_idx AS j FROM ({TFIDF_VOCAB})")
    ctes.append(f"xt AS ({_tfidf_long(TEST_DOCS)})")
    ctes.append(f"yt AS (SELECT doc_id, label FROM ({TEST_DOCS}))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, label, round(1.0 / (1.0 + exp(-z)), 6) AS probability,
       CAST(1.0 / (1.0 + exp(-z)) >= 0.5 AS INTEGER) AS prediction
FROM (SELECT yt.doc_id, yt.label, {b}.b + coalesce(s.s, 0.0) AS z FROM yt CROSS JOIN {b}
      LEFT JOIN (SELECT xt.doc_id, sum(xt.x * {w}.w) AS s FROM xt JOIN {w} ON xt.j = {w}.j GROUP BY xt.doc_id) s
      ON yt.doc_id = s.doc_id)"""


oracle("lr_tfidf_predict", _lr_tfidf())


# ---------------------------------------------------------------- token vectors and scoring

DOC_TOKENS = ws_tokens("SELECT doc_id, text FROM documents")
VEC_TABLE = f"""WITH c AS (SELECT token, count(*) AS n_occ FROM ({DOC_TOKENS}) GROUP BY token),
top AS (SELECT token, n_occ, row_number() OVER (ORDER BY n_occ DESC, token) - 1 AS rank FROM c
        QUALIFY rank < (SELECT count(*) FROM embeddings))
SELECT top.token, CAST(top.rank AS BIGINT) AS rank, top.n_occ, e.embedding AS vec
FROM top JOIN embeddings e ON e.vec_id = top.rank"""
TV = f"""SELECT t.doc_id, t.pos, t.token, CAST(v.token IS NOT NULL AS INTEGER) AS in_vocab, v.vec
FROM ({DOC_TOKENS}) t LEFT JOIN ({VEC_TABLE}) v ON t.token = v.token WHERE t.pos < 100"""
VSUM = "coalesce(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))), 0.0)"

oracle("vector_table", f"SELECT token, rank, n_occ FROM ({VEC_TABLE})")
oracle("token_vectors", f"SELECT doc_id, pos, token, in_vocab, round({VSUM}, 6) AS vec_sum FROM ({TV})")
oracle("padded_sequence", f"""SELECT d.doc_id, 100 AS seq_len, round(coalesce(s.total, 0.0), 6) AS total
FROM documents d LEFT JOIN (SELECT doc_id, sum({VSUM}) AS total FROM ({TV}) GROUP BY doc_id) s ON d.doc_id = s.doc_id""")


def pooled_sql(keep: str) -> str:
    """Mean over all tokens of a document that satisfy ``keep``, long form."""
    return f"""WITH tv AS (SELECT t.doc_id, t.token, v.vec FROM ({DOC_TOKENS}) t LEFT JOIN ({VEC_TABLE}) v ON t.token = v.token WHERE {keep}),
n AS (SELECT doc_id, count(*) AS n FROM tv GROUP BY doc_id),
s AS (SELECT doc_id, dim, sum(CAST(x AS DOUBLE)) AS s FROM (
        SELECT doc_id, unnest(vec) AS x, unnest(range(0, 64)) AS dim FROM tv WHERE vec IS NOT NULL) GROUP BY doc_id, dim)
SELECT d.doc_id, CAST(g.dim AS INTEGER) AS dim, coalesce(s.s, 0.0) / greatest(coalesce(n.n, 0), 1e-9) AS value
FROM documents d CROSS JOIN range(0, 64) g(dim) LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id AND s.dim = g.dim"""


oracle("mean_pool", f"SELECT doc_id, dim, round(value, 6) AS value FROM ({pooled_sql('true')})")
oracle("mean_pool_masked", f"SELECT doc_id, dim, round(value, 6) AS value FROM ({pooled_sql('length(t.token) > 1')})")
oracle("softmax_argmax", """WITH l AS (
  SELECT vec_id, list_transform(CASE WHEN vec_id % 2 = 1 THEN list_concat(embedding, embedding) ELSE embedding END, lambda x: CAST(x AS DOUBLE)) AS l
  FROM embeddings),
e AS (SELECT vec_id, l, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l)
SELECT vec_id, CAST(len(e) AS INTEGER) AS n_classes, round(e[1] / list_sum(e), 6) AS p_first, round(e[-1] / list_sum(e), 6) AS p_last,
       round(1.0 / list_sum(e), 6) AS p_max, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS prediction FROM e""")


def _network(epochs: int, lr: float) -> str:
    """Chained CTEs of full-batch back-propagation (one tanh layer of four
    units, softmax over two classes) over the pooled vectors."""
    ctes = [f"p AS MATERIALIZED ({pooled_sql('true')})", "t AS (SELECT p.*, l.quality AS y FROM p JOIN labels l USING (doc_id))",
            "nn AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM t)",
            "u0 AS (SELECT dim, j, ((3 * dim + 5 * j) % 7 - 3) / 2.0 AS w FROM range(0, 64) a(dim), range(0, 4) b(j))",
            "v0 AS (SELECT j, k, CAST((j + 2 * k) % 5 - 2 AS DOUBLE) AS w FROM range(0, 4) a(j), range(0, 2) b(k))"]
    for e in range(epochs):
        ctes += [
            f"h{e} AS MATERIALIZED (SELECT doc_id, y, j, tanh(sum(value * w)) AS h FROM t JOIN u{e} USING (dim) GROUP BY doc_id, y, j)",
            f"z{e} AS (SELECT doc_id, y, k, sum(h * w) AS z FROM h{e} JOIN v{e} USING (j) GROUP BY doc_id, y, k)",
            f"""q{e} AS MATERIALIZED (SELECT doc_id, k, (exp(z - max(z) OVER d) / sum(exp(z - m)) OVER d - CAST(y = k AS INTEGER)) / n AS q
  FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS m FROM z{e}), nn WINDOW d AS (PARTITION BY doc_id))""",
            f"""g{e} AS MATERIALIZED (SELECT doc_id, j, (1 - h * h) * sum(q * w) AS g FROM h{e} JOIN q{e} USING (doc_id) JOIN v{e} USING (j, k)
  GROUP BY doc_id, j, h)""",
            f"u{e + 1} AS MATERIALIZED (SELECT dim, j, w - {lr} * sum(value * g) AS w FROM u{e} JOIN t USING (dim) JOIN g{e} USING (doc_id, j) GROUP BY dim, j, w)",
            f"v{e + 1} AS MATERIALIZED (SELECT j, k, w - {lr} * sum(h * q) AS w FROM v{e} JOIN h{e} USING (j) JOIN q{e} USING (doc_id, k) GROUP BY j, k, w)"]
    return "WITH " + ",\n".join(ctes) + f""",
h AS (SELECT doc_id, j, tanh(sum(value * w)) AS h FROM p JOIN u{epochs} USING (dim) GROUP BY doc_id, j),
o AS (SELECT doc_id, k, sum(h * w) AS z FROM h JOIN v{epochs} USING (j) GROUP BY doc_id, k)
SELECT doc_id, round(1.0 / (1.0 + exp(sum(CASE k WHEN 0 THEN z ELSE -z END))), 6) AS p1 FROM o GROUP BY doc_id"""


oracle("mlp_baseline", _network(3, 0.5))
oracle("batch_score", """SELECT vec_id, round(exp(l1 - m) / (exp(l0 - m) + exp(l1 - m)), 6) AS p1,
       CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS prediction
FROM (SELECT vec_id, l0, l1, greatest(l0, l1) AS m FROM (
  SELECT vec_id, list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))) AS l0,
         list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))) AS l1 FROM embeddings))""")


# ---------------------------------------------------------------- diagnostics

def _edge(k: str) -> str:
    return f"(CASE WHEN {k} >= 20 THEN hi ELSE CAST({k} AS DOUBLE) * step + lo END)"


oracle("probability_histogram", f"""WITH ps AS ({PRED_SET}),
st0 AS (SELECT label, CAST(min(probability) AS DOUBLE) AS lo0, CAST(max(probability) AS DOUBLE) AS hi0 FROM ps GROUP BY label),
st AS (SELECT label, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
              CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM st0),
st2 AS (SELECT *, (hi - lo) / CAST(20 AS DOUBLE) AS step FROM st),
a AS (SELECT ps.label, CAST(ps.probability AS DOUBLE) AS p, lo, hi, step,
             least(CAST(floor((CAST(ps.probability AS DOUBLE) - lo) * (CAST(20 AS DOUBLE) / (hi - lo))) AS INTEGER), 19) AS i
      FROM ps JOIN st2 ON ps.label = st2.label WHERE ps.probability IS NOT NULL),
b AS (SELECT label, p, lo, hi, step, CASE WHEN p < {_edge('i')} THEN i - 1 ELSE i END AS i FROM a),
c AS (SELECT label, CASE WHEN i <> 19 AND p >= {_edge('i + 1')} THEN i + 1 ELSE i END AS i FROM b),
cnt AS (SELECT label, i AS bin, count(*) AS n FROM c GROUP BY ALL),
grid AS (SELECT label, lo, hi, step, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM st2)
SELECT grid.label, grid.bin, round({_edge('grid.bin')}, 6) AS bin_lo, round({_edge('grid.bin + 1')}, 6) AS bin_hi,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM grid LEFT JOIN cnt ON grid.label = cnt.label AND grid.bin = cnt.bin""")

oracle("box_stats", f"""WITH ps AS (SELECT label, CAST(probability AS DOUBLE) AS v FROM ({PRED_SET}) WHERE probability IS NOT NULL),
q AS (SELECT label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM ps GROUP BY label),
w AS (SELECT q.label, q1, median, q3, q3 - q1 AS iqr,
             min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS wl, max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS wh
      FROM ps JOIN q ON ps.label = q.label GROUP BY ALL),
w2 AS (SELECT label, q1, median, q3, iqr, CASE WHEN wl IS NULL OR wl > q1 THEN q1 ELSE wl END AS whisker_low,
              CASE WHEN wh IS NULL OR wh < q3 THEN q3 ELSE wh END AS whisker_high FROM w)
SELECT w2.label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high,
       CAST(count(*) FILTER (WHERE v < whisker_low OR v > whisker_high) AS BIGINT) AS n_outliers
FROM w2 JOIN ps ON ps.label = w2.label GROUP BY ALL""")


def _lr_curves() -> str:
    ctes, _, _, hist = linear_sql(DENSE_X, DENSE_Y, "lr", 10, 0.01, DENSE_D)
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(
        f"SELECT CAST(epoch AS INTEGER) AS epoch, 'loss' AS series, round(loss, 6) AS value FROM {h} "
        f"UNION ALL SELECT CAST(epoch AS INTEGER), 'accuracy', round(accuracy, 6) FROM {h}" for h in hist)


oracle("training_curves", _lr_curves())

HISTORY = """SELECT source AS run, doc_id AS epoch, CAST(n_chars % 1000 AS DOUBLE) / 1000.0 AS val_f1 FROM documents"""
MARKED = f"""WITH b AS (SELECT *, coalesce(val_f1 > coalesce(max(val_f1) OVER (PARTITION BY run ORDER BY epoch
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0), false) AS is_best FROM ({HISTORY})),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS rk FROM b),
l AS (SELECT *, coalesce(max(CASE WHEN is_best THEN rk END) OVER (PARTITION BY run ORDER BY epoch
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS lb FROM r),
n AS (SELECT *, CAST(rk - lb AS INTEGER) AS n_no_improve FROM l),
s AS (SELECT run, min(rk) AS sr, arg_min(epoch, rk) AS stop_epoch FROM n WHERE n_no_improve >= 2 GROUP BY run)
SELECT n.*, (s.sr IS NULL OR n.rk <= s.sr) AS ran, s.stop_epoch FROM n LEFT JOIN s ON n.run = s.run"""
oracle("best_epoch", f"SELECT run, epoch, val_f1, is_best FROM ({MARKED})")
oracle("early_stop", f"SELECT run, epoch, n_no_improve, ran FROM ({MARKED})")
oracle("run_summary", f"""SELECT run, max(CASE WHEN is_best THEN epoch END) AS best_epoch, round(max(val_f1), 6) AS best_metric,
       max(stop_epoch) AS stop_epoch, count(*) AS n_epochs_run FROM ({MARKED}) WHERE ran GROUP BY run""")


# ---------------------------------------------------------------- datasets

QA_KEYED = f"""SELECT *, CAST(item_id AS VARCHAR) || '-' || CAST(label AS VARCHAR) || '-' || CAST(part AS VARCHAR)
       || '-' || CAST(idx AS VARCHAR) AS key FROM ({QA_PREPARED})"""
QA_SPLIT = split_sql(QA_KEYED, "CAST(label AS VARCHAR) || '_' || source", ceil_test(0.2), key="key")
COMBINED = f"""SELECT 'hc3' AS corpus, item_id, part, idx, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS pos,
       label, source, split, text, question FROM ({QA_SPLIT})
UNION ALL SELECT 'turingbench', CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), doc_id, pos,
       label, source, split, text, CAST(NULL AS VARCHAR) FROM ({MC_PREPARED})"""

oracle("qa_split", f"SELECT item_id, label, part, idx, source, split FROM ({QA_SPLIT})")
oracle("combined_union", f"""SELECT corpus, item_id, part, idx, doc_id, pos, label, source, split,
       CAST(length(text) AS INTEGER) AS n_chars, question IS NOT NULL AS has_question,
       row_number() OVER (PARTITION BY split ORDER BY md5('42|' || row_key), row_key) AS shuffle_rank
FROM (SELECT *, corpus || ':' || coalesce(CAST(item_id AS VARCHAR) || '-' || CAST(label AS VARCHAR) || '-'
             || CAST(part AS VARCHAR) || '-' || CAST(idx AS VARCHAR),
             CAST(doc_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR)) AS row_key FROM ({COMBINED}))""")
oracle("corpus_summary", f"""WITH t AS (
  SELECT 'hc3' AS dataset, split, label, text FROM ({QA_SPLIT})
  UNION ALL SELECT 'turingbench', split, label, text FROM ({MC_PREPARED})
  UNION ALL SELECT 'combined', split, label, text FROM ({COMBINED}))
SELECT dataset, split, count(*) AS n_rows, count(*) FILTER (WHERE label = 0) AS n_label0,
       count(*) FILTER (WHERE label = 1) AS n_label1, round(avg(length(text)), 6) AS avg_chars,
       count(*) FILTER (WHERE text IS NULL) AS n_null_text
FROM t GROUP BY dataset, split""")


oracle("row_funnel", ORACLES["row_funnel"] + f"""
UNION ALL SELECT CASE WHEN split = 'train' THEN 4 ELSE 5 END, split, count(*) FROM ({QA_SPLIT}) GROUP BY split""")


oracle("text_encoder", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars,
       CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_spaces FROM documents""")
oracle("null_source_split", "SELECT doc_id, source, split FROM (" + split_sql(
    "SELECT doc_id, lang, CASE WHEN doc_id % 4 <> 0 THEN source END AS source FROM documents", "lang || '_' || source", ceil_test(0.2)) + ")")


def _tfidf_evaluate(kind: str) -> str:
    """Fit, score the test split, then overall and per-source metrics."""
    ctes, w, b, _ = linear_sql(_tfidf_long(TRAIN_DOCS), f"SELECT doc_id, CAST(label AS DOUBLE) AS y FROM ({TRAIN_DOCS})",
                               kind, 10, 0.01, f"SELECT term_idx AS j FROM ({TFIDF_VOCAB})")
    ctes.append(f"xt AS ({_tfidf_long(TEST_DOCS)})")
    ctes.append(f"yt AS (SELECT doc_id, label, source FROM ({TEST_DOCS}))")
    positive = "1.0 / (1.0 + exp(-z)) >= 0.5" if kind == "lr" else "z >= 0"
    ctes.append(f"""scored AS (
  SELECT label, source, CAST({positive} AS INTEGER) AS prediction, round(z, 9) AS score
  FROM (SELECT yt.doc_id, yt.label, yt.source, {b}.b + coalesce(s.s, 0.0) AS z FROM yt CROSS JOIN {b}
        LEFT JOIN (SELECT xt.doc_id, sum(xt.x * {w}.w) AS s FROM xt JOIN {w} ON xt.j = {w}.j GROUP BY xt.doc_id) s ON yt.doc_id = s.doc_id))""")
    src = "SELECT * FROM scored"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT 'domain' AS scope, m.g AS domain, m.* EXCLUDE (g), a.roc_auc
FROM ({metrics_sql(src, "source")}) m JOIN ({auc_sql(src, "source", "score")}) a ON m.g = a.g
UNION ALL SELECT 'overall', CAST(NULL AS VARCHAR), m.* EXCLUDE (g), a.roc_auc
FROM ({metrics_sql(src, "1")}) m JOIN ({auc_sql(src, "1", "score")}) a ON m.g = a.g"""


for _k in ("lr", "svm"):
    oracle(f"{_k}_tfidf_evaluate", _tfidf_evaluate(_k))


oracle("split_csv_records", f"""SELECT CAST(row_number() OVER (ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, doc_id, pos) - 1 AS BIGINT) AS doc_id,
       split, label, source, text FROM ({MC_BIN})""")
oracle("dataset_domain", f"SELECT item_id, label, part, idx, source, split FROM ({QA_SPLIT}) WHERE source = 'conv3'")
oracle("load_summary", f"""WITH d AS (SELECT split, label, text, CASE WHEN doc_id % 4 <> 0 THEN source END AS source FROM ({MC_PREPARED}))
SELECT split, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM d GROUP BY split
UNION ALL SELECT split, 'mean length', round(avg(length(text)), 6) FROM d GROUP BY split
UNION ALL SELECT split, 'label ' || CAST(label AS VARCHAR), CAST(count(*) AS DOUBLE) FROM d WHERE label IS NOT NULL GROUP BY split, label
UNION ALL SELECT split, 'nulls source', CAST(count(*) AS DOUBLE) FROM d WHERE source IS NULL GROUP BY split""")
oracle("vector_table_file", f"""SELECT token, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, round(CAST(unnest(vec) AS DOUBLE), 6) AS value
FROM ({VEC_TABLE})""")
