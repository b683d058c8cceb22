"""DuckDB SQL twins of the named queries, written independently of the Spark code.

Derived views use the same SQL text as Spark (``VIEW_SQL``), inlined as CTEs.
"""

from __future__ import annotations

from tableprep.plans.sqltext import clean_text_sql, numeric_text_sql, r6, tokens_sql
from tableprep.sources.tables import VIEW_SQL

ORACLE: dict[str, str] = {}


def v(name: str) -> str:
    return f"{name} AS ({VIEW_SQL[name]})"


ORACLE["clean_orders_by_priority"] = f"""
WITH {v('dirty_orders')},
med AS (SELECT median(o_totalprice) AS m FROM dirty_orders),
mo AS (SELECT o_orderpriority AS v FROM dirty_orders WHERE o_orderpriority IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT o_orderkey, o_custkey, o_orderstatus,
             coalesce(o_totalprice, (SELECT m FROM med)) AS o_totalprice, o_orderdate,
             coalesce(o_orderpriority, (SELECT v FROM mo)) AS o_orderpriority
      FROM dirty_orders),
q AS (SELECT quantile_cont(o_totalprice, 0.25) AS p1, quantile_cont(o_totalprice, 0.75) AS p3,
             quantile_cont(o_custkey, 0.25) AS c1, quantile_cont(o_custkey, 0.75) AS c3 FROM f),
c AS (SELECT o_orderkey,
             greatest(least(o_custkey, c3 + 1.5 * (c3 - c1)), c1 - 1.5 * (c3 - c1)) AS o_custkey,
             {clean_text_sql('o_orderstatus')} AS o_orderstatus,
             greatest(least(o_totalprice, p3 + 1.5 * (p3 - p1)), p1 - 1.5 * (p3 - p1)) AS o_totalprice,
             o_orderdate,
             {clean_text_sql('o_orderpriority')} AS o_orderpriority
      FROM f, q),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_totalprice,
                     o_orderdate, o_orderpriority ORDER BY o_orderkey) AS rn FROM c) WHERE rn = 1)
SELECT o_orderpriority, count(*) AS n_orders, {r6('avg(o_totalprice)')} AS mean_price,
       {r6('max(o_totalprice)')} AS max_price, {r6('avg(o_custkey)')} AS mean_custkey
FROM d GROUP BY o_orderpriority
"""

ORACLE["dataset_profile"] = f"""
WITH {v('dirty_orders')}
SELECT count(*) AS n_samples, CAST(6 AS BIGINT) AS n_features,
       CAST(count(*) * 6 - count(o_custkey) - count(o_orderstatus) - count(o_totalprice) - count(o_orderdate)
            - count(o_orderpriority) - count(o_note) AS BIGINT) AS missing_values
FROM dirty_orders
"""

_DIRTY_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_note"]

ORACLE["null_ratios"] = f"WITH {v('dirty_orders')}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {r6(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_ratio "
    f"FROM dirty_orders" for c in _DIRTY_COLS)


def _task(table, col, is_string):
    return (f"SELECT '{table}' AS table_name, '{col}' AS label_col, count(DISTINCT {col}) AS n_distinct, "
            f"CASE WHEN count(DISTINCT {col}) = 0 THEN 'text' "
            f"WHEN {'true' if is_string else 'false'} OR count(DISTINCT {col}) < 20 THEN 'classification' "
            f"ELSE 'regression' END AS task FROM {table}")


ORACLE["task_inference"] = "\nUNION ALL\n".join([
    _task("labels", "quality", False), _task("lineitem", "l_extendedprice", False),
    _task("lineitem", "l_returnflag", True), _task("events", "user_id", False)])

ORACLE["text_column_detect"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {r6(f'avg(length(coalesce({c}, {chr(39)}nan{chr(39)})))')} AS mean_length, "
    f"avg(length(coalesce({c}, 'nan'))) > 20 AS is_text FROM documents" for c in ["text", "lang", "source"])

ORACLE["numeric_inference"] = f"WITH {v('dirty_part')}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count({numeric_text_sql(c)}) AS parsed, "
    f"count({numeric_text_sql(c)}) >= count({c}) * 0.5 AS converts FROM dirty_part" for c in ["size_txt", "brand_txt"])

_FILL = {
    "median": "(SELECT median(o_totalprice) FROM dirty_orders)",
    "mean": "(SELECT avg(o_totalprice) FROM dirty_orders)",
    "zero": "0.0",
}
for _k, _e in _FILL.items():
    ORACLE[f"fill_{_k}"] = (f"WITH {v('dirty_orders')}\nSELECT o_orderkey, {r6(f'coalesce(o_totalprice, {_e})')} "
                            f"AS o_totalprice FROM dirty_orders")

ORACLE["fill_mode"] = f"""
WITH {v('dirty_orders')},
mo AS (SELECT o_orderpriority AS v FROM dirty_orders WHERE o_orderpriority IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM mo)) AS o_orderpriority FROM dirty_orders
"""

ORACLE["fill_constant"] = f"""
WITH {v('dirty_orders')}
SELECT o_orderkey, coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM dirty_orders
"""

_LN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLE["iqr_clip"] = (
    "WITH q AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in _LN)
    + " FROM lineitem)\nSELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
        r6(f"greatest(least({c}, {c}_3 + 1.5 * ({c}_3 - {c}_1)), {c}_1 - 1.5 * ({c}_3 - {c}_1))") + f" AS {c}"
        for c in _LN) + "\nFROM lineitem, q")

ORACLE["drop_high_missing"] = f"""
WITH {v('dirty_orders')}
SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM dirty_orders
"""

ORACLE["dedup_keep_first"] = f"""
WITH {v('dup_events')}
SELECT row_id, event_type, user_bucket, value_bucket, label FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_bucket, value_bucket ORDER BY row_id) AS rn
  FROM dup_events) WHERE rn = 1
"""

ORACLE["clean_documents"] = f"SELECT doc_id, {clean_text_sql('text')} AS text_clean FROM documents"
ORACLE["clean_pages"] = f"SELECT page_id, {clean_text_sql('html')} AS html_clean FROM pages"

ORACLE["clean_string_array"] = f"""
SELECT conv_id, CAST(floor(turn / 16) AS BIGINT) AS chunk,
       CAST(row_number() OVER (PARTITION BY conv_id, floor(turn / 16) ORDER BY turn) - 1 AS BIGINT) AS pos,
       {clean_text_sql('text')} AS text_clean
FROM conversations
"""

ORACLE["clean_string_map"] = f"""
SELECT conv_id, CAST(floor(turn / 16) AS BIGINT) AS chunk, CAST(turn AS VARCHAR) AS turn,
       {clean_text_sql('text')} AS text_clean FROM conversations
"""

ORACLE["rename_columns"] = """
SELECT o_orderkey AS order_key, o_custkey AS custkey, o_totalprice AS total_price,
       o_orderstatus AS total_price_2, o_orderpriority AS total_price_1 FROM orders
"""

ORACLE["numeric_convert"] = f"""
WITH {v('dirty_part')}
SELECT p_partkey, {numeric_text_sql('size_txt')} AS size_txt, brand_txt FROM dirty_part
"""

# ----------------------------------------------------------------------------------------
# features
# ----------------------------------------------------------------------------------------

from tableprep.plans.sqltext import sig10, terms_from_tokens_sql, tokens_re_sql  # noqa: E402


def _text_feats(c: str) -> str:
    t = tokens_sql(c)
    return (f"CAST(length({c}) AS BIGINT) AS {c}_len, CAST(len({t}) AS BIGINT) AS {c}_word_count, "
            f"CAST(len(list_distinct({t})) AS BIGINT) AS {c}_unique_words, "
            f"{r6(f'length(regexp_replace({c}, {chr(39)}[^\\p{{Lu}}]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})) / (length({c}) + 1)')} "
            f"AS {c}_uppercase_ratio")


def _date_parts(c: str) -> str:
    return (f"CAST(year({c}) AS BIGINT) AS {c}_year, CAST(month({c}) AS BIGINT) AS {c}_month, "
            f"CAST(day({c}) AS BIGINT) AS {c}_day, CAST(isodow({c}) - 1 AS BIGINT) AS {c}_weekday")


ORACLE["text_features"] = f"SELECT doc_id, {_text_feats('text')} FROM documents"
ORACLE["datetime_features"] = f"SELECT o_orderkey, {_date_parts('o_orderdate')} FROM orders"
ORACLE["datetime_features_events"] = f"SELECT event_id, {_date_parts('ts')} FROM events"


def _freq_cte(table: str, c: str) -> str:
    return (f"f_{c} AS (SELECT {c} AS v, count(*) / (SELECT count({c}) FROM {table}) AS freq "
            f"FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})")


ORACLE["frequency_encode"] = f"""
WITH {_freq_cte('orders', 'o_orderpriority')}, {_freq_cte('orders', 'o_orderstatus')}
SELECT o_orderkey, {r6('coalesce(a.freq, 0.0)')} AS o_orderpriority_freq, {r6('coalesce(b.freq, 0.0)')} AS o_orderstatus_freq
FROM orders LEFT JOIN f_o_orderpriority a ON o_orderpriority = a.v LEFT JOIN f_o_orderstatus b ON o_orderstatus = b.v
"""

ORACLE["frequency_encode_join"] = f"""
WITH {_freq_cte('lineitem', 'l_partkey')}
SELECT l_orderkey, l_linenumber, l_partkey, {r6('coalesce(a.freq, 0.0)')} AS l_partkey_freq
FROM lineitem LEFT JOIN f_l_partkey a ON l_partkey = a.v
"""

_PAIRS = [(a, b) for i, a in enumerate(_LN) for b in _LN[i + 1:]]
ORACLE["interactions"] = ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                          + ", ".join(f"{r6(f'{a} * {b}')} AS {a}_x_{b}" for a, b in _PAIRS) + " FROM lineitem")

ORACLE["interactions_array"] = "\nUNION ALL\n".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({k} AS BIGINT) AS pair, "
    f"{r6(f'{a} * {b}')} AS product FROM lineitem" for k, (a, b) in enumerate(_PAIRS))

_P3 = ["l_quantity", "l_discount", "l_tax"]
ORACLE["polynomial2"] = ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"{r6(f'{a} * {b}')} AS {a + '_pow2' if a == b else a + '_x_' + b}"
    for i, a in enumerate(_P3) for b in _P3[i:]) + " FROM lineitem")

ORACLE["feature_engineer"] = f"""
WITH {_freq_cte('orders', 'o_orderstatus')}, {_freq_cte('orders', 'o_orderpriority')}
SELECT o_orderkey, o_custkey, {r6('o_totalprice')} AS o_totalprice,
       {r6('o_custkey * o_totalprice')} AS o_custkey_x_o_totalprice,
       {_date_parts('o_orderdate')}, {_text_feats('o_orderstatus')}, {_text_feats('o_orderpriority')},
       {r6('coalesce(a.freq, 0.0)')} AS o_orderstatus_freq, {r6('coalesce(b.freq, 0.0)')} AS o_orderpriority_freq
FROM orders LEFT JOIN f_o_orderstatus a ON o_orderstatus = a.v LEFT JOIN f_o_orderpriority b ON o_orderpriority = b.v
"""

# ----------------------------------------------------------------------------------------
# encoding
# ----------------------------------------------------------------------------------------

ORACLE["onehot_long"] = """
WITH s AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS i FROM orders),
p AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS i FROM orders),
ns AS (SELECT count(DISTINCT o_orderstatus) AS k FROM orders)
SELECT o_orderkey, CAST(i AS BIGINT) AS slot, CAST(1.0 AS DOUBLE) AS value FROM s
UNION ALL
SELECT o_orderkey, CAST(i + (SELECT k FROM ns) AS BIGINT) AS slot, CAST(1.0 AS DOUBLE) AS value FROM p
"""

ORACLE["ordinal_encode"] = """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS BIGINT) AS o_orderstatus_ord,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority_ord FROM orders
"""

ORACLE["target_encode"] = f"""
WITH a AS (SELECT o_orderstatus AS v, avg(o_totalprice) AS m FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS v, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT o_orderkey, {r6('coalesce(a.m, 0.0)')} AS o_orderstatus_te, {r6('coalesce(b.m, 0.0)')} AS o_orderpriority_te
FROM orders LEFT JOIN a ON o_orderstatus = a.v LEFT JOIN b ON o_orderpriority = b.v
"""

_FOLD = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 5"
ORACLE["target_encode_oof"] = f"""
WITH o AS (SELECT *, {_FOLD} AS fold FROM orders),
a AS (SELECT x.o_orderkey, (SELECT avg(y.o_totalprice) FROM o y WHERE y.o_orderstatus = x.o_orderstatus
                            AND y.fold <> x.fold) AS ms,
             (SELECT avg(y.o_totalprice) FROM o y WHERE y.o_orderpriority = x.o_orderpriority
                            AND y.fold <> x.fold) AS mp FROM o x)
SELECT o_orderkey, {r6('coalesce(ms, 0.0)')} AS o_orderstatus_te, {r6('coalesce(mp, 0.0)')} AS o_orderpriority_te FROM a
"""

_CLEAN_DOCS = f"cd AS (SELECT doc_id, {clean_text_sql('text')} AS text FROM documents)"


def _tfidf_sql(k: int, ngrams: int, sublinear: bool) -> str:
    tfw = "(1 + ln(tf))" if sublinear else "tf"
    return f"""
WITH {_CLEAN_DOCS},
tk AS (SELECT doc_id, {tokens_re_sql('text')} AS t FROM cd),
tm AS (SELECT doc_id, {terms_from_tokens_sql('t', ngrams)} AS terms FROM tk),
occ AS (SELECT doc_id, unnest(terms) AS term FROM tm),
st AS (SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_freq FROM occ GROUP BY term),
vocab AS (SELECT * FROM st ORDER BY term_count DESC, term LIMIT {k}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, tf.term, {tfw} * (ln((1.0 + n) / (1.0 + doc_freq)) + 1) AS w FROM tf JOIN vocab USING (term), n)
SELECT doc_id, term, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w
"""


ORACLE["tfidf_top_terms"] = f"""
WITH {_CLEAN_DOCS},
tk AS (SELECT doc_id, {tokens_re_sql('text')} AS t FROM cd),
tm AS (SELECT doc_id, {terms_from_tokens_sql('t', 2)} AS terms FROM tk),
occ AS (SELECT doc_id, unnest(terms) AS term FROM tm)
SELECT term, count(*) AS term_count, count(DISTINCT doc_id) AS doc_freq FROM occ GROUP BY term
ORDER BY term_count DESC, term LIMIT 1000
"""
ORACLE["tfidf_weights"] = _tfidf_sql(5000, 2, False)
ORACLE["tfidf_sublinear"] = _tfidf_sql(50000, 1, True)

# ----------------------------------------------------------------------------------------
# scaling and selection
# ----------------------------------------------------------------------------------------

_CC = ["o_totalprice", "k13", "k_const"]


def _div(e: str) -> str:
    return f"CASE WHEN ({e}) = 0 OR ({e}) IS NULL THEN 1.0 ELSE ({e}) END"


ORACLE["scale_standard"] = (f"WITH {v('const_features')}, s AS (SELECT " + ", ".join(
    f"stddev_pop({c}) AS s_{c}" for c in _CC) + " FROM const_features)\nSELECT o_orderkey, " + ", ".join(
    f"{r6(f'{c} / {_div(f's_{c}')}')} AS {c}" for c in _CC) + " FROM const_features, s")

ORACLE["scale_minmax"] = (f"WITH {v('const_features')}, s AS (SELECT " + ", ".join(
    f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in _CC) + " FROM const_features)\nSELECT o_orderkey, " + ", ".join(
    f"{r6(f'({c} - a_{c}) / {_div(f'b_{c} - a_{c}')}')} AS {c}" for c in _CC) + " FROM const_features, s")

ORACLE["scale_robust"] = (f"WITH {v('const_features')}, s AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}"
    for c in _CC) + " FROM const_features)\nSELECT o_orderkey, " + ", ".join(
    f"{r6(f'({c} - m_{c}) / {_div(f'b_{c} - a_{c}')}')} AS {c}" for c in _CC) + " FROM const_features, s")

ORACLE["select_variance"] = f"WITH {v('const_features')}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {sig10(f'var_pop({c})')} AS statistic, var_pop({c}) > 0.01 AS kept FROM const_features"
    for c in _CC)

_LF = ("lf AS (SELECT *, l_extendedprice * (1 - l_discount) AS net_price, 1.0 AS const_one FROM lineitem)")
_CN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "const_one"]


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


ORACLE["select_correlation"] = (
    f"WITH {_LF}, pairs AS (" + "\nUNION ALL\n".join(
        f"SELECT '{b}' AS feature, {j} AS j, abs({_corr(a, b)}) AS r FROM lf"
        for j, b in enumerate(_CN) for a in _CN[:j]) + "),\n"
    "feats AS (" + " UNION ALL ".join(f"SELECT '{b}' AS feature" for b in _CN) + "),\n"
    "m AS (SELECT feature, max(r) AS mr FROM pairs GROUP BY feature)\n"
    f"SELECT feats.feature, {sig10('mr')} AS statistic, (mr IS NULL OR mr <= 0.95) AS kept "
    "FROM feats LEFT JOIN m USING (feature)")

_OF = ("f AS (SELECT o_orderstatus AS y, o_totalprice AS x0, CAST(o_custkey AS DOUBLE) AS x1, "
       "CAST(o_orderkey % 13 AS DOUBLE) AS x2, 7.0 AS x3 FROM orders)")
_ON = ["o_totalprice", "o_custkey", "k13", "k_const"]
ORACLE["select_kbest_anova"] = (
    f"WITH {_OF},\ng AS (SELECT y, count(*) AS n, " + ", ".join(
        f"sum(x{i}) AS s{i}, sum(x{i} * x{i}) AS q{i}" for i in range(4)) + " FROM f GROUP BY y),\n"
    "t AS (SELECT sum(n) AS n, count(*) AS k, " + ", ".join(
        f"sum(s{i}) AS s{i}, sum(q{i}) AS q{i}, sum(s{i} * s{i} / n) AS b{i}" for i in range(4)) + " FROM g),\n"
    "fs AS (" + "\nUNION ALL\n".join(
        f"SELECT '{nm}' AS feature, {i} AS idx, CASE WHEN (b{i} - s{i} * s{i} / n) = 0 AND (q{i} - b{i}) = 0 THEN NULL "
        f"ELSE ((b{i} - s{i} * s{i} / n) / (k - 1)) / ((q{i} - b{i}) / (n - k)) END AS fv FROM t"
        for i, nm in enumerate(_ON)) + ")\n"
    f"SELECT feature, {sig10('fv')} AS statistic, "
    "row_number() OVER (ORDER BY fv IS NULL, fv DESC, idx) <= 2 AS kept FROM fs")

_RN = ["l_quantity", "l_discount", "l_tax", "net_price"]
ORACLE["select_kbest_regression"] = (
    f"WITH {_LF},\nfs AS (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {i} AS idx, ({_corr(c, 'l_extendedprice')}) AS r, count(*) AS n FROM lf"
        for i, c in enumerate(_RN)) + "),\n"
    "ff AS (SELECT feature, idx, r * r / (1 - r * r) * (n - 2) AS fv FROM fs)\n"
    f"SELECT feature, {sig10('fv')} AS statistic, "
    "row_number() OVER (ORDER BY fv IS NULL, fv DESC, idx) <= 2 AS kept FROM ff")

# ----------------------------------------------------------------------------------------
# models, metrics, run log
# ----------------------------------------------------------------------------------------

_B100 = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100"
ORACLE["hash_split"] = (f"SELECT o_orderkey, {_B100} AS bucket, "
                        f"CASE WHEN {_B100} < 20 THEN 'test' ELSE 'train' END AS split FROM orders")

_RULE = """CASE WHEN is_sparse THEN CASE WHEN task = 'classification' THEN 'LogisticRegression(sgd-log)' ELSE 'LinearRegression(sgd)' END
  WHEN n_features > 500 THEN CASE WHEN task = 'classification' THEN 'LinearSVC(sgd-hinge)' ELSE 'LinearRegression(sgd)' END
  WHEN n_samples < 1000 THEN CASE WHEN task = 'classification' THEN 'LogisticRegression' ELSE 'LinearRegression' END
  WHEN n_samples < 10000 THEN CASE WHEN task = 'classification' THEN 'DecisionTreeClassifier(depth=10)' ELSE 'RandomForestRegressor(100)' END
  ELSE CASE WHEN task = 'classification' THEN 'RandomForestClassifier(200)' ELSE 'RandomForestRegressor(200)' END END"""


def _prof(name, table, label, d, sparse, is_string):
    return (f"SELECT '{name}' AS dataset, count(*) AS n_samples, CAST({d} AS BIGINT) AS n_features, {sparse} AS is_sparse, "
            f"CASE WHEN {is_string} OR count(DISTINCT {label}) < 20 THEN 'classification' ELSE 'regression' END AS task "
            f"FROM {table}")


ORACLE["model_rule"] = f"WITH {v('text_corpus')}, p AS (" + "\nUNION ALL\n".join([
    _prof("orders_status", "orders", "o_orderstatus", 4, "false", "true"),
    _prof("lineitem_price", "lineitem", "l_extendedprice", 3, "false", "false"),
    _prof("text_quality", "text_corpus", "quality", 1000, "true", "false"),
    _prof("customer_segment", "customer", "c_mktsegment", 2, "false", "true"),
    _prof("embeddings_label", "embeddings", "label", 64, "false", "false"),
    _prof("labels_toxic", "labels", "toxic", 1, "false", "false")]) + f")\nSELECT *, {_RULE} AS model_name FROM p"

ORACLE["metric_accuracy_f1"] = f"""
WITH {v('baseline_pred')},
n AS (SELECT count(*) AS n FROM baseline_pred),
cls AS (SELECT o_orderstatus AS c FROM baseline_pred UNION SELECT pred_status FROM baseline_pred),
per AS (SELECT c,
          (SELECT count(*) FROM baseline_pred WHERE o_orderstatus = c) AS support,
          (SELECT count(*) FROM baseline_pred WHERE pred_status = c) AS predicted,
          (SELECT count(*) FROM baseline_pred WHERE o_orderstatus = c AND pred_status = c) AS tp FROM cls)
SELECT {r6('sum(tp) / (SELECT n FROM n)')} AS accuracy,
       {r6('sum(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END * support) / (SELECT n FROM n)')} AS f1_weighted
FROM per
"""

ORACLE["metric_r2_rmse"] = f"""
WITH {v('baseline_pred')}
SELECT {r6('1 - sum((o_totalprice - pred_price) ^ 2) / sum((o_totalprice - m) ^ 2)')} AS r2,
       {r6('sqrt(avg((o_totalprice - pred_price) ^ 2))')} AS rmse
FROM baseline_pred, (SELECT avg(o_totalprice) AS m FROM baseline_pred)
"""


def _mode_cte(key: str, i: int) -> str:
    return (f"m{i} AS (SELECT {key} AS k, label AS v FROM (SELECT {key}, label, row_number() OVER "
            f"(PARTITION BY {key} ORDER BY count(*) DESC, label) AS rn FROM dup_events GROUP BY {key}, label) WHERE rn = 1)")


ORACLE["weighted_vote"] = (f"WITH {v('dup_events')}, " + ", ".join(
    _mode_cte(k, i) for i, k in enumerate(["event_type", "user_bucket", "value_bucket"])) + """
SELECT row_id, label, round_even((1.0 * m0.v + 2.0 * m1.v + 1.0 * m2.v) / 4.0, 0) AS prediction
FROM dup_events d JOIN m0 ON d.event_type = m0.k JOIN m1 ON d.user_bucket = m1.k JOIN m2 ON d.value_bucket = m2.k
""")

ORACLE["linear_fit"] = (f"SELECT {sig10('regr_slope(l_extendedprice, l_quantity)')} AS slope, "
                        f"{sig10('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, "
                        f"{sig10('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem")

_SCORE = """
WITH {rl},
s AS (SELECT *, coalesce(lag(val_score) OVER (PARTITION BY run_id ORDER BY stage_idx), 0.0) AS prev FROM run_log),
r AS (SELECT run_id, stage_idx,
        val_score + 0.2 * (val_score - prev) - 0.3 * greatest(0.0, train_score - val_score)
        - tanh(seconds / 10.0) * 0.2 + 0.1 * (1.0 / (1.0 + ln(1 + n_features)))
        - CASE WHEN model_name LIKE '%RandomForest%' OR model_name LIKE '%Boost%' OR model_name LIKE '%GBT%'
               THEN 0.08 ELSE 0.0 END
        - CASE WHEN n_features > 500 THEN 0.08 ELSE 0.0 END
        + CASE WHEN abs(train_score - val_score) < 0.05 THEN 0.05 ELSE 0.0 END AS raw FROM s),
sc AS (SELECT run_id, stage_idx, least(greatest(raw, 0.01), 0.99) AS score FROM r)
"""
ORACLE["stage_score"] = _SCORE.format(rl=v("run_log")) + f"SELECT run_id, stage_idx, {r6('score')} AS score FROM sc"
ORACLE["run_leaderboard"] = _SCORE.format(rl=v("run_log")) + f"""
SELECT run_id, count(*) AS n_stages, {r6('least(greatest(avg(score), 0.0), 1.0)')} AS mean_score,
       least(greatest(avg(score), 0.0), 1.0) >= 0.5 AS success, {r6('count(*) / 8.0')} AS progress
FROM sc GROUP BY run_id
"""

ORACLE["frequency_encode_salted"] = """
WITH n AS (SELECT l_orderkey, count(*) / (SELECT count(*) FROM lineitem) AS f FROM lineitem GROUP BY l_orderkey)
SELECT l.l_orderkey, l_linenumber, l_partkey, round(f, 9) AS l_orderkey_freq
FROM lineitem l JOIN n ON l.l_orderkey = n.l_orderkey
"""

_MISS = {"o_orderkey": "o_orderkey IS NULL", "o_orderpriority": "o_orderpriority IS NULL",
         "price": "price IS NULL OR isnan(price)", "placed": "placed IS NULL"}
ORACLE["nan_null_ratio"] = f"WITH {v('nan_orders')}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {r6(f'avg(CASE WHEN {m} THEN 1.0 ELSE 0.0 END)')} AS null_ratio FROM nan_orders"
    for c, m in _MISS.items())
ORACLE["nan_profile"] = f"""
WITH {v('nan_orders')}
SELECT count(*) AS n_samples, CAST(3 AS BIGINT) AS n_features,
       CAST(sum(CASE WHEN price IS NULL OR isnan(price) THEN 1 ELSE 0 END)
            + sum(CASE WHEN placed IS NULL THEN 1 ELSE 0 END)
            + sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_values
FROM nan_orders
"""
ORACLE["nan_fill"] = f"""
WITH {v('nan_orders')},
p AS (SELECT o_orderkey, CASE WHEN isnan(price) THEN NULL ELSE price END AS price, placed FROM nan_orders),
d AS (SELECT placed FROM p WHERE placed IS NOT NULL GROUP BY placed ORDER BY count(*) DESC, placed LIMIT 1),
f AS (SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM p)) AS price,
             coalesce(placed, (SELECT placed FROM d)) AS placed FROM p),
q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM f)
SELECT o_orderkey, {r6('greatest(least(price, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1))')} AS price,
       strftime(placed, '%Y-%m-%d') AS placed
FROM f, q
"""
_RATE = """
SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS rate
FROM orders GROUP BY o_orderpriority
"""
ORACLE["logistic_fit"] = _RATE
ORACLE["tree_fit"] = ("SELECT o_orderpriority, count(*) AS n, CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 2 AS "
                      "DOUBLE) AS rate FROM orders GROUP BY o_orderpriority")
ORACLE["forest_fit"] = ORACLE["gbt_fit"] = ("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders "
    "GROUP BY o_orderpriority")

ORACLE["hashing_tf"] = f"""
WITH {_CLEAN_DOCS},
tk AS (SELECT doc_id, {tokens_re_sql('text')} AS t FROM cd),
occ AS (SELECT doc_id, md5(term) AS h FROM (SELECT doc_id, unnest({terms_from_tokens_sql('t', 1)}) AS term FROM tk)),
s AS (SELECT doc_id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 5000 AS bucket,
             sum(CASE WHEN CAST(('0x' || substr(h, 9, 1)) AS BIGINT) >= 8 THEN -1.0 ELSE 1.0 END) AS s FROM occ GROUP BY 1, 2)
SELECT doc_id, bucket, {r6('CAST(s AS DOUBLE) / sqrt(sum(CAST(s * s AS DOUBLE)) OVER (PARTITION BY doc_id))')} AS weight
FROM s WHERE s <> 0
"""

ORACLE["slot_quantiles"] = f"""
WITH l AS (SELECT l_partkey % 5000 AS slot, l_extendedprice FROM lineitem),
q AS (SELECT slot, unnest([0.25e0, 0.5e0, 0.75e0]) AS prob, unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.75])) AS quantile
      FROM l GROUP BY slot)
SELECT slot, prob, {r6('quantile')} AS quantile FROM q"""

# every order has a value in every slot, zero in all but its own
ORACLE["slot_quantiles_sparse"] = f"""
WITH o AS (SELECT o_orderstatus || '/' || o_orderpriority AS slot, o_totalprice - 150000 AS value FROM orders),
s AS (SELECT DISTINCT slot FROM o),
q AS (SELECT s.slot, unnest([0.01e0, 0.03e0, 0.5e0, 0.97e0, 0.99e0]) AS prob,
             unnest(quantile_cont(CASE WHEN o.slot = s.slot THEN value ELSE 0e0 END, [0.01, 0.03, 0.5, 0.97, 0.99])) AS quantile
      FROM s CROSS JOIN o GROUP BY s.slot)
SELECT slot, prob, {r6('quantile')} AS quantile FROM q"""

ORACLE["slot_scale_customer"] = f"""
WITH n AS (SELECT count(*) AS n, count(DISTINCT c_name) AS names, count(DISTINCT c_mktsegment) AS segments,
                  var_pop(c_acctbal) AS v FROM customer),
e AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS slot, 1e0 AS value FROM customer
      UNION ALL
      SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 + names, 1e0 FROM customer, n
      UNION ALL
      SELECT c_custkey, names + segments, c_acctbal FROM customer, n),
k AS (SELECT slot, count(*) / any_value(n.n)::DOUBLE AS share, any_value(CASE WHEN slot = names + segments THEN v END) AS v
      FROM e, n GROUP BY slot),
t AS (SELECT slot, coalesce(v, share * (1 - share)) AS variance FROM k)
SELECT c_custkey, slot, {r6('value / sqrt(variance)')} AS value FROM e JOIN t USING (slot) WHERE variance > 0.0001"""

_B100_LINE = _B100.replace("o_orderkey", "l_orderkey")
_RIDGE = ", ".join([*[f"{sig10(c, 6)} AS {c}" for c in ("first", "last", "intercept")],
                    *[f"{r6(c)} AS {c}" for c in ("train_r2", "val_r2")]])
# (v + alpha) b = covariance with the label, for one and for two features; errors on the rows themselves
ORACLE["tune_search"] = f"""
WITH l AS (SELECT l_quantity AS x, l_discount AS z, l_extendedprice AS y, {_B100_LINE} < 20 AS held FROM lineitem),
m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS vx, var_pop(z) AS vz, covar_pop(x, z) AS xz,
             covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM l WHERE NOT held),
a AS (SELECT unnest([0.0001e0, 0.01e0, 1e0, 100e0]) AS alpha),
one AS (SELECT 1 AS n_features, alpha, xy / (vx + alpha) AS first, 0e0 AS second FROM a, m),
two AS (SELECT 2 AS n_features, alpha, ((vz + alpha) * xy - xz * zy) / ((vx + alpha) * (vz + alpha) - xz * xz) AS first,
               ((vx + alpha) * zy - xz * xy) / ((vx + alpha) * (vz + alpha) - xz * xz) AS second FROM a, m),
f AS (SELECT *, my - first * mx - second * mz AS intercept FROM (SELECT * FROM one UNION ALL SELECT * FROM two), m),
s AS (SELECT n_features, alpha, any_value(first) AS first, any_value(second) AS second, any_value(intercept) AS intercept,
             1 - avg((y - intercept - first * x - second * z) ^ 2) FILTER (WHERE NOT held) / var_pop(y) FILTER (WHERE NOT held)
               AS train_r2,
             1 - avg((y - intercept - first * x - second * z) ^ 2) FILTER (WHERE held) / var_pop(y) FILTER (WHERE held) AS val_r2
      FROM f, l GROUP BY n_features, alpha),
r AS (SELECT n_features, alpha, first, CASE WHEN n_features = 1 THEN first ELSE second END AS last, intercept, train_r2, val_r2,
             row_number() OVER (PARTITION BY n_features ORDER BY val_r2 DESC, alpha) = 1 AS chosen FROM s)
SELECT n_features, alpha, {_RIDGE}, chosen FROM r"""

ORACLE["csv_route"] = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, 'structured' AS modality,
       'c_mktsegment' AS label_col, CAST(3 AS BIGINT) AS n_features FROM customer"""

ORACLE["text_lines"] = """
SELECT CAST(length(line) AS BIGINT) AS n_chars, count(*) AS n_lines
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"""

ORACLE["file_order"] = """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_number FROM orders"""

ORACLE["clean_report"] = f"""
WITH {v('dirty_orders')}
SELECT 'orders' AS run_id, 'cleaning' AS stage, 'n_rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM dirty_orders
UNION ALL SELECT 'orders', 'cleaning', 'dropped_columns_missing',
  CASE WHEN avg(CASE WHEN o_note IS NULL THEN 1e0 ELSE 0e0 END) > 0.4 THEN '["o_note"]' ELSE '[]' END FROM dirty_orders
UNION ALL SELECT 'orders', 'cleaning', 'converted_numeric',
  CASE WHEN count(TRY_CAST(o_orderpriority AS DOUBLE)) >= 0.5 * count(o_orderpriority) THEN '["o_orderpriority"]' ELSE '[]' END
FROM dirty_orders"""

ORACLE["model_analysis"] = f"""
SELECT count(*) AS n_samples, count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) AS n_features, true AS is_sparse,
       {r6('2e0 / (count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority))')} AS density FROM orders"""

# the share of the label's variance that a feature's groups explain, in shares of their sum
ORACLE["select_informative"] = """
WITH o AS (SELECT o_orderkey % 13 AS k13, CASE WHEN o_orderkey % 13 >= 7 THEN 1e0 ELSE 0e0 END AS y FROM orders),
g AS (SELECT k13, avg(y) AS m, count(*) AS n FROM o GROUP BY k13),
s AS (SELECT sum(n * (m - (SELECT avg(y) FROM o)) ^ 2) / (SELECT var_pop(y) * count(*) FROM o) AS share FROM g),
f AS (SELECT 'k13' AS feature, round(share, 9) AS statistic FROM s UNION ALL SELECT unnest(['seven', 'one']), 0e0)
SELECT feature, statistic, statistic >= (SELECT avg(statistic) FROM f) AS kept FROM f"""

ORACLE["soft_voting_rates"] = """
WITH o AS (SELECT o_orderpriority, CAST(o_orderkey % 13 AS VARCHAR) AS k13,
                  CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS y FROM orders),
a AS (SELECT o_orderpriority, avg(y) AS a FROM o GROUP BY 1), b AS (SELECT k13, avg(y) AS b FROM o GROUP BY 1)
SELECT o_orderpriority, k13, CAST(CASE WHEN a + b > 1 THEN 1 ELSE 0 END AS BIGINT) AS prediction, count(*) AS n
FROM o JOIN a USING (o_orderpriority) JOIN b USING (k13) GROUP BY o_orderpriority, k13, a, b"""

ORACLE["stacking_means"] = f"""
WITH o AS (SELECT o_orderpriority AS g, o_totalprice AS y, {_FOLD} AS fold FROM orders),
p AS (SELECT g, fold, sum(y) AS s, count(*) AS n FROM o GROUP BY g, fold),
t AS (SELECT g, sum(s) AS s, sum(n) AS n FROM p GROUP BY g),
m AS (SELECT p.g, p.fold, (t.s - p.s) / (t.n - p.n) AS x FROM p JOIN t USING (g)),
r AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM o JOIN m USING (g, fold))
SELECT {sig10('slope', 6)} AS slope, {sig10('intercept', 6)} AS intercept FROM r"""

# one Newton step from the log shares, then the softmax of the scores
ORACLE["boost_classes"] = f"""
WITH c AS (SELECT o_orderstatus, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS class FROM
           (SELECT DISTINCT o_orderstatus FROM orders)),
o AS (SELECT o_orderpriority AS g, class AS own FROM orders JOIN c USING (o_orderstatus)),
k AS (SELECT own AS class, count(*) / (SELECT count(*) FROM o)::DOUBLE AS share FROM o GROUP BY own),
r AS (SELECT g, class, any_value(share) AS share, count(*) AS n, sum((own = class)::INT - share) AS r,
             sum(abs((own = class)::INT - share) * (1 - abs((own = class)::INT - share))) AS h
      FROM o CROSS JOIN k GROUP BY g, class),
f AS (SELECT g, class, n, exp(ln(share) + 2e0 / 3 * r / h) AS e FROM r)
SELECT g AS o_orderpriority, class, n, {r6('e / sum(e) OVER (PARTITION BY g)')} AS probability FROM f"""

# presence of a term in a document as 0 and 1; pairs that share no document cannot correlate above 0.95 here
ORACLE["correlated_terms"] = f"""
WITH {_CLEAN_DOCS},
tk AS (SELECT doc_id, {tokens_re_sql('text')} AS t FROM cd),
occ AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(t) AS term FROM tk)),
top AS (SELECT term, count(*)::DOUBLE AS k FROM occ GROUP BY term ORDER BY k DESC, term LIMIT 5000),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
o AS (SELECT doc_id, term, k FROM occ JOIN top USING (term)),
p AS (SELECT a.term AS term_a, b.term AS term_b, any_value(a.k) AS ka, any_value(b.k) AS kb, count(*)::DOUBLE AS s
      FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL),
r AS (SELECT term_a, term_b, (s / n - ka / n * kb / n) / sqrt(ka / n * (1 - ka / n) * kb / n * (1 - kb / n)) AS r
      FROM p, n WHERE ka < n AND kb < n)
SELECT term_a, term_b, {r6('r')} AS r FROM r WHERE abs(r) > 0.95"""
