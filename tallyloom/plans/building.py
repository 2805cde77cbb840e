"""Queries over matched questions, built records, and expressions that have no row elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import geometry as g
from ..functions import numbers as n
from ..functions import text as x
from ..operators import matching as m
from ..operators import pairs as p
from ..operators import records as r
from ..operators import sampling as sm
from ..operators import tables as t
from ..operators import validate as v
from ..operators.quality import gap_candidates
from .auditing import _clean
from .carriers import BOXES_SQL, FACTS_SQL, GRID_SQL, NUMBER_TEXTS_SQL, boxes, facts, grid, number_texts, table
from .mining import _I, _PP, _instances
from .scalars import _canonical, _tok

QUERIES, SQL = {}, {}


def add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


def _k():
    return F.col("o_orderkey")


def _orders(s, d):
    return table(s, d, "orders")


def _one_of(*values):
    return F.element_at(F.array(*map(F.lit, values)), (_k() % len(values) + 1).cast("int"))


def _match(s, d):
    year = F.year("o_orderdate").cast("string")
    question = F.concat(F.lit("What was the total "), "o_orderpriority", F.when(_k() % 3 != 0, F.concat(F.lit(" in "), year)).otherwise(""), F.lit("?"))
    context = F.when(_k() % 4 == 0, "").when(_k() % 4 == 1, F.concat(F.lit("Total for "), year)).when(_k() % 4 == 2, F.concat(F.lit("The total "), "o_orderpriority", F.lit(" of the year "), year)).otherwise(F.concat(F.lit("Total "), "o_orderpriority"))
    return _orders(s, d).select("o_orderkey", m.metric_period_match(question, context).alias("m")).select("o_orderkey", "m.reason", "m.accepted", "m.metric", "m.overlap", F.array_join("m.matched_tokens", " ").alias("tokens"), F.array_join("m.matched_periods", "|").alias("found"))


_first = lambda c: f"list_filter({c}, lambda t, i: list_position({c}, t) = i)"
add(
    "str07_metric_period_match",
    _match,
    f"""WITH q AS (SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y, 'What was the total ' || o_orderpriority AS question, o_orderkey % 3 <> 0 AS dated,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Total for ' || year(o_orderdate) WHEN 2 THEN 'The total ' || o_orderpriority || ' of the year ' || year(o_orderdate) ELSE 'Total ' || o_orderpriority END AS context FROM orders),
t AS (SELECT *, {_tok('question')} AS l0, {_tok('context')} AS c FROM q), u AS (SELECT *, {_first('l0')} AS l FROM t),
h AS (SELECT *, list_filter(l, lambda t: list_contains(c, t)) AS hit, round(len(list_filter(l, lambda t: list_contains(c, t)))::DOUBLE / len(l), 6) AS overlap, dated AND contains(context, y) AS there FROM u),
z AS (SELECT *, CASE WHEN len(hit) < 1 THEN 'metric_not_matched' WHEN overlap < 0.5 THEN 'metric_overlap_below_threshold' WHEN NOT dated THEN 'missing_period_candidate' WHEN NOT there THEN 'period_not_matched' ELSE 'accepted' END AS reason FROM h)
SELECT o_orderkey, reason, reason = 'accepted' AS accepted, array_to_string(l, ' ') AS metric, overlap, array_to_string(hit, ' ') AS tokens, CASE WHEN there THEN y ELSE '' END AS found FROM z""",
)


def _located(s, d):
    part = table(s, d, "part").select("p_partkey", F.col("p_name").alias("text"), F.split("p_name", " ").alias("w"))
    spans = part.withColumn("at", t.word_spans(F.col("w"), F.col("text")))
    word = lambda w, i: F.struct(i.alias("index"), w.alias("text"), F.get("at", i).start.alias("char_start"), F.get("at", i).end.alias("char_end"), F.array(i * 10, F.lit(0), i * 10 + 9, F.lit(10)).alias("box"))
    blocks = spans.select(F.lit("d").alias("document_id"), F.col("p_partkey").cast("string").alias("block"), "text", F.transform("w", word).alias("words"), F.array(F.lit(0), F.lit(0), F.lit(999), F.lit(10)).alias("box"))
    k, first, second = F.col("p_partkey"), F.get("w", F.lit(0)), F.get("w", F.lit(1))
    a = F.length(first) + 1
    span = F.when(k % 7 == 2, F.array(F.lit(1))).when(k % 7 == 4, F.array(F.lit(1), F.lit(2))).when(k % 7 == 6, F.array(F.lit(500), F.lit(510))).otherwise(F.array(a, a + F.length(second)))
    key = F.when(k % 7 == 1, "none").otherwise(k.cast("string"))
    mapping = F.when(k % 7 == 0, F.array(F.create_map(key, span), F.create_map(key, span))).otherwise(F.array(F.create_map(key, span)))
    answer = F.when(k % 7 >= 5, "zzz").otherwise(second)
    questions = part.select(k.alias("question_id"), F.lit("d").alias("document_id"), mapping.alias("mapping"), answer.alias("answer"), F.array(F.lit(" ")).alias("facts"))
    return m.locate_evidence(questions, blocks).select("question_id", "status", "span_mode", "text", F.array_join("word_indices", ",").alias("words"), F.array_join("box", ",").alias("box"))


add(
    "join13_block_evidence",
    _located,
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 7 AS c, p_name, string_split(p_name, ' ')[2] AS w FROM part) SELECT k AS question_id,
CASE c WHEN 0 THEN 'mapping_not_unique' WHEN 1 THEN 'mapped_block_missing' WHEN 2 THEN 'mapped_span_invalid' WHEN 5 THEN 'accepted_fuzzy_text' WHEN 6 THEN 'accepted_block_only' ELSE 'accepted' END AS status,
CASE c WHEN 3 THEN 'char' WHEN 4 THEN 'word' WHEN 5 THEN 'char_fuzzy' WHEN 6 THEN 'block' END AS span_mode, CASE WHEN c IN (3, 4, 5) THEN w WHEN c = 6 THEN p_name END AS text,
CASE WHEN c IN (3, 4, 5) THEN '1' END AS words, CASE WHEN c IN (3, 4, 5) THEN '10,0,19,10' WHEN c = 6 THEN '0,0,999,10' END AS box FROM p""",
)
add("str22_words_text", lambda s, d: table(s, d, "part").select("p_partkey", m.words_text(F.transform(F.split("p_name", " "), lambda w: F.struct(F.concat(w, F.lit(" ")).alias("text")))).alias("t")), "SELECT p_partkey, p_name AS t FROM part")


def _labelled(s, d):
    f = lambda form: F.date_format("o_orderdate", form)
    c = _k() % 7
    period = F.when(c == 0, f("dd.MM.yy")).when(c == 1, f("M/yyyy")).when((c == 3) | (c == 6), "FY").when(c == 5, "LTM")
    return _orders(s, d).select("o_orderkey", m.period_label(period, F.when(c.isin(2, 6), f("MMM")), F.when(c.isin(2, 3, 6), f("yy"))).alias("label"))


add(
    "str17_period_labels",
    _labelled,
    "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%B 20%y') WHEN 1 THEN strftime(o_orderdate, '%B %Y') WHEN 2 THEN strftime(o_orderdate, '%B 20%y') WHEN 3 THEN 'FY 20' || strftime(o_orderdate, '%y') WHEN 4 THEN 'unspecified period' WHEN 5 THEN 'LTM' ELSE 'FY ' || strftime(o_orderdate, '%B 20%y') END AS label FROM orders",
)
_OUT = ("match", "mismatch", "match_word_set", "no_ocr_nearby", "match_scale_or_sign")
add("flt20_confirmed_pairs", lambda s, d: _orders(s, d).select("o_orderkey", m.confirmed_pair(_one_of(*_OUT), F.when(_k() % 3 != 0, "match")).alias("ok")), "SELECT o_orderkey, o_orderkey % 5 IN (0, 2, 4) AND o_orderkey % 3 <> 0 AS ok FROM orders")
_VERDICTS = f"""WITH {_I}, v AS (SELECT a.document_id, a.company, a.ordinal AS ordinal_a, b.ordinal AS ordinal_b, CASE WHEN a.y = b.y AND (a.period = 'Actual' AND b.period = 'Forecast' OR a.period = 'Forecast' AND b.period = 'Actual') THEN 'basis'
  WHEN a.period NOT IN ('FY', 'LTM', 'Q3') OR b.period NOT IN ('FY', 'LTM', 'Q3') THEN 'excluded' WHEN a.y = b.y AND a.m = b.m AND a.period = b.period AND NOT coalesce(abs(a.x - b.x) > 20, false) THEN 'identical' ELSE 'period' END AS verdict
  FROM i a JOIN i b ON a.document_id = b.document_id AND a.company = b.company AND a.ordinal < b.ordinal)"""


def _typed(s, d):
    found = p.instance_pairs(_instances(s, d))
    return m.typed_union(period=found.where("verdict = 'period'").drop("verdict"), basis=found.where("verdict = 'basis'").drop("verdict"))


add("set05_typed_pairs", _typed, f"{_VERDICTS} SELECT document_id, company, ordinal_a, ordinal_b, verdict AS pair_type FROM v WHERE verdict IN ('period', 'basis')")


def _kpi_questions(s, d):
    o = _orders(s, d).select((F.col("o_custkey") % 100).alias("document_id"), _k().alias("ordinal"), F.concat(F.lit("year "), F.year("o_orderdate").cast("string")).alias("label"), F.create_map(F.lit("sales"), (_k() % 17).cast("string"), F.when(_k() % 2 == 0, "profit").otherwise("loss"), (_k() % 19).cast("string")).alias("values"))
    outcomes = o.select("document_id", "ordinal", F.explode(F.array(F.lit("sales"), F.lit("profit"), F.lit("loss"))).alias("metric"), F.when(F.col("ordinal") % 5 == 0, "mismatch").otherwise("match").alias("outcome"))
    return m.instance_questions(_typed(s, d), o, outcomes, o.where("ordinal % 11 = 0").select("document_id", "ordinal"))


add(
    "join18_kpi_questions",
    _kpi_questions,
    f"""{_VERDICTS}, t AS MATERIALIZED (SELECT * FROM v WHERE verdict IN ('period', 'basis')), w AS MATERIALIZED (SELECT o_orderkey AS k, 'year ' || year(o_orderdate) AS label, unnest(['sales', CASE WHEN o_orderkey % 2 = 0 THEN 'profit' ELSE 'loss' END]) AS metric, unnest([(o_orderkey % 17)::VARCHAR, (o_orderkey % 19)::VARCHAR]) AS value FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0)
SELECT document_id, company, ordinal_a, ordinal_b, verdict AS pair_type, a.metric, 'What was ' || a.metric || ' in ' || a.label || '?' AS question_a, 'What was ' || a.metric || ' in ' || b.label || '?' AS question_b, a.value AS answer_a, b.value AS answer_b
FROM t JOIN w a ON a.k = ordinal_a JOIN w b ON b.k = ordinal_b AND a.metric = b.metric WHERE a.value <> b.value""",
)


def _fact_pairs(s, d):
    side = lambda c: F.concat_ws("/", "metric", "unit", f"period_{c}")
    pairs = p.period_pairs(facts(s, d), caps=False)
    return pairs.select("*", *(side(c).alias(f"fact_id_{c}") for c in "ab"), *(F.col("metric").alias(f"metric_{c}") for c in "ab"))


add(
    "prj10_pair_records",
    lambda s, d: m.pair_records(_fact_pairs(s, d), "tat_period", "primary", "period").drop("page_id"),
    f"""WITH {_PP}, r AS (SELECT *, concat_ws('/', metric, unit, period_a) AS fa, concat_ws('/', metric, unit, period_b) AS fb FROM pp)
SELECT format('tat_period_{{:06d}}', row_number() OVER (ORDER BY table_id, fa, fb) - 1) AS pair_id, 'period' AS pair_type, 'primary' AS subset, table_id::VARCHAR AS document_id, table_id::VARCHAR AS table_id,
fa AS question_a_id, 'What was ' || metric || ' in ' || period_a || '?' AS question_a, value_a::VARCHAR AS answer_a, value_a::VARCHAR AS normalized_answer_a, metric AS metric_a, period_a, unit AS unit_class_a,
fb AS question_b_id, 'What was ' || metric || ' in ' || period_b || '?' AS question_b, value_b::VARCHAR AS answer_b, value_b::VARCHAR AS normalized_answer_b, metric AS metric_b, period_b, unit AS unit_class_b,
'period' AS changed_dimension, CASE WHEN gap = 1 THEN 'adjacent' ELSE 'skip' END AS construction_rule, 'deterministic_template' AS question_generation_method, 'structurally_valid' AS validation_status FROM r""",
)


def _payloads(s, d):
    return _clean(s, d).select(F.col("vec_id").alias("group_id"), F.lit("clean").alias("variant"), F.lit("q").alias("question"), F.struct("evidence", "evidence_units", "answer", "image_path").alias("payload"))


_BOX = "a[3] > a[1] AND a[4] > a[2]"
add(
    "prj11_grounding_examples",
    lambda s, d: m.grounding_examples(_payloads(s, d)).select("group_id", "variant", "reason", "example.target_id", "example.row_header", "example.target"),
    f"""WITH {BOXES_SQL}, c AS (SELECT *, CASE WHEN vec_id % 4 = 0 THEN 'unknown_target' WHEN vec_id % 6 = 0 THEN 'unknown_column_header' WHEN NOT ({_BOX}) THEN 'invalid_bbox' WHEN vec_id % 7 = 0 THEN 'missing_answer' END AS reason FROM boxes)
SELECT vec_id AS group_id, 'clean' AS variant, reason, CASE WHEN reason IS NULL THEN 'u1' END AS target_id, CASE WHEN reason IS NULL THEN 't' END AS row_header,
CASE WHEN reason IS NULL THEN '<answer>1</answer>' || chr(10) || '<row>t</row>' || chr(10) || '<column>t</column>' || chr(10) || '<bbox>' || array_to_string(a, ' ') || '</bbox>' END AS target FROM c""",
)
add("flt18_valid_examples", lambda s, d: m.grounding_examples(_payloads(s, d)).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.count("example").alias("examples")), f"WITH {BOXES_SQL}, c AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 'unknown_target' WHEN vec_id % 6 = 0 THEN 'unknown_column_header' WHEN NOT ({_BOX}) THEN 'invalid_bbox' WHEN vec_id % 7 = 0 THEN 'missing_answer' ELSE 'valid' END AS reason FROM boxes) SELECT reason, count(*) AS n, count(*) FILTER (WHERE reason = 'valid') AS examples FROM c GROUP BY 1")
add(
    "join24_gold_overlap",
    lambda s, d: m.gold_overlap(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey") % 9)).alias("gold_ids"), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_suppkey") % 9)).alias("changed_ids"))).select("group_id", F.array_join("overlap", ",").alias("overlap")),
    "WITH x AS (SELECT l_orderkey, l_partkey % 9 AS id FROM lineitem WHERE l_linenumber <= 2 INTERSECT SELECT l_orderkey, l_suppkey % 9 FROM lineitem WHERE l_linenumber > 2) SELECT l_orderkey AS group_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS overlap FROM x GROUP BY 1",
)
add("str23_answer_target", lambda s, d: table(s, d, "part").select("p_partkey", m.answer_target(F.concat(F.lit(" \t "), "p_name", F.lit("  "))).alias("t")), "SELECT p_partkey, chr(9) || ' ' || p_name AS t FROM part")
add("str26_interval", lambda s, d: _orders(s, d).select("o_orderkey", m.interval_strategy(F.nullif(_one_of("", " Steps", "EPOCH", "true", "False", "no"), F.lit(""))).alias("t")), "SELECT o_orderkey, ['no', 'steps', 'epoch', 'steps', 'no', 'no'][(o_orderkey % 6 + 1)::INT] AS t FROM orders")
add("flt14_of_variants", lambda s, d: m.of_variants(_orders(s, d).select("o_orderkey", F.nullif(_one_of("", "clean", "header_address_swap", "null"), F.lit("null")).alias("variant")), ["clean"]).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 2")
add("join01_required", lambda s, d: m.required_join(table(s, d, "nation").select("n_nationkey", "n_name"), table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_name", "c_custkey"), "n_nationkey", "c_name", "c_custkey"), "SELECT n_nationkey, n_name, arg_max(c_name, c_custkey) AS c_name FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2")
_acc = lambda s, d: _orders(s, d).select("o_orderkey", "o_custkey", (_k() % 3 == 0).alias("accepted"))
add("srt06_first_accepted", lambda s, d: m.first_accepted(_acc(s, d), "o_custkey", 3, "o_orderkey").select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('3:' || o_orderkey), o_orderkey) = 1")
add("srt03_until_accepted", lambda s, d: m.until_accepted(_acc(s, d), "o_custkey", "o_orderkey", 2).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders QUALIFY coalesce(sum((o_orderkey % 3 = 0)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2")
add("srt05_by_gap_ratio", lambda s, d: gap_candidates(table(s, d, "events").select("user_id", "event_id", F.col("value").cast("decimal(18,4)").alias("c")), ["user_id"], "c", "event_id").withColumn("k", (F.col("largest") / F.col("median_other")).cast("double")).orderBy(F.desc("k"), "user_id").limit(10).select("user_id", F.round("k", 6).alias("k")), """WITH g AS (SELECT user_id, event_id, lead(c) OVER w - c AS gap, row_number() OVER w AS i FROM (SELECT *, value::DECIMAL(18,4) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY c, event_id)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC NULLS LAST, i) AS k FROM g),
p AS (SELECT user_id, count(*) AS rows, max(gap) AS largest, median(gap::DOUBLE) FILTER (WHERE k > 1) AS median_other FROM r GROUP BY 1) SELECT user_id, round(largest::DOUBLE / median_other, 6) AS k FROM p WHERE rows >= 3 AND median_other > 0 AND largest::DOUBLE >= median_other * 2.5 ORDER BY largest::DOUBLE / median_other DESC, user_id LIMIT 10""")


def _last_headers(s, d):
    h = t.with_headers(grid(s, d)).where((F.col("text") != "") & x.is_numeric(F.col("text")))
    last = lambda c: F.get(t.last_of(F.col(c), 1), F.lit(0)).text
    return h.select("table_id", "row_idx", "col_idx", last("row_headers").alias("metric"), last("column_headers").alias("period"))


_NUM = lambda c: f"regexp_matches({c}, '^\\(?-?[$£€]?\\s*\\d[\\d,]*(\\.\\d+)?%?\\)?$')"
add(
    "win08_last_headers",
    _last_headers,
    f"""WITH {GRID_SQL} SELECT c.table_id, c.row_idx, c.col_idx, (SELECT arg_max(h.text, h.col_idx) FROM grid h WHERE h.table_id = c.table_id AND h.row_idx = c.row_idx AND h.col_idx < c.col_idx AND h.text <> '' AND NOT {_NUM('h.text')}) AS metric,
(SELECT arg_max(h.text, h.row_idx) FROM grid h WHERE h.table_id = c.table_id AND h.col_idx = c.col_idx AND h.row_idx < c.row_idx AND regexp_matches(h.text, '\\b(19|20)\\d{{2}}\\b')) AS period FROM grid c WHERE c.text <> '' AND {_NUM('c.text')}""",
)

# Expressions and operators with a row of their own.
add("str02_slug", lambda s, d: table(s, d, "part").select("p_partkey", x.slug(F.when(F.col("p_partkey") % 9 == 0, "/#?").otherwise(F.concat(F.lit("~"), "p_type", F.lit(" & "), "p_name"))).alias("t")), "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'unknown' ELSE substr(regexp_replace(regexp_replace('~' || p_type || ' & ' || p_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) END AS t FROM part")
add("str03_number_text", lambda s, d: number_texts(s, d).select("id", x.number_text(F.col("a")).alias("t")), f"WITH {NUMBER_TEXTS_SQL}, t AS (SELECT id, trim(regexp_replace(lower(trim(a)), '[,$%]', '', 'g')) AS t FROM number_texts) SELECT id, CASE WHEN t LIKE '(%)' THEN '-' || trim(substr(t, 2, length(t) - 2)) ELSE t END AS t FROM t")
add("str04_scalar_answer", lambda s, d: _orders(s, d).select("o_orderkey", x.scalar_answer(F.when(_k() % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(_k() % 3 == 1, F.array(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))).otherwise(F.array(F.lit("  ")))).alias("t")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS t FROM orders")
add("str09_qualifiers", lambda s, d: _orders(s, d).select("o_orderkey", x.without_qualifiers(_one_of("adjusted ebitda", "net sales", "core operating profit", "reported core debt")).alias("base"), x.confusable(_one_of("Revenue", "Net  income", "Total debt", "Cash"), _one_of("net sales", "gross profit", "cash", "liquidity")).alias("near")), "SELECT o_orderkey, ['ebitda', 'net sales', 'operating profit', 'debt'][(o_orderkey % 4 + 1)::INT] AS base, o_orderkey % 4 <> 2 AS near FROM orders")
add("str10_remainder", lambda s, d: _orders(s, d).select("o_orderkey", x.temporal_remainder(F.concat(F.lit("Year ended "), F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(": "), F.lower("o_orderpriority"))).alias("t")), "SELECT o_orderkey, 'year ended ' || lower(o_orderpriority) AS t FROM orders")
add("str13_targets", lambda s, d: boxes(s, d).select("vec_id", x.evidence_first_target(F.col("a"), F.col("label").cast("string")).alias("t")), f"WITH {BOXES_SQL} SELECT vec_id, '<bbox>' || array_to_string(a, ' ') || '</bbox>' || chr(10) || '<answer>' || label || '</answer>' AS t FROM boxes")
add("str20_question_key", lambda s, d: table(s, d, "part").select("p_partkey", x.question_key(F.col("p_brand"), F.col("p_name"), F.lit(None).cast("string")).alias("k")), "SELECT p_partkey, substr(sha1(p_brand || chr(31) || p_name || chr(31)), 1, 20) AS k FROM part")
add("num03_same_number", lambda s, d: number_texts(s, d).select("id", n.same_number(F.col("a"), F.col("b")).alias("same")), f"WITH {NUMBER_TEXTS_SQL}, c AS (SELECT id, {_canonical('a')} AS a, {_canonical('b')} AS b FROM number_texts) SELECT id, coalesce(a = b, false) AS same FROM c")
add("num08_scale_shift", lambda s, d: _orders(s, d).select("o_orderkey", n.scale_shift((_k() * 10).cast("string"), F.when(_k() % 2 == 0, _k().cast("string")).otherwise((_k() * 7).cast("string"))).alias("t")), "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey <> 0 AS t FROM orders")
add("flt22_outcomes", lambda s, d: number_texts(s, d).select("id", n.same_number(F.col("a"), F.col("b")).alias("captured"), n.canonical(F.col("a")).isNotNull().alias("readable")), f"WITH {NUMBER_TEXTS_SQL}, c AS (SELECT id, {_canonical('a')} AS a, {_canonical('b')} AS b FROM number_texts) SELECT id, coalesce(a = b, false) AS captured, a IS NOT NULL AS readable FROM c")
add("flt11_numeric_texts", lambda s, d: number_texts(s, d).select("id", x.is_numeric(F.col("a")).alias("a"), x.is_numeric(F.col("b")).alias("b")), f"WITH {NUMBER_TEXTS_SQL} SELECT id, {_NUM('trim(a)')} AS a, {_NUM('trim(b)')} AS b FROM number_texts")
add("flt13_labels", lambda s, d: _orders(s, d).select("o_orderkey", x.is_degenerate(_one_of("--", "Sales", "(1)", " Total ", "1,234")).alias("a"), x.is_bare_total(_one_of("--", "Sales", "(1)", " Total ", "1,234")).alias("b"), x.is_numeric_label(_one_of("--", "Sales", "(1)", " Total ", "1,234")).alias("c"), x.is_footnote_copy(_one_of("Sales (1)", "Sales", "Costs 2"), F.lit("Sales")).alias("e")), "SELECT o_orderkey, o_orderkey % 5 = 0 AS a, o_orderkey % 5 = 3 AS b, o_orderkey % 5 IN (0, 2, 4) AS c, o_orderkey % 3 = 0 AS e FROM orders")
add("flt02_boxes", lambda s, d: boxes(s, d).select("vec_id", g.is_box(F.col("a")).alias("a"), g.is_box(F.slice("b", 1, 3)).alias("b")), f"WITH {BOXES_SQL} SELECT vec_id, {_BOX} AS a, false AS b FROM boxes")
add("geo03_union", lambda s, d: boxes(s, d).groupBy("label").agg(g.union_box(F.collect_list("a")).alias("u")).select("label", F.array_join("u", " ").alias("u")), f"WITH {BOXES_SQL} SELECT label, concat_ws(' ', min(a[1]), min(a[2]), max(a[3]), max(a[4])) AS u FROM boxes GROUP BY 1")
add("geo06_clamped", lambda s, d: boxes(s, d).select("vec_id", F.array_join(g.clamp_box(F.col("a"), F.lit(600), F.lit(400)), " ").alias("c"), F.array_join(g.pixel_box(F.transform("a", lambda v: v / 1000), F.lit(2000), F.lit(3000)), " ").alias("p")), f"WITH {BOXES_SQL} SELECT vec_id, concat_ws(' ', least(a[1], 600), least(a[2], 400), least(a[3], 600), least(a[4], 400)) AS c, concat_ws(' ', a[1] * 2, a[2] * 3, a[3] * 2, a[4] * 3) AS p FROM boxes")
add("geo04_turned", lambda s, d: boxes(s, d).select("vec_id", F.array_join(g.from_tlbr(*(F.col("b")[i] for i in range(4))), " ").alias("t")), f"WITH {BOXES_SQL} SELECT vec_id, concat_ws(' ', b[2], b[1], b[4], b[3]) AS t FROM boxes")
add("dat02_coarser", lambda s, d: _orders(s, d).select("o_orderkey", dt.coarser_date(F.date_format("o_orderdate", "MMMM d, yyyy"), F.when(_k() % 3 == 0, F.date_format("o_orderdate", "MMMM yyyy")).when(_k() % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("1901")).alias("t")), "SELECT o_orderkey, o_orderkey % 3 = 0 AND day(o_orderdate) <> 1 AS t FROM orders")
add("dat04_year_gap", lambda s, d: _orders(s, d).select("o_orderkey", dt.year_gap(x.first_year(F.concat(F.lit("FY "), F.date_format("o_orderdate", "yyyy"))), F.when(_k() % 4 != 0, F.lit(1995))).alias("t")), "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE abs(year(o_orderdate) - 1995) END::INT AS t FROM orders")
add("cmp01_values_match", lambda s, d: _orders(s, d).select("o_orderkey", dt.values_match(_one_of("monetary", "numerical", "text"), F.when(_k() % 3 == 2, "London, Paris").otherwise((_k() * 1000).cast("string")), F.when(_k() % 3 == 2, F.when(_k() % 2 == 0, "paris").otherwise("Rome")).otherwise(F.when(_k() % 2 == 0, _k().cast("string")).otherwise((_k() * 1000).cast("string")))).alias("t")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'granularity_mismatch' ELSE 'mismatch' END WHEN o_orderkey % 2 = 1 OR o_orderkey = 0 THEN 'match' WHEN o_orderkey % 3 = 0 THEN 'scale_mismatch' ELSE 'mismatch' END AS t FROM orders")
add("smp04_permutations", lambda s, d: table(s, d, "customer").select("c_custkey", F.array_join(sm.permutation(4, F.col("c_custkey"), F.lit(1)), ",").alias("t")), f"SELECT c_custkey, (SELECT string_agg(k, ',' ORDER BY sha256('4:' || c_custkey || ':1:' || k)) FROM (VALUES {', '.join(f'({k!r})' for k in sm.COUNTERFACTUALS)}) v(k)) AS t FROM customer")
add("prj07_packet_rule", lambda s, d: _orders(s, d).select("o_orderkey", r.metric_and_period(F.when(_k() % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.col("o_orderstatus"))), F.when(_k() % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("FY 1999"), F.lit("x")))).alias("m")).select("o_orderkey", "m.*"), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS metric, CASE WHEN o_orderkey % 7 <> 0 THEN 'FY 1999' END AS period FROM orders")
add("prj17_ids", lambda s, d: grid(s, d).select("table_id", "row_idx", "col_idx", t.cell_id(F.col("row_idx"), F.col("col_idx")).alias("a"), t.cell_id(F.col("row_idx"), F.col("col_idx"), True).alias("b")), f"WITH {GRID_SQL} SELECT table_id, row_idx, col_idx, format('r{{:02d}}c{{:02d}}', row_idx, col_idx) AS a, format('r{{:02d}}C{{:02d}}', row_idx, col_idx) AS b FROM grid")
add("prj19_stats_keys", lambda s, d: _orders(s, d).groupBy(F.concat(F.lit("rejected_"), "o_orderpriority").alias("k")).agg(F.count("*").alias("n")), "SELECT 'rejected_' || o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1")
