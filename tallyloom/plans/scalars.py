"""Queries over scalar expressions: numbers, texts, periods, labels, dates, boxes, tags and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import geometry as g
from ..functions import numbers as n
from ..functions import text as x
from .carriers import BOXES_SQL, NUMBER_TEXTS_SQL, boxes, number_texts, table

QUERIES, SQL = {}, {}


def add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


N = NUMBER_TEXTS_SQL


def _canonical(c):
    """DuckDB form of the canonical number of a text (ASCII)."""
    f = f"regexp_extract({c}, '\\(?-?[$£€]?\\s*\\d(?:[\\d,.\\s]*\\d)?%?\\)?')"
    bare = f"regexp_replace({f}, '[()$£€%\\s]', '', 'g')"
    body = f"regexp_replace({bare}, '^-', '')"
    drop = f"regexp_replace({body}, '[.,]', '', 'g')"
    tail = f"length(regexp_extract({body}, '[.,](\\d*)$', 1))"
    plain = f"CASE WHEN regexp_full_match({body}, '\\d{{1,3}}(,\\d{{3}})+|\\d{{1,3}}(\\.\\d{{3}})+') THEN {drop} WHEN contains({body}, ',') AND contains({body}, '.') THEN CASE WHEN {tail} = 3 THEN {drop} WHEN regexp_extract({body}, '([.,])\\d*$', 1) = '.' THEN replace({body}, ',', '') ELSE replace(replace({body}, '.', ''), ',', '.') END WHEN contains({body}, ',') THEN replace({body}, ',', '') ELSE {body} END"
    whole = f"regexp_replace(regexp_extract({plain}, '^(\\d+)', 1), '^0+(\\d)', '\\1')"
    part = f"regexp_replace(regexp_extract({plain}, '\\.(\\d+)$', 1), '0+$', '')"
    text = f"CASE WHEN {part} = '' THEN {whole} ELSE {whole} || '.' || {part} END"
    negative = f"(({bare} LIKE '-%') <> (trim({f}) LIKE '(%' AND trim({f}) LIKE '%)'))"
    return f"CASE WHEN regexp_full_match({plain}, '\\d+(\\.\\d+)?') THEN CASE WHEN {negative} THEN '-' ELSE '' END || {text} END"


add("num02_canonical", lambda s, d: number_texts(s, d).select("id", n.canonical(F.col("a")).alias("a"), n.canonical(F.col("b")).alias("b"), n.same_number(F.col("a"), F.col("b")).alias("same")), f"WITH {N}, c AS (SELECT id, {_canonical('a')} AS a, {_canonical('b')} AS b FROM number_texts) SELECT id, a, b, coalesce(a = b, false) AS same FROM c")
_strict = "CASE WHEN regexp_matches(trim(a), '^\\(?-?[$£€]?\\s*\\d[\\d,]*(\\.\\d+)?%?\\)?$') THEN CASE WHEN trim(a) LIKE '(%' AND trim(a) LIKE '%)' THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(a, '[,$£€%()\\s]', '', 'g') AS DOUBLE) END"
add("num01_strict_value", lambda s, d: number_texts(s, d).select("id", n.strict_value(F.col("a")).alias("v")), f"WITH {N} SELECT id, {_strict} AS v FROM number_texts")
_ocr = lambda c: f"round(TRY_CAST(trim(regexp_replace(replace(replace(trim(regexp_replace({c}, '[$€¥£,%]', '', 'g')), '(', '-'), ')', ''), '(?i)\\s*(bn|mn|tn|mm|kn|[bmktx])\\s*$', '')) AS DOUBLE), 2)"
add("num05_ocr_value", lambda s, d: number_texts(s, d).select("id", F.round(n.ocr_value(F.concat("b", F.lit("x"))), 2).alias("v")), f"WITH {N} SELECT id, {_ocr('b || chr(120)')} AS v FROM number_texts")
_num = lambda c: f"TRY_CAST({_canonical(c)} AS DOUBLE)"
_scale = " OR ".join(f"abs(r - {f!r}) <= {abs(f) * 0.02!r} OR abs(r - {1 / f!r}) <= {1 / f * 0.02!r}" for f in n.MONEY_FACTORS)
_shift = " OR ".join(f"abs(q - {k!r}) < 0.001" for k in n.SHIFTS)
add(
    "num07_scale_variants",
    lambda s, d: number_texts(s, d).select("id", n.money_scale(F.col("a"), F.col("b")).alias("money"), n.scale_shift(F.col("a"), F.col("b")).alias("shift")),
    f"WITH {N}, c AS (SELECT id, {_num('a')} AS x, {_num('b')} AS y FROM number_texts), r AS (SELECT id, CASE WHEN y <> 0 THEN x / y END AS r, CASE WHEN y <> 0 AND x <> 0 THEN x / y END AS q FROM c) SELECT id, coalesce({_scale}, false) AS money, coalesce({_shift}, false) AS shift FROM r",
)
_DRAW = lambda key: f"(('0x' || substr(sha256(id::VARCHAR || ':{key}'), 1, 12))::UBIGINT::DOUBLE / 281474976710656)"
add(
    "num04_counterfactual",
    lambda s, d: number_texts(s, d).select("id", n.counterfactual(F.col("b"), F.col("id").cast("string")).alias("c")),
    f"""WITH {N}, t AS (SELECT id, b, regexp_extract(b, '\\d[\\d,]*(?:\\.\\d+)?') AS digits, contains(b, '.') AS cents FROM number_texts), v AS (SELECT *, replace(digits, ',', '')::DOUBLE AS v, CASE WHEN cents THEN 0.01 ELSE 1 END AS unit FROM t),
m AS (SELECT *, greatest(round(v * (0.05 + 0.3 * {_DRAW('size')}) / unit) * unit, unit) AS delta, {_DRAW('sign')} AS draw FROM v), w AS (SELECT *, CASE WHEN draw < 0.5 OR v <= delta THEN v + delta ELSE v - delta END AS x FROM m),
f AS (SELECT *, CASE WHEN cents THEN format('{{:,.2f}}', x) ELSE format('{{:,}}', round(x)::BIGINT) END AS y FROM w)
SELECT id, CASE WHEN contains(digits, ',') OR v < 1000 THEN y ELSE replace(y, ',', '') END AS c FROM f""",
)
add("num09_rates", lambda s, d: table(s, d, "part").groupBy("p_size").agg(n.rate(F.count_if(F.col("p_retailprice") > 1500), F.count_if(F.col("p_partkey") % 3 == 0)).alias("r")).withColumn("g", F.round(n.geometric_mean(F.col("r"), F.lit(0.5), F.lit(0.2)), 9)), "WITH r AS (SELECT p_size, CASE WHEN count(*) FILTER (WHERE p_partkey % 3 = 0) <> 0 THEN count(*) FILTER (WHERE p_retailprice > 1500)::DOUBLE / count(*) FILTER (WHERE p_partkey % 3 = 0) END AS r FROM part GROUP BY 1) SELECT *, round(pow(r * 0.5 * 0.2, 1.0 / 3), 9) AS g FROM r")
add(
    "str01_normal_forms",
    lambda s, d: table(s, d, "part").select("p_partkey", x.compact(F.concat(F.lit("  "), "p_name", F.lit(" \t x "))).alias("compact"), x.normal(F.concat("p_type", F.lit("  Y"))).alias("normal"), x.slug(F.concat(F.lit("__"), "p_type", F.lit("/#"), "p_brand")).alias("slug"), x.number_text(F.concat(F.lit("(\'$"), F.col("p_size").cast("string"), F.lit("%)"))).alias("number")),
    "SELECT p_partkey, trim(regexp_replace(p_name || ' x', '\\s+', ' ', 'g')) AS compact, lower(trim(regexp_replace(p_type || '  Y', '\\s+', ' ', 'g'))) AS normal, regexp_replace(regexp_replace(p_type || '/#' || p_brand, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, '-''' || p_size AS number FROM part",
)
_tok = lambda c: f"list_filter([lower(regexp_replace(t, '^[''_-]+|[''_-]+$', '', 'g')) FOR t IN regexp_extract_all({c}, '[A-Za-z][A-Za-z&''-]*|\\d{{4}}')], lambda t: t <> '' AND NOT list_contains([{', '.join(repr(w) for w in x.STOPWORDS)}], t) AND NOT regexp_full_match(t, '\\d+'))"
_ord = lambda c: f"array_to_string([t FOR t, i IN {c} IF list_position({c}, t) = i], ' ')"
add(
    "str05_content_tokens",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(x.tokens(F.concat(F.lit("What was the Total "), "o_orderpriority", F.lit(" of "), "o_orderstatus", F.lit(" total ended 1998"))), " ").alias("t")),
    f"WITH q AS (SELECT o_orderkey, {_tok(chr(39) + 'What was the Total ' + chr(39) + ' || o_orderpriority || ' + chr(39) + ' of ' + chr(39) + ' || o_orderstatus || ' + chr(39) + ' total ended 1998' + chr(39))} AS l FROM orders) SELECT o_orderkey, array_to_string(list_filter(l, lambda t, i: list_position(l, t) = i), ' ') AS t FROM q",
)
add(
    "str06_periods",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(x.periods(F.concat(F.lit("from "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" to "), F.date_format("o_orderdate", "yyyy"), F.lit(" or the second quarter of "), F.date_format("o_orderdate", "yyyy"))), "|").alias("p"), x.period_in(F.date_format("o_orderdate", "MMM yyyy"), F.concat(F.lit("Dec 31, "), F.date_format("o_orderdate", "yyyy"))).alias("found"), x.temporal_remainder(F.concat(F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(" Actual;"))).alias("rest")),
    "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') || '|' || year(o_orderdate) || '|second quarter ' || year(o_orderdate) AS p, true AS found, 'actual' AS rest FROM orders",
)
_W = lambda c: f"list_distinct([t FOR t IN string_split({c}, ' ') IF length(t) > 1 AND NOT list_contains(['of', 'the', 'and', 'in', 'for', 'to', 'a', 'an'], t)])"
add(
    "str08_jaccard",
    lambda s, d: table(s, d, "part").select("p_partkey", F.round(x.jaccard(F.lower("p_type"), F.lower("p_name")), 9).alias("j"), x.without_qualifiers(F.concat(F.lit("adjusted "), F.lower("p_type"))).alias("base"), x.has_qualifier(F.lower("p_type")).alias("q")),
    f"SELECT p_partkey, round(CASE WHEN len({_W('lower(p_type)')}) = 0 OR len({_W('lower(p_name)')}) = 0 THEN 0 ELSE len(list_intersect({_W('lower(p_type)')}, {_W('lower(p_name)')}))::DOUBLE / len(list_distinct(list_concat({_W('lower(p_type)')}, {_W('lower(p_name)')}))) END, 9) AS j, lower(p_type) AS base, false AS q FROM part",
)
add("str11_unit_class", lambda s, d: table(s, d, "orders").select("o_orderkey", x.unit_class(F.when(F.col("o_orderkey") % 3 == 0, "12 %)").otherwise("12"), F.when(F.col("o_orderkey") % 5 == 0, "Net income per-share").otherwise("Net income"), F.when(F.col("o_orderkey") % 2 == 0, "usd")).alias("u"), x.is_unit_by_word(F.col("o_orderpriority")).alias("w"), x.is_unit_by_substring(F.col("o_orderpriority")).alias("m")), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'per_share' WHEN o_orderkey % 3 = 0 THEN 'percent' WHEN o_orderkey % 2 = 0 THEN 'usd' ELSE 'unscaled' END AS u, false AS w, contains(lower(o_orderpriority), 'm') AS m FROM orders")
add("str12_answers", lambda s, d: number_texts(s, d).select("id", x.answer_text(F.col("a")).alias("t"), x.same_answer(F.col("a"), F.concat(F.lit(" value: '"), F.upper("a"), F.lit("'"))).alias("same")), f"WITH {N} SELECT id, regexp_replace(a, '^Answer: ', '') AS t, a NOT LIKE 'Answer%' AS same FROM number_texts")
add("str15_variants", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", x.canonical_variant(F.element_at(F.array(*map(F.lit, ("Clean", "header swap", "IRRELEVANT_CELL", "target-value replacement", "new kind"))), (F.col("l_partkey") % 5 + 1).cast("int"))).alias("v"), "l_partkey"), "SELECT l_orderkey, l_linenumber, l_partkey, ['clean', 'header_address_swap', 'irrelevant_value', 'target_value', 'new kind'][(l_partkey % 5 + 1)::INT] AS v FROM lineitem")
_L = ("FY", "12M Budget", "LTM A", "Prior Qtr", "Quarter Ended", "e", "Estimates", "close", "Year-to-Date", "H1 2020")
add("str16_label_class", lambda s, d: table(s, d, "orders").select("o_orderkey", x.label_class(F.when(F.col("o_orderkey") % 11 != 10, F.element_at(F.array(*map(F.lit, _L)), (F.col("o_orderkey") % 10 + 1).cast("int")))).alias("c")), "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 10 THEN 'missing' ELSE ['actual_temporal', 'scenario_basis', 'scenario_basis', 'ambiguous_relative', 'actual_temporal', 'scenario_basis', 'unknown_other', 'ambiguous_relative', 'actual_temporal', 'actual_temporal'][(o_orderkey % 10 + 1)::INT] END AS c FROM orders")
add("str18_substitute", lambda s, d: table(s, d, "part").select("p_partkey", x.substitute(F.col("p_name"), F.lit("a"), F.lit("<>")).alias("q")), "SELECT p_partkey, CASE WHEN contains(p_name, 'a') THEN substr(p_name, 1, instr(p_name, 'a') - 1) || '<>' || substr(p_name, instr(p_name, 'a') + 1) END AS q FROM part")
add("str19_seeds_and_keys", lambda s, d: table(s, d, "orders").select("o_orderkey", x.stable_seed(42, F.col("o_orderkey").cast("string")).cast("string").alias("seed"), x.question_key(F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "c1")).alias("qk")), "SELECT o_orderkey, ('0x' || substr(sha256('42:' || o_orderkey), 1, 16))::UBIGINT::VARCHAR AS seed, substr(sha1(o_custkey || chr(31) || o_orderpriority || chr(31) || CASE WHEN o_orderkey % 2 = 0 THEN 'c1' ELSE '' END), 1, 20) AS qk FROM orders")
add(
    "str14_grounding_tags",
    lambda s, d: boxes(s, d).select("vec_id", x.grounding_target(F.col("label").cast("string"), F.lit("Row"), F.lit("Col"), F.col("a")).alias("t")).select("vec_id", x.tag(F.col("t"), "answer").alias("answer"), x.tag(F.col("t"), "row").alias("row"), x.tag(F.col("t"), "note").alias("note"), F.array_join(x.tag_box(F.col("t")), " ").alias("box"), x.box_before_answer(F.col("t")).alias("box_first")),
    f"WITH {BOXES_SQL} SELECT vec_id, label::VARCHAR AS answer, 'Row' AS row, NULL::VARCHAR AS note, CASE WHEN a[3] > a[1] AND a[4] > a[2] THEN array_to_string(a, ' ') END AS box, false AS box_first FROM boxes",
)
add("str24_list_parts", lambda s, d: table(s, d, "orders").select("o_orderkey", x.part_of_list(F.concat(F.col("o_orderstatus"), F.lit(", "), F.lower("o_orderpriority"), F.lit(" ,x")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.lit("F")).otherwise(F.substring("o_orderpriority", 3, 4))).alias("p")), "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN o_orderstatus = 'F' ELSE lower(substr(o_orderpriority, 3, 4)) IN (lower(o_orderstatus), lower(o_orderpriority), 'x') END AS p FROM orders")
add("str25_formats", lambda s, d: table(s, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m"), F.stddev_samp("s_acctbal").alias("s")).select("s_nationkey", x.mean_text(F.round("m"), F.lit(0.5)).alias("t")), "SELECT s_nationkey, format('{:.3f} ± 0.500', round(avg(s_acctbal))) AS t FROM supplier GROUP BY 1")
_FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM-yy", "MMMM yyyy", "yyyy")


def _dates(s, d):
    k = F.col("o_orderkey") % 8
    text = F.coalesce(*(F.when(k == i, F.date_format("o_orderdate", f)) for i, f in enumerate(_FORMS)))
    return table(s, d, "orders").select("o_orderkey", text.alias("t"), F.date_format("o_orderdate", "MMMM dd, yyyy").alias("full"))


_D = """dates AS (SELECT o_orderkey, o_orderdate::DATE AS d0, CASE WHEN o_orderkey % 8 < 5 THEN o_orderdate::DATE WHEN o_orderkey % 8 < 7 THEN date_trunc('month', o_orderdate)::DATE ELSE date_trunc('year', o_orderdate)::DATE END AS d,
  CASE WHEN o_orderkey % 8 < 5 THEN 'day' WHEN o_orderkey % 8 < 7 THEN 'month' ELSE 'year' END AS precision FROM orders)"""
add("dat01_loose_dates", lambda s, d: _dates(s, d).select("o_orderkey", F.date_format(dt.loose_date(F.col("t")).d, "yyyy-MM-dd").alias("d"), dt.loose_date(F.col("t")).precision.alias("precision"), dt.coarser_date(F.col("full"), F.col("t")).alias("coarser")), f"WITH {_D} SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS d, precision, precision <> 'day' AND d <> d0 AS coarser FROM dates")
add("dat03_years_and_months", lambda s, d: table(s, d, "orders").select("o_orderkey", dt.whole_year(F.date_format("o_orderdate", "yy")).alias("y"), dt.month_number(F.date_format("o_orderdate", "MMM")).alias("m"), dt.month_number(F.upper(F.date_format("o_orderdate", "MMMM"))).alias("m2"), dt.year_gap(F.year("o_orderdate"), F.lit(1995)).alias("gap")), "SELECT o_orderkey, strftime(o_orderdate, '20%y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%m') AS m2, abs(year(o_orderdate) - 1995)::INT AS gap FROM orders")
_I = "greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0)"
_A = lambda c: f"greatest({c}[3] - {c}[1], 0) * greatest({c}[4] - {c}[2], 0)"
add("geo05_iou", lambda s, d: boxes(s, d).select("vec_id", F.round(g.iou(F.col("a"), F.col("b")), 9).alias("iou"), F.array_join(g.union_box(F.array("a", "b")), " ").alias("around"), g.is_box(F.col("a")).alias("fine")), f"WITH {BOXES_SQL} SELECT vec_id, round(CASE WHEN {_A('a')} + {_A('b')} - {_I} > 0 THEN ({_I})::DOUBLE / ({_A('a')} + {_A('b')} - {_I}) ELSE 0 END, 9) AS iou, concat_ws(' ', least(a[1], b[1]), least(a[2], b[2]), greatest(a[3], b[3]), greatest(a[4], b[4])) AS around, a[3] > a[1] AND a[4] > a[2] AS fine FROM boxes")
add(
    "geo02_scaled_boxes",
    lambda s, d: boxes(s, d).select("vec_id", F.array_join(g.grid_box(g.unit_box(F.col("a"), F.lit(1000.0), F.lit(1000.0))), " ").alias("back"), F.array_join(g.padded_box(F.col("b"), 8, F.lit(1000), F.lit(900)), " ").alias("padded"), F.array_join(g.from_tlbr(F.col("a")[0], F.col("a")[1], F.col("a")[2], F.col("a")[3]), " ").alias("turned"), F.array_join(F.coalesce(g.whole_box(F.transform("a", lambda v: v / 2), True), F.array().cast("array<int>")), " ").alias("halves")),
    f"WITH {BOXES_SQL} SELECT vec_id, array_to_string(a, ' ') AS back, concat_ws(' ', greatest(b[1] - 8, 0), greatest(least(b[2] - 8, 900), 0), least(b[3] + 8, 1000), least(b[4] + 8, 900)) AS padded, concat_ws(' ', a[2], a[1], a[4], a[3]) AS turned, CASE WHEN round_even(a[3] / 2, 0) > round_even(a[1] / 2, 0) AND round_even(a[4] / 2, 0) > round_even(a[2] / 2, 0) THEN array_to_string([round_even(v / 2, 0)::INT FOR v IN a], ' ') ELSE '' END AS halves FROM boxes",
)


def _units(s, d):
    b = boxes(s, d)
    u = F.array(F.struct(F.lit("first").alias("id"), F.col("a").alias("box")), F.struct(F.lit("second").alias("id"), F.col("b").alias("box")), F.struct(F.lit("page").alias("id"), F.array(*map(F.lit, (0, 0, 1000, 1000))).alias("box")))
    return b.select("vec_id", g.unit_at(u, F.col("b"), F.when(F.col("vec_id") % 2 == 0, "second").otherwise("none")).alias("unit"))


add("join07_unit_at_point", _units, f"WITH {BOXES_SQL} SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'second' WHEN (b[1] + b[3]) / 2 BETWEEN a[1] AND a[3] AND (b[2] + b[4]) / 2 BETWEEN a[2] AND a[4] THEN 'first' ELSE 'second' END AS unit FROM boxes")
