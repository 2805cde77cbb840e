"""Queries over sources, sinks and streams: what is written from the supplied tables is read back through the engine's own readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import pairs as p
from ..operators import quality as q
from ..operators import records as rec
from ..operators import sampling as sm
from ..operators import tables as t
from ..operators.results import result_rows
from ..operators.shared import fresh, pieces, written
from ..functions.text import UNIT_SUBSTRINGS, evidence_first_target, grounding_target, is_unit_by_substring, is_unit_by_word, period_key
from ..sources import frozen, hosted, readers, sinks
from ..streaming import visits
from .auditing import _SCH, _groups
from .carriers import BOXES_SQL, OUTCOMES_SQL, boxes, outcomes, table

QUERIES, SQL = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


#: Documents of one array file.
EACH = 20_000
_DOC = "struct<doc_id:bigint,lang:string,text:string>"


def _arrays(s, d):
    path = fresh(s, "arrays")
    sinks.json_arrays(table(s, d, "documents").select("doc_id", "lang", "text", F.floor(F.col("doc_id") / EACH).alias("file")), path, "file", "doc_id")
    got = readers.json_elements(s, f"{path}/*/*.txt", _DOC)
    return got.select(F.regexp_extract("file", r"/file=(\d+)/", 1).cast("bigint").alias("file"), "ordinal", "doc.doc_id", F.coalesce("doc.lang", F.lit("")).alias("lang"), F.md5(F.coalesce("doc.text", F.lit(""))).alias("text"))


add("src02_json_elements", _arrays, f"SELECT doc_id // {EACH} AS file, row_number() OVER (PARTITION BY doc_id // {EACH} ORDER BY doc_id) - 1 AS ordinal, doc_id, coalesce(lang, '') AS lang, md5(coalesce(text, '')) AS text FROM documents")


def _hosted(s, d):
    path = fresh(s, "hosted")
    hosted.publish(table(s, d, "documents").select("doc_id", "lang", "text"), ["doc_id"], path, 25_000)
    return hosted.hosted_rows(s, path, ["doc_id", "text", hosted.INDEX]).select("source_index", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


add("src09_hosted_rows", _hosted, "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS source_index, doc_id, md5(coalesce(text, '')) AS text FROM documents")


def _resumed(s, d):
    path, out, checkpoint = fresh(s, "hosted"), fresh(s, "streamed"), fresh(s, "offsets")
    docs = table(s, d, "documents").select("doc_id", "source", "n_chars")
    for part in (0, 1):  # what is published while the stream is down is all that it reads when it comes back
        hosted.publish(docs.where(F.col("doc_id") % 2 == part), ["doc_id"], path, 25_000)
        visits.append_batches(hosted.hosted_stream(s, path), out, checkpoint).awaitTermination()
    return s.read.parquet(out).select("batch", "source_index", "doc_id", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


add("src09_hosted_stream", _resumed, "SELECT (doc_id % 2)::INT AS batch, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS source_index, doc_id, source, n_chars::BIGINT AS n_chars FROM documents")


def _visit_state(s, d):
    groups = table(s, d, "documents").select("doc_id", F.concat(F.lit("g"), F.floor(F.col("doc_id") / 8).cast("string")).alias("group_id"))
    outs, state, checkpoint = [], None, None
    for part in (0, 1):  # the second stream knows of the first only what its state says
        source, out, checkpoint = fresh(s, "requests"), fresh(s, "visits"), fresh(s, "visit-state")
        groups.where(F.col("doc_id") % 2 == part).select("group_id").write.parquet(source)
        visits.append_batches(visits.count_visits(s.readStream.schema("group_id string").parquet(source), state), out, checkpoint).awaitTermination()
        outs.append(s.read.parquet(out).select("group_id", "visit_no", F.lit(part).alias("part")))
        state = written(visits.visit_counts(s, checkpoint), "visit-counts")
    seen = outs[0].unionByName(outs[1]).groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("visit_no").alias("numbers"), F.max("visit_no").alias("last"), F.min(F.when(F.col("part") == 1, F.col("visit_no"))).alias("went_on_from"))
    return seen.join(state, "group_id").select("group_id", "visits", "n", "numbers", "last", "went_on_from")


add("smp05_visit_state", _visit_state, "SELECT 'g' || (doc_id // 8) AS group_id, count(*) AS visits, count(*) AS n, count(*) AS numbers, count(*) - 1 AS last, CASE WHEN count(*) FILTER (WHERE doc_id % 2 = 1) > 0 THEN count(*) FILTER (WHERE doc_id % 2 = 0) END AS went_on_from FROM documents GROUP BY 1")


def _pairs(s, d):
    o = outcomes(s, d)
    return o.select(
        F.concat(F.lit("p"), F.col("pair_id").cast("string")).alias("pair_id"), F.when(F.col("n") % 3 == 0, "period_derived").when(F.col("n") % 3 == 1, "metric_candidate").otherwise("human_authored").alias("subset"), F.when(F.col("n") % 13 == 0, "other").when(F.col("n") % 2 == 0, "period").otherwise("metric").alias("pair_type"),
        F.col("document_id").alias("document_a"), F.when(F.col("n") % 17 == 0, F.lit("elsewhere")).otherwise(F.col("document_id")).alias("table_a"), F.col("pair_id").cast("string").alias("question_a"), F.when(F.col("n") % 11 == 0, F.col("pair_id").cast("string")).otherwise(F.concat(F.col("pair_id").cast("string"), F.lit("b"))).alias("question_b"),
        (F.col("n") % 5).alias("answer_a"), (F.col("n") % 7).alias("answer_b"), F.when(F.col("n") % 19 != 0, "e").alias("evidence_a"), F.lit("e").alias("evidence_b"),
    )


def _subsets(s, d):
    path = fresh(s, "subsets")
    frozen.freeze_subsets(_pairs(s, d), path, 5, 20, protocol_version="v1")
    summary = frozen.committed(s, path, "summary", "subset string, pair_type string, total long, documents long, most long").select("subset", F.concat(F.lit("total:"), F.coalesce("pair_type", F.lit("all"))).alias("what"), F.col("total").alias("n"))
    rules = frozen.committed(s, path, "validation", "subset string, rule string, violations long").select("subset", F.concat(F.lit("rule:"), "rule").alias("what"), F.col("violations").alias("n"))
    rows = frozen.committed(s, path, "pairs", "subset string, pair_id string").select("subset", F.concat(F.lit("pair:"), "pair_id").alias("what"), F.lit(1).cast("bigint").alias("n"))
    audit = frozen.committed(s, path, "sample", "subset string, pair_id string").select("subset", F.concat(F.lit("sample:"), "pair_id").alias("what"), F.lit(1).cast("bigint").alias("n"))
    return summary.unionByName(rules).unionByName(rows).unionByName(audit)


_RULES = {"duplicate_id": "false", "self_pair": "n % 11 = 0", "reversed_duplicate": "false", "identical_answers": "n % 5 = n % 7", "document_not_table": "n % 17 = 0", "missing_evidence": "n % 19 = 0", "bad_type": "n % 13 = 0"}
add(
    "snk05_frozen_subsets",
    _subsets,
    f"""WITH {OUTCOMES_SQL}, p AS (SELECT *, CASE n % 3 WHEN 0 THEN 'period_derived' WHEN 1 THEN 'metric_candidate' ELSE 'human_authored' END AS subset, CASE WHEN n % 13 = 0 THEN 'other' WHEN n % 2 = 0 THEN 'period' ELSE 'metric' END AS pair_type FROM outcomes)
SELECT subset, 'total:' || pair_type AS what, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT subset, 'total:all', count(*) FROM p GROUP BY ALL UNION ALL SELECT subset, 'pair:p' || pair_id, 1 FROM p
UNION ALL SELECT subset, 'sample:p' || pair_id, 1 FROM p QUALIFY row_number() OVER (PARTITION BY subset ORDER BY sha256('5:p' || pair_id), 'p' || pair_id) <= 20
{' '.join(f"UNION ALL SELECT subset, 'rule:{k}', count(*) FILTER (WHERE {c}) FROM p GROUP BY ALL" for k, c in _RULES.items())}""",
)


def _frozen_rows(s, d):
    """A fifth of the pairs, by digest, frozen and read back."""
    path = fresh(s, "frozen")
    rows = _pairs(s, d).select("pair_id", F.col("table_a").alias("table_id"), F.when(F.col("pair_type") == "period", "adjacent").otherwise("skip").alias("construction_rule"))
    frozen.freeze(rows, p.primary_selection(rows.select("pair_id", "table_id", F.col("pair_id").alias("metric"), F.col("construction_rule").alias("rule")), 3, 40, 60, 30), path, seed=3)
    return frozen.committed(s, path, "rows", "pair_id string, table_id string, construction_rule string")


add(
    "snk06_frozen_rows",
    _frozen_rows,
    f"""WITH {OUTCOMES_SQL}, p AS (SELECT 'p' || pair_id AS pair_id, CASE WHEN n % 17 = 0 THEN 'elsewhere' ELSE document_id END AS table_id, CASE WHEN n % 13 <> 0 AND n % 2 = 0 THEN 'adjacent' ELSE 'skip' END AS construction_rule FROM outcomes),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY sha256('3:table:' || pair_id), pair_id) <= 40)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY construction_rule ORDER BY sha256('3:all:' || pair_id), pair_id) <= CASE construction_rule WHEN 'adjacent' THEN 60 ELSE 30 END""",
)


def _examples(s, d, evidence_first):
    k, b = F.col("vec_id"), F.col("b")
    gold = F.concat((k % 900 + 100).cast("string"), F.lit(".0"))
    said = F.when(k % 3 == 0, gold).when(k % 3 == 1, (k % 900 + 100).cast("string")).otherwise("none")
    text = evidence_first_target(b, said) if evidence_first else grounding_target(said, F.when(k % 4 == 0, "  NET  sales ").otherwise("Costs"), F.lit("2019"), b)
    unit = lambda i, x: F.struct(F.lit(i).alias("id"), x.alias("box"))
    return boxes(s, d).select(
        k.alias("group_id"), F.col("label").alias("table_id"), F.when(k % 2 == 0, "Header Swap").otherwise("clean").alias("variant"), F.lit("q").alias("question"), gold.alias("answer"), F.lit("Net Sales").alias("row_header"), F.lit("2019").alias("column_header"),
        F.lit("u2").alias("target_id"), F.col("a").alias("box"), F.transform("a", lambda x: x / 1000.0).alias("share"), F.lit(2000).alias("width"), F.lit(500).alias("height"), F.array(unit("u1", F.col("b")), unit("u2", F.col("a"))).alias("units"), F.when(k % 7 != 0, text).otherwise(F.lit("no tags")).alias("prediction"),
    )


def _scored(s, d, evidence_first):
    r = result_rows(_examples(s, d, evidence_first), evidence_first)
    extra = ["bbox_before_answer"] if evidence_first else ["predicted_row", "row_correct", "column_correct"]
    return r.select("group_id", "variant", "prediction_answer", "answer_correct", "exact_correct", *extra, F.array_join("gold_bbox_pixel", " ").alias("pixels"), F.array_join(F.coalesce("predicted_bbox", F.array().cast("array<int>")), " ").alias("predicted"), "predicted_bbox_valid", F.round("bbox_iou", 9).alias("bbox_iou"), "predicted_cell_id", "cell_correct")


def _scored_sql(evidence_first):
    fine = "vec_id % 7 <> 0 AND b[3] > b[1] AND b[4] > b[2]"
    inter = "greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0)"
    area = lambda x: f"greatest({x}[3] - {x}[1], 0) * greatest({x}[4] - {x}[2], 0)"
    inside = "(b[1] + b[3]) / 2 BETWEEN a[1] AND a[3] AND (b[2] + b[4]) / 2 BETWEEN a[2] AND a[4]"
    extra = "CASE WHEN vec_id % 7 <> 0 THEN true END AS bbox_before_answer" if evidence_first else "CASE WHEN vec_id % 7 <> 0 THEN CASE WHEN vec_id % 4 = 0 THEN 'NET  sales' ELSE 'Costs' END END AS predicted_row, vec_id % 7 <> 0 AND vec_id % 4 = 0 AS row_correct, vec_id % 7 <> 0 AS column_correct"
    return f"""WITH {BOXES_SQL} SELECT vec_id AS group_id, CASE vec_id % 2 WHEN 0 THEN 'header_address_swap' ELSE 'clean' END AS variant,
CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 3 = 0 THEN (vec_id % 900 + 100) || '.0' WHEN vec_id % 3 = 1 THEN (vec_id % 900 + 100)::VARCHAR ELSE 'none' END AS prediction_answer,
vec_id % 7 <> 0 AND vec_id % 3 < 2 AS answer_correct, vec_id % 7 <> 0 AND vec_id % 3 = 0 AS exact_correct, {extra},
concat_ws(' ', round_even(a[1] / 1000.0 * 2000, 0)::INT, round_even(a[2] / 1000.0 * 500, 0)::INT, round_even(a[3] / 1000.0 * 2000, 0)::INT, round_even(a[4] / 1000.0 * 500, 0)::INT) AS pixels,
CASE WHEN {fine} THEN array_to_string(b, ' ') ELSE '' END AS predicted, {fine} AS predicted_bbox_valid,
round(CASE WHEN {fine} AND {area('a')} + {area('b')} - {inter} > 0 THEN ({inter})::DOUBLE / ({area('a')} + {area('b')} - {inter}) ELSE 0 END, 9) AS bbox_iou,
CASE WHEN {fine} THEN CASE WHEN {inside} THEN 'u2' ELSE 'u1' END END AS predicted_cell_id, coalesce({fine} AND {inside}, false) AS cell_correct FROM boxes"""


add("prj13_result_rows", lambda s, d: _scored(s, d, False), _scored_sql(False))
add("prj13_evidence_first_rows", lambda s, d: _scored(s, d, True), _scored_sql(True))
add(
    "str21_source_keys",
    lambda s, d: table(s, d, "documents").select("doc_id", rec.source_index(F.format_string("syn_%06d_%s", F.col("doc_id"), "source")).alias("source_index"), rec.source_table_key(F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.lit("")), F.col("doc_id")).alias("table_key")),
    "SELECT doc_id, lpad(doc_id::VARCHAR, greatest(6, len(doc_id::VARCHAR))::INT, '0') AS source_index, CASE WHEN doc_id % 3 = 0 AND source <> '' THEN 'id:' || source ELSE 'index:' || doc_id END AS table_key FROM documents",
)


def _packets(s, d):
    """A packet a row: the numbers of a vector's two boxes as cells, and patches of some of them, repeated ones included."""
    k = F.col("vec_id")
    cell = lambda i, t, x: F.struct(F.lit(f"c{i}").alias("cell_id"), t.alias("text"), F.transform(x, lambda v: v + 0.5).alias("bbox"))
    cells = F.array(cell(0, F.col("label").cast("string"), F.col("a")), cell(1, F.lit(None).cast("string"), F.col("b")), cell(2, k.cast("string"), F.col("b")))
    patch = lambda i, t: F.struct(i.alias("cell_id"), t.alias("new_text"))
    patches = F.array(patch(F.lit("c2"), F.lit("first")), patch(F.when(k % 2 == 0, "c0"), F.lit("lost")), patch(F.lit("c2"), F.when(k % 3 != 0, "last")), patch(F.lit("c9"), F.lit("x")))
    return boxes(s, d).select("vec_id", rec.patched(F.transform(cells, rec.packet_cell), patches).alias("cells"))


add(
    "prj19_patched_cells",
    lambda s, d: _packets(s, d).select("vec_id", F.explode("cells").alias("c")).select("vec_id", "c.cell_id", "c.text", F.array_join("c.bbox", " ").alias("box")),
    f"""WITH {BOXES_SQL} SELECT vec_id, 'c0' AS cell_id, CASE WHEN vec_id % 2 = 0 THEN 'lost' ELSE coalesce(label::VARCHAR, '') END AS text, array_to_string(a, ' ') AS box FROM boxes
UNION ALL SELECT vec_id, 'c1', '', array_to_string(b, ' ') FROM boxes UNION ALL SELECT vec_id, 'c2', CASE WHEN vec_id % 3 <> 0 THEN 'last' ELSE '' END, array_to_string(b, ' ') FROM boxes""",
)


def _lines(s, d):
    path = fresh(s, "lines")
    sinks.json_lines(table(s, d, "documents").select("doc_id", "lang", "text"), path, F.col("doc_id").isNotNull())
    return readers.json_lines(s, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


add("src01_json_lines", _lines, "SELECT doc_id, lang, md5(coalesce(text, '')) AS text FROM documents")


def _blocks(s, d):
    """Documents as one page of blocks, a block a line and every seventh without an id, as JSON lines and back."""
    path = fresh(s, "paged")
    block = lambda x, i: F.struct(F.when(i % 7 != 6, F.concat_ws("-", F.col("doc_id").cast("string"), i.cast("string"))).otherwise(" ").alias("uuid"), i.alias("order"), x.alias("text"), F.array(i, i, i + 1, i + 1).alias("bbox"))
    page = F.struct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), block).alias("blocks"))
    sinks.json_lines(table(s, d, "documents").select("doc_id", F.array(page).alias("pages")), path)
    docs = readers.json_lines(s, path, "doc_id long, pages array<struct<blocks:array<struct<uuid:string,`order`:int,text:string,bbox:array<int>>>>>")
    return readers.block_index(docs).select("doc_id", "page", "uuid", F.md5("text").alias("text"), F.col("bbox")[3].alias("bottom"))


add(
    "src05_block_index",
    _blocks,
    "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), b AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS i FROM l) SELECT doc_id, 0 AS page, doc_id || '-' || i AS uuid, md5(text) AS text, (i + 1)::INT AS bottom FROM b WHERE i % 7 <> 6",
)


def _spans(s, d):
    words = F.split("p_name", " ")
    missing = F.transform(words, lambda w, i: F.when(i == 2, F.concat(w, F.lit("?"))).otherwise(w))
    spans = table(s, d, "part").select("p_partkey", F.posexplode(t.word_spans(missing, F.col("p_name"))).alias("i", "w"))
    return spans.select("p_partkey", "i", "w.start", "w.end")


add(
    "src06_word_spans",
    _spans,
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), e AS (SELECT p_partkey, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
s AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e)
SELECT p_partkey, i::INT AS i, (CASE WHEN i = 2 THEN -1 ELSE pos END)::INT AS start, (CASE WHEN i = 2 THEN -1 ELSE pos + length(word) END)::INT AS "end" FROM s""",
)


def _labelled(s, d):
    """A table a brand with a row a part: its name in words and its type."""
    word = lambda w: F.struct(F.concat(F.lit(" "), w).alias("text"), F.array(F.lit(0)).alias("bbox"))
    cell = lambda c, label: F.struct(F.col(c).alias("text"), F.lit(label).alias("label"), F.array(F.lit(1)).alias("bbox"), F.transform(F.split(c, " "), word).alias("words"))
    rows = table(s, d, "part").groupBy(F.col("p_brand").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.array(cell("p_name", "name"), cell("p_type", "type")).alias("cells")))).alias("rows"))
    cells, words = t.flatten_table(rows)
    return words.join(cells.withColumnRenamed("text", "cell_text"), ["table_id", "row_idx", "col_idx"]).select("table_id", "row_idx", "col_idx", F.col("word_idx").cast("bigint").alias("word_idx"), "text", "label", "cell_text")


add(
    "src07_labelled_words",
    _labelled,
    """WITH r AS (SELECT p_brand AS table_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_idx, p_name, p_type FROM part),
c AS (SELECT table_id, row_idx, 0 AS col_idx, 'name' AS label, p_name AS cell_text FROM r UNION ALL SELECT table_id, row_idx, 1, 'type', p_type FROM r),
w AS (SELECT *, unnest(string_split(cell_text, ' ')) AS text, unnest(range(len(string_split(cell_text, ' ')))) AS i FROM c)
SELECT table_id, row_idx::INT AS row_idx, col_idx, row_number() OVER (PARTITION BY table_id ORDER BY row_idx, col_idx, i) - 1 AS word_idx, text, label, cell_text FROM w""",
)


def _export(s, d):
    """Orders as annotation lines: those of every third order belong to no group, some values are blank."""
    path, k = fresh(s, "export"), F.col("o_orderkey")
    values = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority")))
    rows = table(s, d, "orders").select(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("document_id"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("page_id"), F.when(k % 3 != 0, "company").alias("group"), k.alias("instance_index"), F.when(k % 7 != 0, values).otherwise(F.create_map(F.lit("status"), F.lit(""))).alias("values"))
    sinks.json_lines(rows, path)
    return readers.json_lines(s, path, "document_id string, page_id string, `group` string, instance_index long, values map<string,string>").withColumn("boxes", F.lit(None).cast("map<string,array<int>>"))


add(
    "src13_document_fields",
    lambda s, d: readers.document_fields(_export(s, d)).select("document_id", "instance_index", F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat_ws("=", e.key, e.value)), ",").alias("fields")),
    "SELECT 'd' || o_custkey AS document_id, o_orderkey AS instance_index, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'priority=' || o_orderpriority || ',' END || 'status=' || o_orderstatus AS fields FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0",
)
add("src14_page_ids", lambda s, d: readers.page_ids(_export(s, d)), "SELECT DISTINCT 'd' || o_custkey AS document_id, 'p' || o_orderkey % 3 AS page_id FROM orders")


def _manifest(s, d):
    path = fresh(s, "manifest")
    table(s, d, "supplier").select("s_suppkey", "s_name").orderBy(F.desc("s_acctbal"), "s_suppkey").coalesce(1).write.json(path)
    return readers.manifest(s, path, "s_suppkey long, s_name string", 50).select("ordinal", "s_suppkey", "s_name")


add("src18_manifest", _manifest, "SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS ordinal, s_suppkey, s_name FROM supplier ORDER BY ordinal LIMIT 50")


#: Bytes of line items behind one task that writes predictions of them.
PREDICTED_BYTES = 8 << 20


def _labels(s, d):
    """Lines of predictions below a folder a label, an order's lines in one file and in order of their numbers."""
    path = fresh(s, "predicted")
    line = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("group_id"), F.when(F.col("l_orderkey") % 4 != 0, F.concat(F.lit("d"), (F.col("l_orderkey") % 9).cast("string"))).alias("document_id"), F.col("l_linenumber").cast("string").alias("prediction")))
    items = table(s, d, "lineitem")
    rows = items.select(F.col("l_returnflag").alias("label"), "l_orderkey", "l_linenumber", line.alias("value"))
    rows.repartition(pieces(items, PREDICTED_BYTES), "l_orderkey").sortWithinPartitions("label", "l_orderkey", "l_linenumber").select("label", "value").write.partitionBy("label").text(path)
    return readers.predictions(s, path, "group_id string, document_id string, prediction string", "*.txt")


_LAST = "SELECT l_returnflag AS label, l_orderkey::VARCHAR AS group_id, CASE WHEN l_orderkey % 4 <> 0 THEN 'd' || l_orderkey % 9 END AS document_id, max(l_linenumber)::VARCHAR AS prediction FROM lineitem GROUP BY ALL"
add("src19_predictions", _labels, _LAST)
# predictions have a row for each group of a label, so a count of groups is one of distinct groups
add("src20_scored", lambda s, d: readers.scored(_labels(s, d)).groupBy("label", "document_id").agg(F.count("*").alias("n"), F.count("group_id").alias("groups")), f"SELECT label, document_id, count(*) AS n, count(DISTINCT group_id) AS groups FROM ({_LAST}) WHERE document_id IS NOT NULL GROUP BY ALL")

#: Half of all documents are one group, the others groups of twenty; groups of more rows than this are scanned in ranges.
HOT = 200
_hot = lambda s, d: table(s, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "all").otherwise(F.concat(F.lit("g"), F.floor(F.col("doc_id") / 40).cast("string"))).alias("page"), "doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars").cast("double")).alias("x"))
_HOT = "h AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'all' ELSE 'g' || doc_id // 40 END AS page, doc_id, CASE WHEN doc_id % 11 <> 0 THEN n_chars::DOUBLE END AS x FROM documents)"
add(
    "win05_hot_islands",
    lambda s, d: q.column_clusters(_hot(s, d), ["page"], "x", "doc_id", 15.0, HOT).select("page", "doc_id", F.col("cluster").cast("bigint").alias("cluster")),
    f"""WITH {_HOT}, s AS (SELECT *, coalesce((x - lag(x) OVER w > 15)::INT, 0) AS st FROM h WINDOW w AS (PARTITION BY page ORDER BY x NULLS LAST, doc_id))
SELECT page, doc_id, CASE WHEN x IS NULL THEN -1 ELSE sum(st) OVER (PARTITION BY page ORDER BY x NULLS LAST, doc_id) END::BIGINT AS cluster FROM s""",
)
add(
    "agg17_hot_gaps",
    lambda s, d: q.gap_candidates(_hot(s, d), ["page"], "x", "doc_id", HOT).select("page", "rows", "after_row", "largest", "median_other"),
    f"""WITH {_HOT}, g AS (SELECT page, lead(x) OVER w - x AS gap, row_number() OVER w AS i FROM h WHERE x IS NOT NULL WINDOW w AS (PARTITION BY page ORDER BY x, doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap DESC NULLS LAST, i) AS k FROM g),
p AS (SELECT page, count(*) AS rows, max(gap) AS largest, (min(i) FILTER (WHERE k = 1))::INT AS after_row, median(gap) FILTER (WHERE k > 1) AS median_other FROM r GROUP BY 1) SELECT page, rows, after_row, largest, median_other FROM p WHERE rows >= 3 AND median_other > 0 AND largest >= median_other * 2.5""",
)


_UNITS = ("$ 1", "in millions", "December 31", "EUR mn", "10 %", "per share", "(000)", "Total", "bn", "  ", "m", "Billions", "GBPs")
_unit = "[" + ", ".join(f"'{u}'" for u in _UNITS) + "]"
add(
    "flt12_unit_texts",
    lambda s, d: table(s, d, "documents").select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("doc_id") % len(_UNITS) + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "lang")).otherwise("")).alias("c")).select("doc_id", is_unit_by_word(F.col("c")).alias("by_word"), is_unit_by_substring(F.col("c")).alias("by_substring")),
    f"""WITH c AS (SELECT doc_id, {_unit}[(doc_id % {len(_UNITS)})::INT + 1] || CASE WHEN doc_id % 3 = 0 THEN ' ' || lang ELSE '' END AS c FROM documents)
SELECT doc_id, regexp_matches(c, '[$£€%]|\\b(?:usd|eur|gbp|mn|bn|000|million|millions|thousand|thousands|billion|billions)\\b', 'i') AS by_word, {' OR '.join(f"contains(lower(c), '{u}')" for u in UNIT_SUBSTRINGS)} AS by_substring FROM c""",
)
add(
    "join03_joined_outcomes",
    lambda s, d: m.joined_outcomes(outcomes(s, d).where("n % 3 > 0").select("pair_id", F.col("correct_a").alias("correct")), outcomes(s, d).where("n % 4 > 0").select("pair_id", F.col("correct_b").alias("correct"))),
    f"WITH {OUTCOMES_SQL} SELECT pair_id, correct_a AS base, correct_b AS other FROM outcomes WHERE n % 3 > 0 AND n % 4 > 0",
)


def _periods(s, d):
    k = F.col("doc_id")
    label = F.when(k % 5 == 0, "none").when(k % 5 == 1, F.concat(F.lit("Dec 31, "), (k % 30 + 1990).cast("string"))).when(k % 5 == 2, F.concat((k % 40 + 1980).cast("string"), F.lit(" and "), (k % 9 + 2010).cast("string"))).when(k % 5 == 3, F.concat(F.lit("FY1"), (k % 30 + 1990).cast("string"))).otherwise((k % 30 + 2000).cast("string"))
    return table(s, d, "documents").select("doc_id", "source", label.alias("period"))


add(
    "srt01_period_order",
    lambda s, d: m.ranked(_periods(s, d).select("doc_id", "period", F.floor(F.col("doc_id") / 16).alias("g")), ["g"], [period_key(F.col("period")), F.col("doc_id")], "place").select("doc_id", period_key(F.col("period"))["year"].alias("year"), "place"),
    """WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'Dec 31, ' || (doc_id % 30 + 1990) WHEN 2 THEN (doc_id % 40 + 1980) || ' and ' || (doc_id % 9 + 2010) WHEN 3 THEN 'FY1' || (doc_id % 30 + 1990) ELSE (doc_id % 30 + 2000)::VARCHAR END AS period FROM documents),
y AS (SELECT doc_id, period, (CASE doc_id % 5 WHEN 1 THEN doc_id % 30 + 1990 WHEN 2 THEN doc_id % 40 + 1980 WHEN 4 THEN doc_id % 30 + 2000 ELSE 0 END)::INT AS year FROM p)
SELECT doc_id, year, (row_number() OVER (PARTITION BY doc_id // 16 ORDER BY year, period, doc_id))::INT AS place FROM y""",
)
add(
    "agg32_mean_left",
    lambda s, d: boxes(s, d).select("vec_id", q.mean_left(F.create_map(F.lit("sales"), F.col("a"), F.lit("costs"), F.col("b"), F.lit("period"), F.array(F.lit(9), F.lit(9), F.lit(9), F.lit(9))), ["sales", "costs", "cash"]).alias("x"), q.mean_left(F.create_map(F.lit("period"), F.col("a")), ["sales"]).alias("none")),
    f"WITH {BOXES_SQL} SELECT vec_id, (a[1] + b[1]) / 2.0 AS x, NULL::DOUBLE AS none FROM boxes",
)


def _trained(s, d):
    """Customers as groups with four variants each, over two cycles of visits."""
    k = F.col("c_custkey").cast("string")
    one = lambda kind, answer, cell: F.struct(F.concat_ws("_", k, F.lit(kind)).alias("image_id"), F.concat(F.lit("i/"), k).alias("image_path"), answer.alias("answer"), F.lit(cell).alias("target_id"), F.array(F.lit(cell)).alias("evidence_ids"), F.when(F.lit(kind) == "target_value", "changes").otherwise("stays").alias("expected_behavior"))
    kinds = {"clean": "c1", "target_value": "c1", "header_address_swap": "c2", "irrelevant_value": "c1"}
    variants = F.create_map(*(x for kind, cell in kinds.items() for x in (F.lit(kind), one(kind, F.concat(F.col("c_mktsegment"), F.lit("*" if kind == "target_value" else "")), cell))))
    groups = table(s, d, "customer").select(F.col("c_custkey").alias("group_id"), F.concat(F.lit("q"), k).alias("question"), variants.alias("variants"))
    return rec.training_pairs(groups, sm.schedule(_groups(s, d), 9, 2))


add(
    "prj15_training_log",
    lambda s, d: rec.training_log(_trained(s, d), "r1"),
    f"""WITH {_SCH} SELECT 'r1' AS run_id, epoch, row_number() OVER (ORDER BY epoch, place, group_id) - 1 AS global_step, group_id, cycle AS cycle_index, epoch % 3 AS position_in_cycle, kind AS cf_type, group_id || '_clean' AS clean_image_id, group_id || '_' || kind AS cf_image_id,
c_mktsegment AS clean_gold_answer, c_mktsegment || CASE kind WHEN 'target_value' THEN '*' ELSE '' END AS cf_gold_answer, 'c1' AS clean_target_cell_id, CASE kind WHEN 'header_address_swap' THEN 'c2' ELSE 'c1' END AS cf_target_cell_id FROM sch JOIN customer ON c_custkey = group_id""",
)
add(
    "prj20_messages",
    lambda s, d: table(s, d, "conversations").where("text is not null and trim(text) <> ''").select("conv_id", "turn", rec.messages(rec.qa_prompt(F.col("text")), F.concat_ws("/", F.lit("img"), F.col("conv_id").cast("string"))).alias("m")).select("conv_id", "turn", F.inline("m")).select("conv_id", "turn", "role", F.posexplode("parts").alias("i", "p")).select("conv_id", "turn", "role", "i", "p.type", F.md5("p.content").alias("content")),
    """WITH c AS (SELECT * FROM conversations WHERE trim(text) <> '') SELECT conv_id, turn, 'user' AS role, 0 AS i, 'image' AS type, md5('img/' || conv_id) AS content FROM c
UNION ALL SELECT conv_id, turn, 'user', 1, 'text', md5('Answer the question from the table image.' || chr(10) || chr(10) || 'Question: ' || trim(text) || chr(10) || 'Answer:') FROM c""",
)


def _sorted_json(s, d):
    path = fresh(s, "sorted")
    sinks.json_lines(table(s, d, "documents").select("source", "n_chars", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang")), path)
    return readers.raw_lines(s, path).select("line")


add("snk02_sorted_json", _sorted_json, """SELECT '{"doc_id":' || doc_id || ',"lang":' || CASE WHEN doc_id % 2 = 0 THEN '"' || lang || '"' ELSE 'null' END || ',"n_chars":' || n_chars || ',"source":"' || source || '"}' AS line FROM documents""")
