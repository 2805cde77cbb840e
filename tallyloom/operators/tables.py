"""Cells, headers and facts of tables, and blocks of pages: window forms of the header and context look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import YEAR, is_bare_total, is_degenerate, is_numeric, is_numeric_label, is_unit_by_word, normal, number_text, unit_class


def cell_id(row: Column, col: Column, labelled: bool = False) -> Column:
    return F.format_string("r%02d" + ("C%02d" if labelled else "c%02d"), row, col)


def flatten_grid(tables: DataFrame, rows: str = "rows") -> DataFrame:
    """Cells of arrays of arrays: row_idx, col_idx, text (null as empty, trimmed)."""
    keep = [c for c in tables.columns if c != rows]
    by_row = tables.select(*keep, F.posexplode(rows).alias("row_idx", "__r"))
    return by_row.select(*keep, "row_idx", F.posexplode("__r").alias("col_idx", "__t")).select(*keep, "row_idx", "col_idx", F.coalesce(F.trim("__t"), F.lit("")).alias("text"))


def flatten_table(tables: DataFrame, rows: str = "rows", key: str = "table_id") -> tuple[DataFrame, DataFrame]:
    """Cells and words of labelled rows; words are numbered through each table from 0."""
    by_row = tables.select(key, F.posexplode(rows).alias("row_idx", "r"))
    cells = by_row.select(key, "row_idx", F.posexplode("r.cells").alias("col_idx", "c"))
    words = cells.select(key, "row_idx", "col_idx", F.posexplode("c.words").alias("__w", "w"))
    order = Window.partitionBy(key).orderBy("row_idx", "col_idx", "__w")
    words = words.select(key, "row_idx", "col_idx", (F.row_number().over(order) - 1).alias("word_idx"), F.trim("w.text").alias("text"), F.col("w.bbox").alias("bbox"))
    return cells.select(key, "row_idx", "col_idx", F.trim("c.text").alias("text"), F.col("c.label").alias("label"), F.col("c.bbox").alias("bbox")), words


def with_headers(cells: DataFrame) -> DataFrame:
    """Every cell with its header context: row headers left of it; year headers, unit cells and other cells above it.

    cells(table_id, row_idx, col_idx, text). A row's and a column's cells are gathered by windows over their own table.
    """
    here = F.struct("row_idx", "col_idx", "text")
    left = Window.partitionBy("table_id", "row_idx").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("table_id", "col_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    text = F.col("text")
    full, year, unit = text != "", text.rlike(YEAR), is_unit_by_word(text)
    return (
        cells.withColumn("row_headers", F.collect_list(F.when(full & ~is_numeric(text), here)).over(left))
        .withColumn("column_headers", F.collect_list(F.when(full & year, here)).over(above))
        .withColumn("unit_cells", F.collect_list(F.when(full & ~year & unit, here)).over(above))
        .withColumn("spanning_headers", F.collect_list(F.when(full & ~year & ~unit, here)).over(above))
    )


def last_of(c: Column, n: int) -> Column:
    """The last n elements, all where there are fewer."""
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)


def header_bands(cells: DataFrame) -> DataFrame:
    """(table_id, header_rows): leading rows whose cell in column 0 is blank or missing."""
    first = F.min(F.when((F.col("col_idx") == 0) & (F.trim("text") != ""), F.col("row_idx")))
    return cells.groupBy("table_id").agg(F.coalesce(first, F.max("row_idx") + 1).alias("header_rows"))


def column_scopes(cells: DataFrame) -> DataFrame:
    """(table_id, col_idx, scope): the column's texts in the header band without years; null for none."""
    band = cells.join(header_bands(cells), "table_id").where((F.col("row_idx") < F.col("header_rows")) & (F.col("text") != "") & ~F.col("text").rlike(YEAR))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.trim("text").alias("t")))), lambda x: x.t), " ")
    return band.groupBy("table_id", "col_idx").agg(F.nullif(F.trim(joined), F.lit("")).alias("scope"))


def facts(cells: DataFrame) -> DataFrame:
    """Every numeric cell with its metric, period, unit class and scope, and a reason ('accepted' for facts)."""
    h = with_headers(cells).where((F.col("text") != "") & is_numeric(F.col("text"))).join(column_scopes(cells), ["table_id", "col_idx"], "left")
    metric = F.try_element_at("row_headers", F.lit(-1)).text
    period = F.try_element_at("column_headers", F.lit(-1)).text
    tag = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("unit_cells", lambda c: ~is_numeric(c.text)), lambda c: F.lower(F.trim(c.text))))), " ")
    h = h.withColumn("metric", metric).withColumn("period", period)
    m = F.col("metric")
    reason = F.when(is_degenerate(m), "no_metric_or_degenerate").when(is_bare_total(m), "bare_total_row").when(is_numeric_label(m), "numeric_metric_label").when(F.col("period").isNull(), "no_period").otherwise("accepted")
    return h.select("table_id", "row_idx", "col_idx", F.col("text").alias("value"), number_text(F.col("text")).alias("value_norm"), normal(m).alias("metric"), "period", unit_class(F.col("text"), m, tag).alias("unit"), "scope", reason.alias("reason"))


def answer_cells(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """The one cell whose number text equals the answer's; questions with none or several have no row."""
    q = questions.withColumn("k", number_text(F.col("answer"))).where(F.col("k") != "")
    c = cells.where("text <> ''").select("table_id", "row_idx", "col_idx", "text", number_text(F.col("text")).alias("k"))
    hits = q.join(c, ["table_id", "k"]).groupBy("table_id", "question").agg(F.count("*").alias("n"), F.min(F.struct("row_idx", "col_idx", "text")).alias("c"))
    return hits.where("n = 1").select("table_id", "question", "c.*")


def header_swaps(answers: DataFrame, cells: DataFrame) -> DataFrame:
    """For answer cells: the nearest year header above, and the first other year of that row whose value in the answer's row is another number."""
    a = answers.select("table_id", "question", F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), F.col("text").alias("t"))
    years = cells.where(F.col("text").rlike(YEAR)).select("table_id", F.col("row_idx").alias("hr"), F.col("col_idx").alias("hc"), F.col("text").alias("ht"))
    head = a.join(years.withColumnRenamed("hc", "c"), ["table_id", "c"]).where("hr < r").groupBy("table_id", "question", "r", "c", "t").agg(F.max("hr").alias("hr"), F.max_by("ht", "hr").alias("header"))
    peers = head.join(years, ["table_id", "hr"]).where("hc <> c")
    values = cells.where((F.col("text") != "") & is_numeric(F.col("text"))).select("table_id", F.col("row_idx").alias("r"), F.col("col_idx").alias("hc"), F.col("text").alias("v"))
    found = peers.join(values, ["table_id", "r", "hc"]).where(number_text(F.col("v")) != number_text(F.col("t")))
    best = found.groupBy("table_id", "question", "header").agg(F.min_by(F.struct("hc", F.col("ht").alias("peer_header"), F.col("v").alias("peer_value")), "hc").alias("p"))
    return best.select("table_id", "question", "header", F.col("p.hc").alias("peer_col"), "p.peer_header", "p.peer_value")


def irrelevant_cells(answers: DataFrame, cells: DataFrame, forbidden: DataFrame) -> DataFrame:
    """The nearest numeric cell (by rows plus columns, then scan order) of another row and value that is not forbidden."""
    a = answers.select("table_id", "question", F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), F.col("text").alias("t"))
    free = cells.where((F.col("text") != "") & is_numeric(F.col("text")) & ~F.col("text").rlike(YEAR))
    j = a.join(free, "table_id").where((F.col("row_idx") != F.col("r")) & (number_text(F.col("text")) != number_text(F.col("t")))).join(forbidden, ["table_id", "question", "row_idx", "col_idx"], "left_anti")
    far = F.abs(F.col("row_idx") - F.col("r")) + F.abs(F.col("col_idx") - F.col("c"))
    return j.groupBy("table_id", "question").agg(F.min(F.struct(far.alias("distance"), "row_idx", "col_idx", "text")).alias("b")).select("table_id", "question", "b.*")


def overlay(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """Cells with patched texts; patches(table_id, row_idx, col_idx, new_text)."""
    return cells.join(patches, ["table_id", "row_idx", "col_idx"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def context_blocks(blocks: DataFrame, window: int, page: str = "page", order: str = "ord") -> DataFrame:
    """Each block with the texts of its page within ``window`` of its order, joined by blanks."""
    w = Window.partitionBy(page).orderBy(order).rangeBetween(-window, window)
    around = F.collect_list(F.struct(order, "text")).over(w)
    return blocks.withColumn("context", F.array_join(F.transform(F.array_sort(around), lambda x: x.text), " ")).withColumn("n_context", F.size(around))


def ordered_units(units: DataFrame) -> DataFrame:
    """One unit an id: the first role by rank, in order of rank and id. units(group_id, id, role_rank, role)."""
    one = units.groupBy("group_id", "id").agg(F.min_by("role", "role_rank").alias("role"), F.min("role_rank").alias("role_rank"))
    return one.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("role_rank", "id", "role"))), lambda x: F.struct(x.id.alias("id"), x.role.alias("role"))).alias("units"))


def word_spans(words: Column, text: Column) -> Column:
    """Start and end characters of each word, searched from the end of the word before; -1 where not found."""

    def step(acc: Column, w: Column) -> Column:
        found = F.call_function("locate", w, text, acc.at + 1)
        start = F.when(found > 0, found - 1).otherwise(-1)
        end = F.when(found > 0, found - 1 + F.length(w)).otherwise(-1)
        return F.struct(F.when(found > 0, end).otherwise(acc.at).alias("at"), F.concat(acc.spans, F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(words, empty, step).spans
