"""Record preparation: reading order, breadcrumbs, exclusion, windows, table rows, batches.

items(document_id, pos, item_ref, label, level, text[, parent_ref, orig])
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import packing, skew, text
from attesta.functions.text import has_text, pieces, squash, strip

DOC = ["document_id"]
MAX_LEVEL = 6
PAGE_FURNITURE = ("page_header", "page_footer")
# Bibliography headings, window budgets in tokens, and line templates.
BIBLIOGRAPHY = r"^(?i)(?:\d+[.\s]*)?(references|bibliography)\s*$"
WINDOW_TOKENS, OVERLAP_TOKENS, ROW_TOKENS, SMALL_TOKENS = 900, 40, 950, 125
FIGURE_TEXT = "Text extracted inside this figure (diagram labels, not prose):"
DESCRIPTION_TEXT = "AI-generated description (unverified):"
AMBIGUOUS_TABLE = (
    "Table extraction warning: some data cells merge columns or multiple numbers. "
    "Do not split those values or guess their metric/dataset assignments."
)
ALIGNMENT_MARK = "TABLE_METRIC_ALIGNMENT: ambiguous"
MERGED_CELL = "Unresolved merged cell; do not assign individual metrics"
LONE_NUMBER = r"(?<![\w.])[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?![\w.])"
DEFINITION = r"^[A-Z][A-Za-z0-9 /(),-]{0,55}\.\s+[A-Z]"


def token_count(c: Column | str) -> Column:
    """Default token count; pass another column function where a model tokenizer is needed."""
    return text.piece_count(c)


# ---- breadcrumbs and reading order ---------------------------------------------------
def breadcrumbs(items: DataFrame, max_level: int = MAX_LEVEL) -> DataFrame:
    """Heading path of each item: a heading at level L closes all headings at L or deeper.

    The latest heading per level is carried forward in two steps (inside position blocks,
    then across them); a level counts only if no shallower heading came after it.
    """
    heading = F.col("label") == "section_header"
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(max_level))
    carried = skew.carry_last(
        items,
        DOC,
        "pos",
        {f"__h{n}": F.when(heading & (level == n), F.struct("pos", strip("text").alias("title"))) for n in range(1, max_level + 1)},
    )
    kept = []
    for n in range(1, max_level + 1):
        own = F.col(f"__h{n}")
        live = own.isNotNull()
        for shallower in range(1, n):
            live = live & F.coalesce(F.col(f"__h{shallower}.pos") < own["pos"], F.lit(True))
        kept.append(F.when(live, own["title"]))
    return carried.withColumn("headings", F.array_compact(F.array(*kept))).drop(*[f"__h{n}" for n in range(1, max_level + 1)])


def in_bibliography(headings: Column) -> Column:
    return F.exists(headings, lambda h: h.rlike(BIBLIOGRAPHY))


def caption_owners(items: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions with their owning table or figure; unresolved references are dropped.

    captions(document_id, owner_ref, item_ref, pos)
    """
    return captions.join(items.select(*DOC, "item_ref"), [*DOC, "item_ref"], "left_semi")


def unresolved_captions(items: DataFrame, captions: DataFrame) -> DataFrame:
    return captions.join(items.select(*DOC, "item_ref"), [*DOC, "item_ref"], "left_anti")


def item_status(items: DataFrame, captions: DataFrame, *, include_bibliography: bool = False) -> DataFrame:
    """Account for every item: included, context, excluded or unresolved, with the reason.

    Adds `headings`.  Captions are attached to their owner and never serialized as prose.
    """
    owned = captions.select(*DOC, "item_ref").distinct().withColumn("__owned", F.lit(True))
    rows = breadcrumbs(items).join(owned, [*DOC, "item_ref"], "left")
    biblio = in_bibliography(F.col("headings"))
    furniture = F.col("label").isin(*PAGE_FURNITURE)
    body = F.when(F.col("label") == "formula", F.coalesce("orig", F.lit("")) if "orig" in items.columns else F.col("text")).otherwise(F.col("text"))
    blank = F.length(strip(F.coalesce(body, F.lit("")))) == 0
    out = F.lit(not include_bibliography) & biblio
    holder = F.col("label").isin("table", "picture")
    status = (
        F.when(F.col("label") == "section_header", F.struct(F.lit("context").alias("status"), F.lit("heading_breadcrumb").alias("reason")))
        .when(furniture | out, F.struct(F.lit("excluded").alias("status"), F.when(biblio, "bibliography").otherwise(F.col("label")).alias("reason")))
        .when(F.col("__owned"), F.struct(F.lit("attached").alias("status"), F.lit("attached_to_owner").alias("reason")))
        .when(~holder & blank, F.struct(F.lit("unresolved").alias("status"), F.when(F.col("label") == "formula", "empty_original_formula").otherwise("empty_source_text").alias("reason")))
        .otherwise(F.struct(F.lit("included").alias("status"), F.lit("serialized_source_content").alias("reason")))
    )
    return rows.withColumn("__s", status).select("*", "__s.status", "__s.reason").drop("__s", "__owned")


def accounting(status: DataFrame, captions: DataFrame, serialized: DataFrame) -> DataFrame:
    """Final item states: an attached caption counts as included when its owner was serialized.

    serialized(document_id, item_ref): tables and pictures that produced a record.
    """
    done = (
        captions.join(serialized.select(*DOC, F.col("item_ref").alias("owner_ref")), [*DOC, "owner_ref"], "left_semi")
        .select(*DOC, "item_ref").distinct().withColumn("__done", F.lit(True))
    )
    made = serialized.select(*DOC, "item_ref").distinct().withColumn("__made", F.lit(True))
    rows = status.join(done, [*DOC, "item_ref"], "left").join(made, [*DOC, "item_ref"], "left")
    attached = F.col("status") == "attached"
    silent = (F.col("status") == "included") & (F.col("label") == "picture") & F.col("__made").isNull()
    final = (
        F.when(attached & F.col("__done"), F.struct(F.lit("included").alias("status"), F.lit("serialized_source_content").alias("reason")))
        .when(attached, F.struct(F.lit("unresolved").alias("status"), F.lit("caption_owner_not_serialized").alias("reason")))
        .when(silent, F.struct(F.lit("unresolved").alias("status"), F.lit("picture_has_no_text_caption_or_enabled_description").alias("reason")))
        .otherwise(F.struct("status", "reason"))
    )
    return rows.withColumn("__f", final).select(*DOC, "item_ref", "label", "__f.status", "__f.reason")


def status_counts(accounted: DataFrame) -> DataFrame:
    return accounted.groupBy(*DOC, "status").agg(F.count("*").alias("items"))


def prose_records(status: DataFrame) -> DataFrame:
    """Included prose with its heading lines, in reading order."""
    rows = status.where((F.col("status") == "included") & ~F.col("label").isin("table", "picture"))
    heading_lines = F.transform("headings", lambda h: F.concat(F.lit("# "), h))
    return rows.select(
        *DOC, "pos", "item_ref", "label", "headings", F.col("text").alias("content"),
        F.array_join(F.concat(heading_lines, F.array("text")), "\n\n").alias("record_text"),
    )


# ---- tables and pictures -------------------------------------------------------------
def ambiguous_cells(cells: DataFrame) -> DataFrame:
    """Data cells merging columns or holding several numbers."""
    header = F.col("column_header") | F.col("row_header") | F.col("row_section")
    return cells.where(
        ~header & ((F.col("col_end") - F.col("col_start") > 1) | (F.regexp_count("text", F.lit(LONE_NUMBER)) > 1))
    ).select(*DOC, "item_ref", "idx")


def table_grid_lines(cells: DataFrame) -> DataFrame:
    """One pipe-delimited line per grid row; a spanning cell appears in each column it covers."""
    placed = cells.withColumn("row", F.explode(F.sequence("row_start", F.col("row_end") - 1))).withColumn(
        "column", F.explode(F.sequence("col_start", F.col("col_end") - 1))
    )
    return (
        placed.groupBy(*DOC, "item_ref", "row")
        .agg(F.sort_array(F.collect_list(F.struct("column", "idx", "text"))).alias("c"))
        .select(*DOC, "item_ref", "row", F.concat(F.lit("| "), F.array_join("c.text", " | "), F.lit(" |")).alias("line"))
    )


def missing_cells(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells whose text does not appear in any line of their rows.

    Rows of a cell without its text are found where the cells meet their lines, both shuffled by row. A cell of one row
    is settled there; only such rows of taller cells are counted by cell (told apart by `idx`, its number in the table).
    """
    key = [*DOC, "item_ref"]
    rows = F.sequence("row_start", F.col("row_end") - 1)
    spots = cells.where(has_text("text")).select(
        *key, "idx", F.coalesce(F.size(F.array_distinct(rows)), F.lit(0)).alias("height"), squash("text").alias("text"), F.explode_outer(rows).alias("row")
    )
    shown = lines.select(*[F.col(c).alias(f"l_{c}") for c in (*key, "row")], squash("line").alias("line"))
    same = [F.col(c) == F.col(f"l_{c}") for c in (*key, "row")]
    without = skew.shuffled_join(spots, shown, [*same, F.contains("line", "text")], "left_anti")
    tall = (
        without.where("height > 1").groupBy(*key, "idx", "height", "text").agg(F.count_distinct("row").alias("n"), F.count("*").alias("seen"))
        .where("n = height").withColumn("copy", F.explode(F.expr("array_repeat(1, CAST(seen DIV height AS INT))")))
    )
    return without.where("height <= 1").select(*key, "idx").unionByName(tall.select(*key, "idx"))


def table_heads(cells: DataFrame, captions: DataFrame) -> DataFrame:
    """Caption and ambiguity warning of each table; its grid stays one row per line.

    captions(document_id, item_ref, caption)
    """
    doubtful = ambiguous_cells(cells).groupBy(*DOC, "item_ref").agg(F.count("*").alias("ambiguous_cells"))
    return (
        cells.select(*DOC, "item_ref").distinct()
        .join(captions, [*DOC, "item_ref"], "left")
        .join(doubtful, [*DOC, "item_ref"], "left")
        .select(
            *DOC, "item_ref", F.coalesce("ambiguous_cells", F.lit(0)).cast("long").alias("ambiguous_cells"),
            F.concat_ws("\n\n", "caption", F.when(F.col("ambiguous_cells") > 0, AMBIGUOUS_TABLE)).alias("head"),
        )
    )


def picture_records(pictures: DataFrame, captions: DataFrame, inner: DataFrame, *, include_descriptions: bool = False) -> DataFrame:
    """Figure text: captions, labels found inside the figure, optional generated description.

    pictures(document_id, item_ref, description); captions and inner:
    (document_id, owner_ref, item_ref, pos, text).
    """
    def joined(df: DataFrame, separator: str, name: str) -> DataFrame:
        full = df.where(has_text("text"))
        return full.groupBy(*DOC, F.col("owner_ref").alias("item_ref")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "item_ref", "text"))).alias("p")
        ).select(*DOC, "item_ref", F.array_join("p.text", separator).alias(name))

    labels = inner.join(captions.select(*DOC, "item_ref"), [*DOC, "item_ref"], "left_anti")
    rows = pictures.join(joined(captions, "\n\n", "caption"), [*DOC, "item_ref"], "left").join(
        joined(labels, "\n", "labels"), [*DOC, "item_ref"], "left"
    )
    parts = F.concat_ws(
        "\n\n",
        F.coalesce("caption", F.lit("")),
        F.when(F.col("labels").isNotNull(), F.concat(F.lit(FIGURE_TEXT + "\n"), "labels")),
        F.when(F.lit(include_descriptions) & (F.coalesce("description", F.lit("")) != ""), F.concat(F.lit(DESCRIPTION_TEXT + "\n"), "description")),
    )
    return rows.select(*DOC, "item_ref", parts.alias("content")).where(has_text("content"))


def table_rows(cells: DataFrame, captions: DataFrame, titles: DataFrame, tables: DataFrame) -> DataFrame:
    """A record per table row: caption, section carried forward, row label, cells with header paths.

    captions(document_id, item_ref, caption); titles(document_id, title).
    """
    key = [*DOC, "item_ref"]
    data = cells.where(~F.col("column_header") & has_text("text")).withColumn("row", F.col("row_start"))
    sized = skew.salted_join(data, tables.select(*key, "num_cols"), key, spread=["idx"])
    per_row = sized.groupBy(*key, "row").agg(
        F.count("*").alias("n"), F.max(F.col("col_end") - F.col("col_start")).alias("widest"),
        F.min_by("text", "idx").alias("row_label"), F.max("num_cols").alias("num_cols"),
    )
    is_section = (F.col("n") == 1) & (F.col("widest") >= F.col("num_cols"))
    rows = skew.carry_last(per_row, key, "row", {"section": F.when(is_section, F.col("row_label"))}).where(~is_section)
    heads = cells.where("column_header").withColumn("__at", F.explode(F.sequence("col_start", F.col("col_end") - 1)))
    spread = data.withColumn("__at", F.explode(F.sequence("col_start", F.col("col_end") - 1)))
    named = skew.salted_join(
        spread,
        heads.select(*key, "__at", F.struct(F.col("row_start").alias("a"), F.col("col_start").alias("b"), F.col("text").alias("h")).alias("head")),
        [*key, "__at"], spread=["idx"], how="left",
    )
    paths = named.groupBy(*key, "row", "idx").agg(
        F.first("text").alias("text"), F.first(F.col("col_end") - F.col("col_start")).alias("width"),
        F.array_sort(F.collect_set("head")).alias("heads"),
    )
    label = F.array_join(F.array_distinct(F.transform("heads", lambda h: h["h"])), " / ")
    label = F.when(label == "", "Unlabelled column").otherwise(label)
    prefix = F.when(F.col("width") > 1, MERGED_CELL).otherwise("Cell")
    line = F.concat(prefix, F.lit(" ["), label, F.lit("]: "), "text")
    lines = paths.groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("l"))
    return (
        rows.join(lines, [*key, "row"])
        .join(captions, key, "left")
        .join(titles, DOC, "left")
        .select(
            *key, "row", "row_label", F.coalesce("section", F.lit("")).alias("section"),
            F.concat(F.lit("Paper title: "), F.coalesce("title", F.lit("")), F.lit("\nContent: Results table; use its caption and row/column headers.\n\n")).alias("prefix"),
            F.array(F.coalesce("caption", F.lit("")), F.concat(F.lit("Table row context: "), F.coalesce("section", F.lit(""))), F.concat(F.lit("Row label: "), "row_label")).alias("context"),
            F.col("l.line").alias("lines"),
        )
    )


def row_records(rows: DataFrame, count: Callable[[Column], Column] = token_count, limit: int = ROW_TOKENS) -> DataFrame:
    """Whole-row records, or one record per cell when a row exceeds the limit; cells stay whole."""
    whole = F.concat("prefix", F.array_join(F.concat("context", "lines"), "\n"))
    base = F.concat("prefix", F.array_join("context", "\n"), F.lit("\n"))
    sized = rows.withColumn("__whole", whole).withColumn("__large", count(F.col("__whole")) > limit)
    parts = F.when(F.col("__large"), F.transform("lines", lambda x: F.concat(base, x))).otherwise(F.array("__whole"))
    out = sized.select(*DOC, "item_ref", "row", "__large", F.posexplode(parts).alias("part", "record_text"))
    suffix = F.concat(F.lit(":row:"), F.col("row").cast("string"), F.when(F.col("__large"), F.concat(F.lit(":cell:"), F.col("part").cast("string"))).otherwise(""))
    return out.select(*DOC, "item_ref", "row", F.concat("item_ref", suffix).alias("record_id"), "record_text")


def header_records(cells: DataFrame, captions: DataFrame, titles: DataFrame) -> DataFrame:
    """Caption and column headings of each table, kept even when it has no data rows."""
    heads = cells.where("column_header").groupBy(*DOC, "item_ref").agg(
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("h")
    )
    return (
        cells.select(*DOC, "item_ref").distinct()
        .join(heads, [*DOC, "item_ref"], "left").join(captions, [*DOC, "item_ref"], "left").join(titles, DOC, "left")
        .select(
            *DOC, "item_ref", F.concat("item_ref", F.lit(":headers")).alias("record_id"),
            F.concat(
                F.lit("Paper title: "), F.coalesce("title", F.lit("")), F.lit("\nContent: Results table; use its caption and row/column headers.\n\n"),
                F.coalesce("caption", F.lit("")), F.lit("\nColumn headings: "), F.coalesce(F.array_join("h.text", "; "), F.lit("")),
            ).alias("record_text"),
        )
    )


def omitted_cells(cells: DataFrame, rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Nonblank cells missing from every record of their row, header or section context."""
    key = [*DOC, "item_ref"]
    full = cells.where(has_text("text")).select(*key, "idx", F.col("row_start").alias("row"), "text", "column_header")
    in_rows = full.join(rows.select(*key, "row", "record_text"), [*key, "row"]).where(F.contains("record_text", "text"))
    in_heads = skew.salted_join(full.where("column_header"), headers.select(*key, "record_text"), key, spread=["idx"]).where(F.contains("record_text", "text"))
    covered = in_rows.select(*key, "idx").unionByName(in_heads.select(*key, "idx"))
    left = full.join(covered, [*key, "idx"], "left_anti")
    # A section row is repeated as context of the rows below it.
    sections = rows.select(*key, F.explode(F.array(F.regexp_extract("record_text", r"(?m)^Table row context: (.*)$", 1))).alias("text")).distinct()
    return left.join(sections, [*key, "text"], "left_anti").select(*key, "idx")


def ambiguous_alignment(record_text: Column) -> Column:
    """Merged cell, or a header path carrying more than one direction arrow."""
    paths = F.regexp_extract_all(record_text, F.lit(r"(?m)^(?:Cell|Unresolved merged cell[^\[\n]*) \[([^\]]+)\]"), F.lit(1))
    double = F.exists(paths, lambda p: F.regexp_count(p, F.lit("[↑↓]")) > 1)
    return F.contains(record_text, F.lit("Unresolved merged cell")) | double


def mark_alignment(records: DataFrame) -> DataFrame:
    """Insert the ambiguity mark before the first blank line of doubtful table records."""
    marked = F.regexp_replace("record_text", r"^(?s)(.*?)\n\n", f"$1\n{ALIGNMENT_MARK}\n\n")
    return records.withColumn("ambiguous", ambiguous_alignment(F.col("record_text"))).withColumn(
        "record_text", F.when(F.col("ambiguous"), marked).otherwise(F.col("record_text"))
    )


# ---- windows, islands, batches -------------------------------------------------------
def token_windows(records: DataFrame, tokens: Callable[[Column], Column] = pieces, budget: int = WINDOW_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Overlapping windows over a record's tokens; the prefix is repeated and pays its share.

    records(document_id, record_id, prefix, content)
    """
    body = tokens(F.col("content"))
    room = F.greatest(F.lit(1), budget - F.size(tokens(F.col("prefix"))))
    step = F.greatest(F.lit(1), room - overlap)
    count = F.size("__t")
    starts = F.when(count > 0, F.filter(F.sequence(F.lit(0), count - 1, F.col("__step")), lambda s: (s == 0) | (s - F.col("__step") + F.col("__room") < count)))
    # Each window is cut inside the row; the tokens are not repeated with it.
    cut = lambda s: F.array_join(F.slice("__t", s + 1, F.col("__room")), "")
    return (
        records.withColumn("__t", body).withColumn("__room", room).withColumn("__step", step)
        .select(*DOC, "record_id", "prefix", F.posexplode(F.coalesce(F.transform(starts, cut), F.array().cast("array<string>"))).alias("part", "window"))
        .select(*DOC, F.concat("record_id", F.lit(":part:"), F.col("part").cast("string")).alias("record_id"), "part", F.concat("prefix", "window").alias("record_text"))
    )


def max_tokens(records: DataFrame, count: Callable[[Column], Column] = token_count) -> DataFrame:
    return records.groupBy(*DOC).agg(F.max(count(F.col("record_text"))).alias("max_record_tokens"))


def join_islands(records: DataFrame, count: Callable[[Column], Column] = token_count, limit: int = WINDOW_TOKENS, small: int = SMALL_TOKENS) -> DataFrame:
    """Adjacent small prose under one heading path joined up to the token limit.

    records(document_id, n (dense order), record_id, prose, headings, prefix, body).  Cuts that
    depend only on a row and its predecessor are found by an equi-join on the order; the
    running token limit is applied by exact greedy packing.
    """
    sized = records.withColumn("size", count(F.col("body"))).withColumn("prefix_size", count(F.col("prefix")))
    previous = skew.neighbour(
        sized, DOC, "n", {"p_prose": "prose", "p_headings": "headings", "p_size": "size", "p_body": "body"}
    )
    definition = F.lower("p_body").rlike(r"^(where |and )") & F.col("body").rlike(DEFINITION)
    cut = (
        F.col("p_prose").isNull()
        | ~F.col("prose")
        | ~F.col("p_prose")
        | ~F.col("headings").eqNullSafe(F.col("p_headings"))
        | definition
        | (F.least("p_size", "size") >= small)
    )
    islands = packing.greedy_groups(
        previous.select(*records.columns, "size", "prefix_size", cut.alias("__cut")), DOC, "n",
        F.col("size"), limit, extra=F.col("prefix_size"), force=F.col("__cut"),
    )
    first = F.element_at("r", 1)["record_id"]
    return (
        islands.groupBy(*DOC, F.col("group_no").alias("island"))
        .agg(
            F.array_sort(F.collect_list(F.struct("n", "record_id", "body"))).alias("r"),
            F.min_by("prefix", "n").alias("prefix"),
            F.min_by("prose", "n").alias("prose"),
        )
        .select(
            *DOC,
            "island",
            F.when(F.size("r") > 1, F.concat(first, F.lit(":joined"))).otherwise(first).alias("record_id"),
            F.col("r.record_id").alias("parent_record_ids"),
            F.concat("prefix", F.array_join("r.body", "\n\n")).alias("record_text"),
            "prose",
        )
    )


def merged_provenance(islands: DataFrame, records: DataFrame) -> DataFrame:
    """Item references and pages of all parents of a joined record.

    records(document_id, record_id, refs, pages)
    """
    parents = islands.select("document_id", F.col("record_id").alias("joined_id"), F.explode("parent_record_ids").alias("record_id"))
    return (
        parents.join(records.select("document_id", "record_id", "refs", "pages"), ["document_id", "record_id"])
        .groupBy("document_id", "joined_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
        .withColumnRenamed("joined_id", "record_id")
    )


def parent_coverage(islands: DataFrame, records: DataFrame) -> DataFrame:
    """Parents lost or invented by joining; empty when the two sets are equal."""
    used = islands.select("document_id", F.explode("parent_record_ids").alias("record_id"))
    known = records.select("document_id", "record_id")
    lost = known.join(used, ["document_id", "record_id"], "left_anti").withColumn("fault", F.lit("omitted"))
    made_up = used.join(known, ["document_id", "record_id"], "left_anti").withColumn("fault", F.lit("unknown"))
    return lost.unionByName(made_up)


def select_by_heading(chunks: DataFrame, headings: list[str]) -> DataFrame:
    """Chunks under a requested heading, bibliography always left out."""
    fold = lambda h: F.replace(F.lower(h), F.lit("ß"), F.lit("ss"))
    wanted = F.array(*[fold(F.lit(h)) for h in headings]) if headings else None
    biblio = F.exists("headings", lambda h: F.trim(h).rlike(r"^(?i)(?:(?:\d+[. ]*)?references|bibliography)$"))
    rows = chunks.where(~biblio)
    return rows.where(F.arrays_overlap(F.transform("headings", fold), wanted)) if headings else rows


def missing_headings(chunks: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested headings no chunk carries. requested(document_id, heading)"""
    present = chunks.select(*DOC, F.explode("headings").alias("h")).select(*DOC, F.lower("h").alias("key")).distinct()
    return requested.withColumn("key", F.lower("heading")).join(present, [*DOC, "key"], "left_anti").select(*DOC, "heading")


def token_batches(chunks: DataFrame, limit: int, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """Batches per heading in order: never over the limit, oversize chunks alone, nothing cut.

    chunks(document_id, n, chunk_id, heading, rendered)
    """
    rows = chunks.select(*DOC, "heading", "n", "chunk_id", count(F.col("rendered")).alias("cost"))
    large = F.col("cost") > limit
    return packing.greedy_groups(rows, [*DOC, "heading"], "n", F.col("cost"), limit, alone=large).select(
        *DOC, "heading", "n", "chunk_id", "cost", F.col("group_no").alias("batch"), large.alias("oversize")
    )


def render_chunk(refs: Column, pages: Column, body: Column) -> Column:
    return F.concat(
        F.lit("[Docling source refs: "), F.array_join(refs, ", "), F.lit("; PDF pages: ["),
        F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit("]]\n"), body,
    )
