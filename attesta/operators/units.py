"""Evidence units: text items, tables, pictures and table cells with structural context.

Inputs are flat tables keyed by `document_id`:

* items(document_id, pos, item_ref, kind, label, text, locations)
* tables(document_id, item_ref, num_rows, num_cols)
* cells(document_id, item_ref, idx, row_start, row_end, col_start, col_end,
  column_header, row_header, row_section, text, bbox)
* item_context(document_id, item_ref, role, ref, pos)
* pages(document_id, page_no, width, height)

Context is kept as an edge table (document_id, evidence_id, role, ref, pos); arrays
are only built on export, because one table may own a large share of all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import skew, text
from attesta.functions.stage import stage
from attesta.functions.text import MULTIPLE_NUMBERS, has_text, strip

DOC = ["document_id"]
BBOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
LOCATION = f"struct<page_no:int,bbox:{BBOX},granularity:string,charspan:array<int>>"
CELL_FLAGS = ("column_header", "row_header", "row_section")


def cell_id(item_ref: Column | str, idx: Column | str) -> Column:
    return F.concat(text.col(item_ref), F.lit("::cell:"), text.col(idx).cast("string"))


def item_units(items: DataFrame) -> DataFrame:
    """Text, table and picture items as units with their extraction flags."""
    no_place = F.coalesce(F.size("locations"), F.lit(0)) <= 0
    blank = (F.col("kind") == "text") & ~has_text(F.coalesce("text", F.lit("")))
    return items.select(
        *DOC,
        "pos",
        F.col("item_ref").alias("evidence_id"),
        "item_ref",
        "kind",
        "label",
        F.coalesce("text", F.lit("")).alias("text"),
        "locations",
        text.codes((no_place, "missing_page_provenance"), (blank, "empty_extracted_text")).alias("issues"),
    )


def empty_tables(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables without a usable grid."""
    filled = cells.select(*DOC, "item_ref").distinct()
    sized = tables.where((F.col("num_rows") > 0) & (F.col("num_cols") > 0))
    usable = sized.join(filled, [*DOC, "item_ref"], "left_semi")
    return tables.join(usable, [*DOC, "item_ref"], "left_anti").select(
        *DOC, "item_ref", F.lit("empty_table_structure").alias("issue")
    )


def duplicate_refs(items: DataFrame) -> DataFrame:
    return items.groupBy(*DOC, "item_ref").agg(F.count("*").alias("copies")).where("copies > 1")


def unknown_page_locations(units: DataFrame, pages: DataFrame) -> DataFrame:
    placed = units.select(*DOC, "evidence_id", F.explode("locations.page_no").alias("page_no")).distinct()
    return placed.join(pages.select(*DOC, "page_no").distinct(), [*DOC, "page_no"], "left_anti")


def invalid_spans(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells whose half-open spans are empty or leave the declared grid."""
    reason = (
        F.when(
            (F.col("row_end") <= F.col("row_start"))
            | (F.col("col_end") <= F.col("col_start"))
            | (F.col("row_start") < 0)
            | (F.col("col_start") < 0),
            "non_positive_span",
        )
        .when((F.col("row_end") > F.col("num_rows")) | (F.col("col_end") > F.col("num_cols")), "out_of_bounds")
    )
    return (
        cells.join(tables, [*DOC, "item_ref"])
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(*DOC, cell_id("item_ref", "idx").alias("evidence_id"), "reason")
    )


def is_header(prefix: str = "") -> Column:
    flag = F.lit(False)
    for name in CELL_FLAGS:
        flag = flag | F.coalesce(F.col(prefix + name), F.lit(False))
    return flag


def cell_units(cells: DataFrame, units: DataFrame) -> DataFrame:
    """Cells as units; a box is bound to a page only when the table has exactly one page."""
    places = units.where("kind = 'table'").select(*DOC, "item_ref", F.col("locations").alias("table_locations"))
    one_page = F.size(F.array_distinct("table_locations.page_no")) == 1
    bound = one_page & F.col("bbox").isNotNull()
    own = F.array(
        F.struct(
            F.col("table_locations")[0]["page_no"].alias("page_no"),
            F.col("bbox").alias("bbox"),
            F.lit("cell").alias("granularity"),
            F.lit(None).cast("array<int>").alias("charspan"),
        )
    )
    inherited = F.transform("table_locations", lambda p: p.withField("granularity", F.lit("table")))
    spanning = ~is_header() & (
        (F.col("row_end") - F.col("row_start") > 1) | (F.col("col_end") - F.col("col_start") > 1)
    )
    joined = skew.salted_join(cells, places, [*DOC, "item_ref"], spread=["idx"])
    return joined.select(
        *DOC,
        cell_id("item_ref", "idx").alias("evidence_id"),
        "item_ref",
        F.lit("table_cell").alias("kind"),
        F.lit("table_cell").alias("label"),
        "text",
        F.when(bound, own).otherwise(inherited).cast(f"array<{LOCATION}>").alias("locations"),
        text.codes(
            (~F.coalesce(bound, F.lit(False)), "cell_location_not_resolved"),
            (strip("text").rlike(MULTIPLE_NUMBERS), "multiple_numeric_values"),
            (spanning, "spanning_data_cell"),
        ).alias("issues"),
        "idx",
        "row_start",
        "row_end",
        "col_start",
        "col_end",
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in CELL_FLAGS],
    )


def _axis(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("__at", F.explode(F.sequence(F.col(start), F.col(end) - 1)))


def _overlap_edges(
    cells: DataFrame, others: DataFrame, axis: str, role: str, condition: Column
) -> DataFrame:
    """Pairs of cells of one table overlapping along an axis.

    Spans are expanded to grid coordinates, so the join key is (table, coordinate)
    instead of the whole table, and a pair is kept only at the first coordinate the
    two spans share: no duplicates and no pairwise product within a table. A column
    holds a cell of every row, so its key is salted; a row holds few cells.
    """
    start, end = f"{axis}_start", f"{axis}_end"
    left = _axis(cells.select(*DOC, "item_ref", "idx", "row_start", "row_end", "col_start", "col_end"), start, end)
    right = _axis(
        others.select(
            *DOC, "item_ref", *[F.col(c).alias(f"o_{c}") for c in ("idx", "row_start", "row_end", "col_start", "col_end")]
        ),
        f"o_{start}",
        f"o_{end}",
    )
    key = [*DOC, "item_ref", "__at"]
    pairs = skew.salted_join(left, right, key, spread=["idx"]) if axis == "col" else skew.shuffled_join(left, right, key)
    first = F.col("__at") == F.greatest(F.col(start), F.col(f"o_{start}"))
    return pairs.where(first & condition).select(
        *DOC,
        cell_id("item_ref", "idx").alias("evidence_id"),
        F.lit(role).alias("role"),
        cell_id("item_ref", "o_idx").alias("ref"),
        F.col("o_idx").cast("long").alias("pos"),
    )


def column_headers(cells: DataFrame) -> DataFrame:
    """Header cells wholly above a cell whose columns overlap it."""
    return _overlap_edges(
        cells, cells.where("column_header"), "col", "column_headers", F.col("o_row_end") <= F.col("row_start")
    )


def row_headers(cells: DataFrame) -> DataFrame:
    return _overlap_edges(cells, cells.where("row_header"), "row", "row_headers", F.col("o_idx") != F.col("idx"))


def row_labels(cells: DataFrame) -> DataFrame:
    """First-column labels of the same row, whether or not flagged as row headers."""
    first = cells.where("col_start = 0 AND NOT column_header AND NOT row_section")
    return _overlap_edges(cells, first, "row", "row_labels", F.col("o_idx") != F.col("idx"))


def row_sections(cells: DataFrame) -> DataFrame:
    """Nearest section row above a cell, with ties.

    The as-of lookup is one running maximum over cells and section ends, inside blocks of a table's rows, which begin
    with what the blocks above them carry down. A later-ending section need not start later, so it is a maximum of starts;
    each start brings the few section cells of its row, so cells are shuffled and sorted once.
    """
    key = [*DOC, "item_ref"]
    block = F.floor(F.col("row") / F.lit(skew.BLOCK)).alias("block")
    section = F.struct("row_start", "ties").alias("section")
    ends = (
        cells.where("row_section AND row_start IS NOT NULL AND row_end IS NOT NULL")
        .groupBy(*key, "row_start")
        .agg(F.sort_array(F.collect_list(F.struct("idx", F.col("row_end").cast("long").alias("row_end")))).alias("ties"))
        .select(*key, section, F.explode(F.array_distinct("ties.row_end")).alias("row"))
        .select(*key, block, "row", F.lit(None).cast("int").alias("idx"), F.lit(False).alias("cell"), "section")
    )
    rows = cells.select(*key, F.col("row_start").cast("long").alias("row"), "idx").select(*key, block, "row", "idx", F.lit(True).alias("cell"))
    above = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.select(*key, "block").distinct()
        .unionByName(ends.select(*key, "block", "section"), allowMissingColumns=True)
        .groupBy(*key, "block").agg(F.max("section").alias("section"))
        .select(*key, "block", F.max("section").over(above).alias("section"))
        .where("section IS NOT NULL")
        .select(*key, "block", (F.col("block") * skew.BLOCK - 1).alias("row"), F.lit(None).cast("int").alias("idx"), F.lit(False).alias("cell"), "section")
    )
    so_far = Window.partitionBy(*key, "block").orderBy("row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = rows.unionByName(ends, allowMissingColumns=True).unionByName(carried).withColumn("section", F.max("section").over(so_far))
    ended = F.filter("section.ties", lambda o: o["row_end"] <= F.col("row"))
    return nearest.where("cell AND section IS NOT NULL").select(*key, "idx", F.explode(ended).alias("o")).select(
        *DOC,
        cell_id("item_ref", "idx").alias("evidence_id"),
        F.lit("row_sections").alias("role"),
        cell_id("item_ref", "o.idx").alias("ref"),
        F.col("o.idx").cast("long").alias("pos"),
    )


def cell_context(cells: DataFrame) -> DataFrame:
    """All structural edges between the cells of a table."""
    return (
        column_headers(cells)
        .unionByName(row_headers(cells))
        .unionByName(row_labels(cells))
        .unionByName(row_sections(cells))
    )


def inherited_context(cells: DataFrame, item_context: DataFrame) -> DataFrame:
    """Captions and footnotes of a table, repeated on each of its cells."""
    parents = item_context.select(*DOC, "item_ref", "role", "ref", "pos")
    joined = skew.salted_join(cells.select(*DOC, "item_ref", "idx"), parents, [*DOC, "item_ref"], spread=["idx"])
    return joined.select(*DOC, cell_id("item_ref", "idx").alias("evidence_id"), "role", "ref", "pos")


def own_context(item_context: DataFrame) -> DataFrame:
    return item_context.select(*DOC, F.col("item_ref").alias("evidence_id"), "role", "ref", "pos")


def table_members(cells: DataFrame) -> DataFrame:
    """Ordered membership edges from a table to its cells."""
    return cells.select(
        *DOC,
        F.col("item_ref").alias("evidence_id"),
        F.lit("cells").alias("role"),
        cell_id("item_ref", "idx").alias("ref"),
        F.col("idx").cast("long").alias("pos"),
    )


def full_context(cells: DataFrame, item_context: DataFrame) -> DataFrame:
    return (
        own_context(item_context)
        .unionByName(inherited_context(cells, item_context))
        .unionByName(table_members(cells))
        .unionByName(cell_context(cells))
    )


def integrity_violations(units: DataFrame, context: DataFrame, pages: DataFrame) -> DataFrame:
    """Broken rules of an index, whoever produced it: one row per rule and unit."""
    known = units.select(*DOC, F.col("evidence_id").alias("ref"))
    unresolved = (
        context.join(known, [*DOC, "ref"], "left_anti")
        .select(*DOC, "evidence_id", F.lit("unresolved_context_reference").alias("rule"))
        .distinct()
    )
    cells = units.where("kind = 'table_cell'")
    parents = units.where("kind = 'table'").select(*DOC, F.col("evidence_id").alias("item_ref"))
    orphan = cells.join(parents, [*DOC, "item_ref"], "left_anti").select(
        *DOC, "evidence_id", F.lit("cell_without_table").alias("rule")
    )
    coordinates = units.where((F.col("kind") == "table_cell") != F.col("row_start").isNotNull()).select(
        *DOC, "evidence_id", F.lit("coordinates_only_on_cells").alias("rule")
    )
    misplaced = unknown_page_locations(units, pages).select(
        *DOC, "evidence_id", F.lit("unknown_page").alias("rule")
    ).distinct()
    return unresolved.unionByName(orphan).unionByName(coordinates).unionByName(misplaced)


def kind_histogram(units: DataFrame) -> DataFrame:
    return units.groupBy(*DOC, "kind").agg(F.count("*").alias("units"))


def issue_histogram(units: DataFrame) -> DataFrame:
    return (
        units.select(*DOC, F.explode("issues").alias("issue"))
        .groupBy(*DOC, "issue")
        .agg(F.count("*").alias("units"))
    )


def display_rect(bbox: Column, width: Column, height: Column, tolerance: float = 0.01) -> Column:
    """Top-left rectangle in page fractions; null when the box leaves the page."""
    left, right = F.least(bbox["l"], bbox["r"]), F.greatest(bbox["l"], bbox["r"])
    low, high = F.least(bbox["t"], bbox["b"]), F.greatest(bbox["t"], bbox["b"])
    flipped = bbox["coord_origin"] == "BOTTOMLEFT"
    top = F.when(flipped, height - high).otherwise(low)
    bottom = F.when(flipped, height - low).otherwise(high)
    valid = (
        (width > 0)
        & (height > 0)
        & (left >= -tolerance)
        & (top >= -tolerance)
        & (right <= width + tolerance)
        & (bottom <= height + tolerance)
        & (right > left)
        & (bottom > top)
    )
    zero = F.lit(0.0)
    return F.when(
        valid,
        F.struct(
            (F.greatest(zero, left) / width).alias("left"),
            (F.greatest(zero, top) / height).alias("top"),
            (F.least(width, right) / width).alias("right"),
            (F.least(height, bottom) / height).alias("bottom"),
        ),
    )


def display_rects(units: DataFrame, pages: DataFrame) -> DataFrame:
    placed = units.select(*DOC, "evidence_id", F.explode("locations").alias("place")).select(
        *DOC, "evidence_id", "place.page_no", "place.bbox"
    )
    return placed.join(pages, [*DOC, "page_no"], "left").select(
        *DOC, "evidence_id", "page_no", display_rect(F.col("bbox"), F.col("width"), F.col("height")).alias("rect")
    )


def table_labels(units: DataFrame, context: DataFrame) -> DataFrame:
    """`Table N` from the caption text, else the item reference."""
    texts = units.select(*DOC, F.col("evidence_id").alias("ref"), F.col("text").alias("caption"))
    captions = (
        context.where("role = 'captions'")
        .join(units.where("kind = 'table'").select(*DOC, "evidence_id"), [*DOC, "evidence_id"], "left_semi")
        .join(texts, [*DOC, "ref"])
        .groupBy(*DOC, "evidence_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "caption"))).alias("parts"))
        .select(*DOC, "evidence_id", F.array_join("parts.caption", " ").alias("caption"))
    )
    number = F.regexp_extract("caption", r"(?i)\btable\s+(\d+)\b", 1)
    return (
        units.where("kind = 'table'")
        .select(*DOC, "evidence_id")
        .join(captions, [*DOC, "evidence_id"], "left")
        .select(
            *DOC,
            "evidence_id",
            F.when(F.length(number) > 0, F.concat(F.lit("Table "), number))
            .otherwise(F.col("evidence_id"))
            .alias("table_label"),
        )
    )


def inventory(units: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per-document counts: pages, chunks, headings, formulas, flagged cells."""
    formula = F.col("label") == "formula"
    counts = units.groupBy(*DOC).agg(
        F.count_if(F.col("label") == "section_header").alias("headings"),
        F.count_if(formula).alias("formula_regions"),
        F.count_if(formula & ~has_text("text")).alias("empty_formulas"),
        F.count_if((F.col("kind") == "table_cell") & (F.size("issues") > 0)).alias("table_warnings"),
    )
    return (
        counts.join(pages.groupBy(*DOC).agg(F.countDistinct("page_no").alias("pages")), DOC, "left")
        .join(chunks.groupBy(*DOC).agg(F.count("*").alias("chunks")), DOC, "left")
        .select(
            *DOC,
            F.coalesce("pages", F.lit(0)).cast("long").alias("pages"),
            F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"),
            "headings",
            "formula_regions",
            "empty_formulas",
            "table_warnings",
        )
    )


def layout_detections(items: DataFrame) -> DataFrame:
    """Running tag per label (`P001`): the label's initial and its ordinal in the document."""
    prefix = F.when(F.col("label").isin("page_header", "page_footer"), F.concat(F.lit("P"), F.upper(F.substring(F.split("label", "_")[1], 1, 1)))).otherwise(
        F.upper(F.substring("label", 1, 1))
    )
    numbered = skew.ordinal(items, [*DOC, "label"], "pos", "label_no", start=1)
    return numbered.select(
        *DOC,
        "pos",
        "label",
        "page_no",
        F.concat(prefix, F.when(F.col("label_no") < 1000, F.lpad(F.col("label_no").cast("string"), 3, "0")).otherwise(F.col("label_no").cast("string"))).alias("tag"),
    )


def detections_per_page(items: DataFrame) -> DataFrame:
    return items.groupBy(*DOC, "page_no", "label").agg(F.count("*").alias("detections"))


def picture_sources(pictures: DataFrame, captions: DataFrame, pages: DataFrame, min_area: float = 0.0) -> DataFrame:
    """Caption-first text of a figure; uncaptioned figures below the area threshold are skipped.

    pictures(document_id, picture_ref, page_no, bbox); captions(document_id, picture_ref, pos, text).
    """
    usable = captions.where(has_text("text"))
    reused = usable.groupBy(*DOC, "picture_ref").agg(
        F.sort_array(F.collect_list(F.struct("pos", strip("text").alias("text")))).alias("parts")
    )
    box = F.col("bbox")
    area = F.abs(box["r"] - box["l"]) * F.abs(box["t"] - box["b"]) / (F.col("width") * F.col("height"))
    share = F.when(F.col("width") * F.col("height") > 0, area)
    status = (
        F.when(F.col("parts").isNotNull(), "caption_reused")
        .when(share < min_area, "skipped")
        .otherwise("pending")
    )
    return (
        pictures.join(reused, [*DOC, "picture_ref"], "left")
        .join(pages, [*DOC, "page_no"], "left")
        .select(
            *DOC,
            "picture_ref",
            status.alias("status"),
            F.when(F.col("parts").isNotNull(), F.array_join("parts.text", "\n")).alias("text"),
            F.round(share, 5).alias("page_area_fraction"),
        )
    )


def unit_title(text_col: Column, caption: Column, kind: Column) -> Column:
    """Caption, else own text, else what kind of region it is. `kind` may be a label, too: formula or picture."""
    filled = [F.when(F.length(c) > 0, c) for c in (caption, text_col)]
    # What is shown for a unit without words.
    region = F.when(kind == "formula", "Equation · transcription unavailable").when(kind == "picture", "Figure · source region")
    return F.coalesce(*filled, region, F.lit("Table · source region"))


def captions_of(units: DataFrame) -> DataFrame:
    """(document_id, evidence_id, caption): texts of a unit's captions in their order, empty ones left out.

    units(document_id, evidence_id, text, captions array of evidence ids)
    """
    named = units.select(*DOC, "evidence_id", F.posexplode("captions").alias("no", "ref"))
    texts = units.select(*DOC, F.col("evidence_id").alias("ref"), F.col("text").alias("part")).where("length(part) > 0")
    return named.join(texts, [*DOC, "ref"]).groupBy(*DOC, "evidence_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda x: x["part"]), " ").alias("caption")
    )


def search_units(units: DataFrame, needle: str, kinds: list[str] | None = None, limit: int = 200) -> DataFrame:
    """Units of a category whose title contains a substring; the first `limit` in document order.

    The title is the caption where `captions` names one, so a table or picture is found by its caption.
    """
    named = units.join(captions_of(units), [*DOC, "evidence_id"], "left") if "captions" in units.columns else units.withColumn("caption", F.lit(None).cast("string"))
    kind = F.when(F.col("label") == "formula", F.col("label")).otherwise(F.col("kind")) if "label" in units.columns else F.col("kind")
    hits = named.withColumn("title", unit_title(F.col("text"), F.col("caption"), kind)).drop("caption").where(F.contains(F.lower("title"), F.lit(needle.lower())))
    if kinds:
        hits = hits.where(F.col("kind").isin(kinds))
    return skew.top_k(hits, DOC, [F.col("pos"), F.col("evidence_id")], limit, "hit_no")


def filter_library(papers: DataFrame, needle: str, state: str = "all") -> DataFrame:
    """Library rows by substring of title or file name and by extraction state."""
    text_hit = F.contains(F.lower(F.concat_ws(" ", "title", "filename")), F.lit(needle.lower()))
    rows = papers.where(text_hit)
    if state == "extracted":
        rows = rows.where("processed")
    elif state == "source_only":
        rows = rows.where("NOT processed")
    return rows


def anchors(refs: DataFrame, units: DataFrame) -> DataFrame:
    """Text, places and flags of each reference."""
    return refs.join(
        units.select(*DOC, F.col("evidence_id").alias("ref"), "text", "locations", "issues"), [*DOC, "ref"]
    )


#: Characters of a gram, and how many of its rarest grams a unit must hold before it is compared with a quote.
GRAM, GRAMS = 3, 4


def _by_grams(needles: DataFrame, bodies: DataFrame, size: int) -> DataFrame:
    """(document_id, quote_id, evidence_id) of needles inside bodies, through an index of the grams that needles have.

    needles(document_id, quote_id, needle of `size` characters or more), bodies(document_id, evidence_id, body). Of every needle
    the grams that fewest units of its document hold are counted; only units that hold all of these are compared.
    """
    # One pass over a text: a substring by its number would count from the beginning for each of them.
    runs = lambda c: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    grams = needles.select(*DOC, "quote_id", F.explode(F.array_distinct(runs(F.col("needle")))).alias("gram"))
    wanted = grams.select(*DOC, "gram").distinct()
    held = skew.shuffled_join(bodies.select(*DOC, "evidence_id", F.explode(F.array_distinct(runs(F.col("body")))).alias("gram")), wanted, [*DOC, "gram"], "left_semi")
    frequency = held.groupBy(*DOC, "gram").agg(F.count("*").alias("df"))
    # A gram that no unit holds comes first, and leaves nothing to count.
    ranked = skew.top_k(skew.shuffled_join(grams, frequency, [*DOC, "gram"], "left"), [*DOC, "quote_id"], [F.coalesce("df", F.lit(0)), F.col("gram")], GRAMS, "place")
    asked = ranked.groupBy(*DOC, "quote_id").agg(F.count("*").alias("asked"))
    met = skew.shuffled_join(ranked.select(*DOC, "quote_id", "gram"), held, [*DOC, "gram"]).groupBy(*DOC, "quote_id", "evidence_id").agg(F.count("*").alias("met"))
    full = skew.shuffled_join(met, asked, [*DOC, "quote_id"]).where("met = asked").select(*DOC, "quote_id", "evidence_id")
    compared = skew.shuffled_join(skew.shuffled_join(full, needles, [*DOC, "quote_id"]), bodies, [*DOC, "evidence_id"])
    return compared.where(F.contains("body", "needle")).select(*DOC, "quote_id", "evidence_id")


def locate_quotes(quotes: DataFrame, units: DataFrame, short: int = 12, bodies: DataFrame | None = None) -> DataFrame:
    """Units containing a quote after normalisation.

    quotes(document_id, quote_id, quote, source_ref); units(document_id, evidence_id, text).
    With a known reference only that unit is tested; a quote shorter than `short`
    must equal it.  Other quotes are looked up through their rarest inner word, so no
    document is scanned once per quote; quotes without an inner word (at most two
    words) are looked up through their rarest runs of three characters.
    bodies(document_id, evidence_id, body): the units' normalized texts, where the caller has them.
    """
    q = quotes.select(*DOC, "quote_id", "source_ref", text.normalized("quote").alias("needle"))
    u = units.select(*DOC, "evidence_id", text.normalized("text").alias("body")) if bodies is None else bodies
    known = u.withColumnRenamed("evidence_id", "source_ref")
    at_ref = skew.shuffled_join(q, known, [*DOC, "source_ref"])
    exact = at_ref.where(
        F.when(F.length("needle") < short, (F.length("needle") >= 2) & (F.col("needle") == F.col("body")))
        .otherwise(F.contains("body", "needle"))
    ).select(*DOC, "quote_id", F.col("source_ref").alias("evidence_id"))

    free = skew.shuffled_join(q.where(F.length("needle") >= short), known.select(*DOC, "source_ref"), [*DOC, "source_ref"], "left_anti")
    words = lambda c: F.regexp_extract_all(c, F.lit(rf"({text.WORD}+)"), F.lit(1))
    free = stage(free.withColumn("__words", words(F.col("needle"))))
    several = F.size("__words") >= 3
    n_long, n_brief = free.agg(F.count_if(several), F.count_if(~several)).first()
    found = exact
    if n_brief:
        found = found.unionByName(_by_grams(free.where(~several).select(*DOC, "quote_id", "needle"), u, max(1, min(GRAM, short))))
    if not n_long:  # texts are read for words only if a quote is looked for by its words
        return found
    inner = F.array_distinct(F.slice("__words", F.lit(2), F.greatest(F.size("__words") - 2, F.lit(0))))
    long = free.where(several).select(*DOC, "quote_id", "needle", F.explode(inner).alias("word"))
    wanted = long.select(*DOC, "word").distinct()
    postings = skew.shuffled_join(
        u.select(*DOC, "evidence_id", F.explode(F.array_distinct(words(F.col("body")))).alias("word")), wanted, [*DOC, "word"], "left_semi"
    )
    frequency = postings.groupBy(*DOC, "word").agg(F.count("*").alias("df"))
    rarest = (
        skew.shuffled_join(long, frequency, [*DOC, "word"], "left")
        .groupBy(*DOC, "quote_id")
        .agg(
            F.min_by(F.struct("word", "needle"), F.struct("df", "word")).alias("k"),
            F.bool_or(F.col("df").isNull()).alias("absent"),
        )
        .where("NOT absent")
        .select(*DOC, "quote_id", "k.word", "k.needle")
    )
    via_word = (
        skew.shuffled_join(skew.shuffled_join(rarest, postings, [*DOC, "word"]), u, [*DOC, "evidence_id"])
        .where(F.contains("body", "needle"))
        .select(*DOC, "quote_id", "evidence_id")
    )
    return found.unionByName(via_word)
