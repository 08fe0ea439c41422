"""Scans of saved layouts, results, chunks, graph tables and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta import schemas
from attesta.functions.text import strip

# The schema name of an exported layout, the first bytes of a PDF and the title of a document without one.
LAYOUT_SCHEMA = "DoclingDocument"
PDF_MAGIC = b"%PDF-"
UNTITLED = "Selected document"
ARXIV_ID = r"^(?:\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}|[a-z][a-z.-]*/\d{7})(?:v[1-9]\d*)?$"
DOC = ["document_id"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(filename, path, content, sha256, length) of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(file_name(F.col("path")).alias("filename"), "path", "content", F.sha2("content", 256).alias("sha256"), "length")


def read_layouts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of exported layout files; the id is the hash of the exact bytes."""
    body = F.decode("content", "UTF-8")
    parsed = files.select("filename", F.col("sha256").alias("document_id"), F.from_json(body, schemas.LAYOUT).alias("d"))
    return layout_documents(parsed)


def layout_documents(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parsed(filename, document_id, d) split into layouts and rejects."""
    reason = F.when(F.col("d.schema_name").isNull() | (F.col("d.schema_name") != LAYOUT_SCHEMA), "not_an_exported_layout").when(
        F.coalesce("d.origin.filename", "d.name").isNull(), "no_source_filename"
    )
    checked = parsed.withColumn("reason", reason)
    documents = checked.where("reason IS NULL").select(
        *DOC, "filename", F.coalesce("d.origin.filename", "d.name").alias("source_filename"), F.col("d.version").alias("version"), "d"
    )
    return documents, checked.where("reason IS NOT NULL").select("filename", *DOC, "reason")


def canonical_identity(df: DataFrame) -> DataFrame:
    """Identity of in-memory rows: hash of their JSON with columns in name order."""
    return df.withColumn("document_id", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))


def bind_sources(documents: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Source fingerprints by file name; null where the PDF is absent."""
    named = pdfs.select(F.col("filename").alias("source_filename"), F.col("sha256").alias("source_sha256"))
    return documents.join(named, "source_filename", "left")


def layout_pages(documents: DataFrame) -> DataFrame:
    return documents.select(*DOC, F.explode(F.map_values("d.pages")).alias("p")).select(
        *DOC, "p.page_no", F.col("p.size.width").alias("width"), F.col("p.size.height").alias("height")
    )


def layout_items(documents: DataFrame) -> DataFrame:
    """Texts, tables and pictures in collection order."""
    def part(collection: str, kind: str, order: int) -> DataFrame:
        places = F.transform(
            F.coalesce("i.prov", F.array()),
            lambda p: F.struct(p["page_no"].alias("page_no"), p["bbox"].alias("bbox"), F.lit("item").alias("granularity"), p["charspan"].alias("charspan")),
        )
        return documents.select(*DOC, F.posexplode(f"d.{collection}").alias("n", "i")).select(
            *DOC, (F.lit(order).cast("long") * 1_000_000_000 + F.col("n")).alias("pos"), F.col("i.self_ref").alias("item_ref"), F.lit(kind).alias("kind"),
            F.col("i.label").alias("label"), F.coalesce("i.text", F.lit("")).alias("text"), F.col("i.orig").alias("orig"), F.col("i.level").alias("level"), places.alias("locations"),
        )

    return part("texts", "text", 0).unionByName(part("tables", "table", 1)).unionByName(part("pictures", "picture", 2))


def layout_context(documents: DataFrame) -> DataFrame:
    """Caption and footnote references of every item."""
    out = None
    for collection in ("texts", "tables", "pictures"):
        for role in ("captions", "footnotes"):
            refs = documents.select(*DOC, F.explode(f"d.{collection}").alias("i")).select(
                *DOC, F.col("i.self_ref").alias("item_ref"), F.lit(role).alias("role"), F.posexplode(f"i.{role}").alias("pos", "r")
            ).select(*DOC, "item_ref", "role", F.col("r.$ref").alias("ref"), F.col("pos").cast("long").alias("pos"))
            out = refs if out is None else out.unionByName(refs)
    return out


def layout_tables(documents: DataFrame) -> DataFrame:
    return documents.select(*DOC, F.explode("d.tables").alias("i")).select(
        *DOC, F.col("i.self_ref").alias("item_ref"), F.col("i.data.num_rows").alias("num_rows"), F.col("i.data.num_cols").alias("num_cols")
    )


def layout_cells(documents: DataFrame) -> DataFrame:
    flag = lambda n: F.coalesce(F.col(f"c.{n}"), F.lit(False)).alias(n)
    return (
        documents.select(*DOC, F.explode("d.tables").alias("i"))
        .select(*DOC, F.col("i.self_ref").alias("item_ref"), F.posexplode("i.data.table_cells").alias("idx", "c"))
        .select(
            *DOC, "item_ref", "idx", F.col("c.start_row_offset_idx").alias("row_start"), F.col("c.end_row_offset_idx").alias("row_end"),
            F.col("c.start_col_offset_idx").alias("col_start"), F.col("c.end_col_offset_idx").alias("col_end"),
            flag("column_header"), flag("row_header"), flag("row_section"), F.col("c.text").alias("text"), F.col("c.bbox").alias("bbox"),
        )
    )


# ---- records in files ----------------------------------------------------------------
def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, block, at): lines that aren't blank, where they come from, and an order inside a block of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _parsed(lines: DataFrame, schema: T.StructType | str, required: tuple[str, ...]) -> DataFrame:
    """The lines with their record `r`, or the reason why there is none."""
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*typed.fields, T.StructField("__corrupt", T.StringType())])
    r = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    out = lines.withColumn("r", r)
    reason = F.when(F.try_parse_json("value").isNull(), "not_json").when(F.col("r").isNull() | F.col("r.__corrupt").isNotNull(), "not_of_the_schema")
    for name in required:
        reason = reason.when(F.col(f"r.{name}").isNull(), f"without_{name}")
    return out.withColumn("reason", F.when(F.trim("value") != "", reason))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """Records of JSON lines that have the declared schema and all required fields; the others are in `quarantine`."""
    parsed = _parsed(_lines(spark, path), schema, required)
    return parsed.where("reason IS NULL AND trim(value) <> ''").select("r.*").drop("__corrupt")


def quarantine(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """(path, offset, reason, value) of the lines that are no records, offset in bytes from the beginning of the file.

    A block of a file holds the lines that begin in it, so its own length is that of its lines; offsets add up blocks
    first and the lines of the one block then. Only positions and lengths are shuffled.
    """
    parsed = _parsed(_lines(spark, path), schema, required)
    measured = parsed.select("path", "block", "at", (F.octet_length("value") + 1).cast("long").alias("size"), "reason", F.when(F.col("reason").isNotNull(), F.col("value")).alias("value"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = measured.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    blocks = measured.groupBy("path", "block").agg(F.sum("size").alias("whole"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("start"))
    return placed.where("reason IS NOT NULL").join(starts, ["path", "block"]).select("path", (F.col("start") + F.col("before")).alias("offset"), "reason", "value")


RESULT_FIELDS = ("schema_version", "document_id", "records")
INDEX_FIELDS = ("document_id", "evidence_id")
CHUNK_FIELDS = ("chunk_id", "contextualized_text", "source_refs")
LEDGER_FIELDS = ("completion_calls",)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Curated result collections, one document a file; a wrong type fails the read."""
    return spark.read.schema(schemas.COLLECTION).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Curated result collections, one a line."""
    return read_records(spark, path, schemas.COLLECTION, RESULT_FIELDS)


def read_index(spark: SparkSession, path: str, schema) -> DataFrame:
    """Units of a normalized index written by another producer, with a strict schema."""
    return read_records(spark, path, schema, INDEX_FIELDS)


def read_chunks(spark: SparkSession, path: str, schema) -> DataFrame:
    return read_records(spark, path, schema, CHUNK_FIELDS)


def read_graph_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}


def read_graph_table(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(rows, files without readable rows) of a table whose folder may hold damaged files; the schema is declared, not guessed."""
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    read = rows.select(plain(F.col("_metadata.file_path")).alias("path")).distinct()
    files = spark.read.format("binaryFile").load(path).select(plain(F.col("path")).alias("path"), "length")
    return rows, files.join(read, "path", "left_anti").withColumn("reason", F.lit("no_readable_rows"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per provider call of saved ledgers, one ledger a file."""
    ledgers = spark.read.schema(schemas.LEDGER).option("multiLine", "true").json(path).withColumn("ledger", F.input_file_name())
    return ledgers.select("ledger", F.posexplode("completion_calls").alias("call_no", "c")).select("ledger", "call_no", "c.*")


def read_ledger_lines(spark: SparkSession, path: str, schema=schemas.LEDGER) -> DataFrame:
    """One row per provider call of saved ledgers, one ledger a line."""
    return read_records(spark, path, schema, LEDGER_FIELDS).select(F.posexplode("completion_calls").alias("call_no", "c")).select("call_no", "c.*")


# ---- profiles ------------------------------------------------------------------------
def source_profile(items: DataFrame) -> DataFrame:
    """Counts per document: kinds, labels, provenance."""
    labels = items.groupBy(*DOC, "label").agg(F.count("*").alias("n")).groupBy(*DOC).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    counts = items.groupBy(*DOC).agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("text", "table", "picture")],
        F.count_if(F.size("locations") > 0).alias("with_provenance"),
    )
    return counts.join(labels, DOC, "left")


def heading_levels(items: DataFrame) -> DataFrame:
    return items.where("label = 'section_header'").groupBy(*DOC, "level").agg(F.count("*").alias("headings"))


def document_profile(documents: DataFrame, items: DataFrame, max_headings: int = 60, max_chars: int = 160, max_title: int = 500) -> DataFrame:
    """Title of each document and its first distinct titles and headings, in order; documents without headings have none.

    documents(document_id, title, name): the title given, else the name, else a placeholder.
    """
    from attesta.functions.skew import top_k

    body = strip("text")
    heads = items.where(F.col("label").isin("title", "section_header") & (F.length(body) > 0)).select(*DOC, "pos", body.alias("h"))
    first = heads.groupBy(*DOC, "h").agg(F.min("pos").alias("pos"))
    kept = top_k(first, DOC, [F.asc("pos")], max_headings, "place")
    listed = kept.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("place", F.substring("h", 1, max_chars).alias("h")))).alias("x")).select(*DOC, F.col("x.h").alias("headings"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    title = F.substring(F.coalesce(filled("title"), filled("name"), F.lit(UNTITLED)), 1, max_title)
    return documents.select(*DOC, title.alias("title")).join(listed, DOC, "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<string>")))


# ---- identifiers and receipts --------------------------------------------------------
def arxiv_identifiers(df: DataFrame, column: str) -> DataFrame:
    """Normalized arXiv id, or the reason it is refused."""
    raw = strip(column)
    value = F.when(raw.startswith("arxiv:"), F.substring(raw, F.lit(7), F.length(raw))).otherwise(raw)
    is_url = F.contains(value, F.lit("://"))
    scheme = F.lower(F.substring_index(value, "://", 1))
    rest = F.substring(value, F.instr(value, "://") + 3, F.length(value))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    ident = F.regexp_replace(F.when(is_url, F.regexp_replace(path, r"^/(?:abs|pdf)/", "")).otherwise(value), r"\.pdf$", "")
    reason = (
        F.when(is_url & ((scheme != "https") | ~host.isin("arxiv.org", "www.arxiv.org")), "not_an_https_arxiv_url")
        .when(is_url & rest.rlike(r"[?#]."), "query_or_fragment")
        .when(is_url & ~path.rlike("^/(?:abs|pdf)/"), "not_an_abs_or_pdf_url")
        .when(~ident.rlike(ARXIV_ID), "invalid_identifier")
    )
    return df.withColumn("reason", reason).withColumn("arxiv_id", F.when(F.col("reason").isNull(), ident))


def receipt_faults(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Cached downloads that are no PDF or no longer match their receipt.

    files(filename, content, sha256); receipts(filename, sha256, arxiv_id)
    """
    r = receipts.select("filename", F.col("sha256").alias("expected"), "arxiv_id")
    named = F.replace(F.regexp_replace("filename", r"\.pdf$", ""), F.lit("_"), F.lit("/"))
    fault = F.when(F.substring("content", 1, 5) != F.lit(PDF_MAGIC), "not_a_pdf").when(
        (F.col("expected") != F.col("sha256")) | (F.col("arxiv_id") != named), "receipt_mismatch"
    )
    return files.join(r, "filename", "left").withColumn("fault", fault).where("fault IS NOT NULL").select("filename", "fault")


def fingerprint_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Files added, removed or altered between two directory manifests (path, sha256).

    `keys` tell files apart, one row each in a manifest; they hold more than the path where files may share one.
    """
    if "path" not in keys:
        raise ValueError("keys must hold the path")
    b = before.select("path", *[k for k in keys if k != "path"], F.struct(F.col("sha256")).alias("old"))
    a = after.select("path", *[k for k in keys if k != "path"], F.struct(F.col("sha256")).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "altered")
    return b.join(a, list(keys), "full").select("path", change.alias("change")).where("change IS NOT NULL")
