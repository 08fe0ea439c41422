"""Explicit schemas of the JSON inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


STR, INT, DBL, BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
REF = struct(("$ref", STR))
BBOX = struct(("l", DBL), ("t", DBL), ("r", DBL), ("b", DBL), ("coord_origin", STR))
PROV = struct(("page_no", INT), ("bbox", BBOX), ("charspan", T.ArrayType(INT)))
CELL = struct(
    ("text", STR), ("start_row_offset_idx", INT), ("end_row_offset_idx", INT), ("start_col_offset_idx", INT),
    ("end_col_offset_idx", INT), ("bbox", BBOX), ("column_header", BOOL), ("row_header", BOOL), ("row_section", BOOL),
)
_COMMON = (("self_ref", STR), ("label", STR), ("text", STR), ("orig", STR), ("level", INT), ("parent", REF), ("prov", T.ArrayType(PROV)))
_OWNER = (*_COMMON, ("captions", T.ArrayType(REF)), ("footnotes", T.ArrayType(REF)))
GRID = struct(("num_rows", INT), ("num_cols", INT), ("table_cells", T.ArrayType(CELL)))
DESCRIPTION = struct(("text", STR), ("created_by", STR))
LAYOUT = struct(
    ("schema_name", STR),
    ("version", STR),
    ("name", STR),
    ("origin", struct(("filename", STR))),
    ("pages", T.MapType(STR, struct(("page_no", INT), ("size", struct(("width", DBL), ("height", DBL)))))),
    ("texts", T.ArrayType(struct(*_OWNER))),
    ("tables", T.ArrayType(struct(*_OWNER, ("data", GRID)))),
    ("pictures", T.ArrayType(struct(*_OWNER, ("meta", struct(("description", DESCRIPTION)))))),
)
LINK = struct(("evidence_id", STR), ("quote", STR))
NAME = struct(("reported", STR), ("normalized", STR))
RECORD = struct(
    ("result_id", STR), ("document_id", STR), ("method", NAME), ("variant", STR), ("role", STR),
    ("benchmark", struct(("dataset", NAME), ("task", STR), ("split", STR), ("subset", STR), ("evidence", T.ArrayType(LINK)))),
    ("metric", struct(("name", NAME), ("direction", STR), ("unit", STR), ("reported_scale", STR), ("definition_evidence", T.ArrayType(LINK)))),
    ("value", struct(("raw", STR), ("numeric", DBL), ("uncertainty", STR))),
    ("value_evidence", LINK), ("method_evidence", LINK), ("metric_evidence", T.ArrayType(LINK)),
    ("conditions", T.ArrayType(struct(("key", STR), ("value", STR), ("basis", STR), ("evidence", T.ArrayType(LINK))))),
    ("review", struct(("status", STR), ("reviewer", STR), ("note", STR))), ("notes", T.ArrayType(STR)),
)
COLLECTION = struct(
    ("schema_version", STR), ("document_id", STR),
    ("run", struct(("extractor", STR), ("model", STR), ("created_at", T.TimestampType()), ("configuration", T.MapType(STR, STR)))),
    ("records", T.ArrayType(RECORD)),
)
CALL = struct(
    ("status", STR), ("request_hash", STR), ("logical_request_hash", STR), ("model", STR), ("reserved_tokens", T.LongType()),
    ("source_record_ids", T.ArrayType(STR)), ("response_schema", STR), ("seconds", DBL), ("usage", struct(("total_tokens", T.LongType()))),
    ("finish_reason", STR), ("status_code", INT), ("retryable", BOOL), ("error", STR),
)
LEDGER = struct(("completion_calls", T.ArrayType(CALL)), ("elapsed_seconds", DBL))
