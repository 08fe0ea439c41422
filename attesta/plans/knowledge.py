"""Extraction records, quoted relations and research records over documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.stage import stage
from attesta.functions.text import metric_name
from attesta.operators import extraction as X
from attesta.operators import relations as R
from attesta.operators import research as S
from attesta.operators import units as U
from attesta.plans import duck, fixtures as fx, query
from attesta.plans.chunking import grid_context
from attesta.plans.evidence import D_CELLS, D_ITEMS, NORM, cells, grid_items

# A response per document: two entities named by its first words, a repeated, a marked and
# an absent one, and four relations of which one at most is well formed.
WORDS = """SELECT doc_id, source, text, split(text, ' ')[0] AS w1, coalesce(split(text, ' ')[1], 'x') AS w2, coalesce(split(text, ' ')[2], 'x') AS w3,
  CASE WHEN doc_id % 3 <> 0 THEN 'Method' ELSE 'Metric' END AS t1, CASE WHEN doc_id % 2 = 0 THEN 'Dataset' WHEN doc_id % 7 = 0 THEN 'Metric' ELSE 'Tool' END AS t2,
  CASE doc_id % 6 WHEN 0 THEN 'TRAINED_ON' WHEN 1 THEN 'USES' WHEN 2 THEN 'TRAINED_ON' WHEN 3 THEN 'INITIALIZED_FROM' WHEN 4 THEN 'BUILT_ON' ELSE 'REPORTS' END AS kind FROM {documents}"""
D_WORDS = (
    "SELECT doc_id, source, text, string_split(text, ' ')[1] AS w1, coalesce(string_split(text, ' ')[2], 'x') AS w2, coalesce(string_split(text, ' ')[3], 'x') AS w3,"
    + duck(WORDS).split("AS w3,")[1]
)


def words(t):
    return t.sql(WORDS.replace("split(text, ' ')[1]", "try_element_at(split(text, ' '), 2)").replace("split(text, ' ')[2]", "try_element_at(split(text, ' '), 3)"))


def responses(t):
    return t.documents.select(F.col("doc_id").alias("response_id"), F.col("text").alias("source"))


def entities(t):
    e = lambda pos, name, kind: F.struct(F.lit(pos).alias("pos"), name.alias("name"), kind.alias("type"), F.lit("d").alias("description"))
    w = F.col
    rows = F.array_compact(F.array(
        e(0, w("w1"), w("t1")), e(1, w("w2"), w("t2")), F.when(w("doc_id") % 5 == 0, e(2, F.upper("w1"), F.lit("Concept"))),
        e(3, F.concat("w3", F.lit("##")), F.lit("Tool")), e(4, F.lit("no such entity"), F.lit("Tool"))))
    return words(t).select(F.col("doc_id").alias("response_id"), F.inline(rows))


def relation_rows(t):
    r = lambda pos, s, o, kind, quote: F.struct(F.lit(pos).alias("pos"), s.alias("source"), o.alias("target"), kind.alias("kind"), F.lit("method").alias("scope"), F.lit("d").alias("description"), quote.alias("evidence"))
    head = F.substring("text", 1, 60)
    rows = F.array(
        r(0, F.col("w1"), F.col("w2"), F.col("kind"), head), r(1, F.col("w1"), F.lit("Missing"), F.lit("OTHER"), head),
        r(2, F.col("w1"), F.upper("w1"), F.lit("OTHER"), head), r(3, F.col("w1"), F.col("w2"), F.lit("OTHER"), F.lit("not in any text, surely")))
    return words(t).select(F.col("doc_id").alias("response_id"), F.inline(rows))


MARK = "(contains({0}, '<|>') OR contains({0}, '##'))"
D_X = f"""w AS ({D_WORDS}), src AS (SELECT doc_id AS response_id, {NORM.format('text')} AS sk FROM documents),
en AS (SELECT doc_id AS response_id, 0 AS pos, w1 AS name, t1 AS type FROM w UNION ALL SELECT doc_id, 1, w2, t2 FROM w UNION ALL SELECT doc_id, 2, upper(w1), 'Concept' FROM w WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 3, concat(w3, '##'), 'Tool' FROM w UNION ALL SELECT doc_id, 4, 'no such entity', 'Tool' FROM w),
ek AS (SELECT *, {NORM.format('name')} AS key FROM en), ec AS (SELECT *, count(*) OVER (PARTITION BY response_id, key) AS n FROM ek),
er AS (SELECT ec.response_id, pos, name, type, key, CASE WHEN {MARK.format('name')} THEN 'delimiter_in_entity' WHEN NOT contains(sk, key) THEN 'name_absent_from_source'
   WHEN regexp_matches(name, '(?i)\\bet\\s+al\\.?\\s*,?\\s*[0-9]{{4}}') THEN 'author_year_citation' WHEN regexp_matches(name, '^(?i)(?:appendix\\b|fig(?:ure)?\\.?\\s*[0-9]|tab(?:le)?\\.?\\s*[0-9]|[a-f0-9]{{16,}})') THEN 'document_reference'
   WHEN n > 1 THEN 'ambiguous_duplicate_identity' END AS reason FROM ec JOIN src USING (response_id)),
rl AS (SELECT doc_id AS response_id, 0 AS pos, w1 AS s, w2 AS o, kind, substr(text, 1, 60) AS ev FROM w UNION ALL SELECT doc_id, 1, w1, 'Missing', 'OTHER', substr(text, 1, 60) FROM w
  UNION ALL SELECT doc_id, 2, w1, upper(w1), 'OTHER', substr(text, 1, 60) FROM w UNION ALL SELECT doc_id, 3, w1, w2, 'OTHER', 'not in any text, surely' FROM w),
rk AS (SELECT *, {NORM.format('s')} AS k1, {NORM.format('o')} AS k2, {NORM.format('ev')} AS q FROM rl),
rr AS (SELECT rk.response_id, rk.pos, rk.kind, a.name AS an, b.name AS bn, k1, k2, CASE WHEN a.key IS NULL OR b.key IS NULL THEN 'endpoint_not_declared' WHEN k1 = k2 THEN 'self_relation' WHEN NOT contains(sk, q) THEN 'quote_not_in_source'
  WHEN kind = 'TRAINED_ON' AND (a.type NOT IN ('Method', 'Configuration') OR b.type <> 'Dataset') THEN 'training_endpoint_types' WHEN kind = 'TRAINED_ON' AND NOT contains(q, k2) THEN 'training_quote_without_dataset'
  WHEN kind IN ('BUILT_ON', 'INITIALIZED_FROM') AND b.type NOT IN ('Method', 'Tool', 'Concept') THEN 'dependency_target_type'
  WHEN kind = 'INITIALIZED_FROM' AND len(list_filter(string_split_regex(q, '\\bfrom\\b')[2:], lambda c: contains(c, k2))) = 0 THEN 'initialization_not_stated'
  WHEN b.type = 'Metric' AND kind NOT IN ('REPORTS', 'OTHER', 'DERIVED_FROM', 'USES') THEN 'metric_as_component' WHEN b.type = 'Metric' AND kind IN ('USES', 'DERIVED_FROM') AND a.type <> 'Metric' THEN 'metric_dependency_subject' END AS reason
  FROM rk JOIN src USING (response_id) LEFT JOIN er a ON a.response_id = rk.response_id AND a.key = k1 AND a.reason IS NULL LEFT JOIN er b ON b.response_id = rk.response_id AND b.key = k2 AND b.reason IS NULL)"""


def checked_entities(t):
    return stage(X.check_entities(entities(t), responses(t)))


def checked_relations(t):
    return X.check_relations(relation_rows(t), checked_entities(t).where("reason IS NULL"), responses(t))


query("check_entities", "H1 H2 H4", f"WITH {D_X} SELECT response_id, pos, reason FROM er")(lambda t: checked_entities(t).select("response_id", "pos", "reason"))
query("check_relations", "H5", f"WITH {D_X} SELECT response_id, pos, reason FROM rr")(lambda t: checked_relations(t).select("response_id", "pos", "reason"))
query(
    "check_entities_first_contract",
    "H2 H4",
    f"""WITH {D_X} SELECT response_id, pos, CASE WHEN n > 1 THEN 'ambiguous_duplicate_identity' WHEN {MARK.format('name')} THEN 'delimiter_in_entity' WHEN NOT contains(sk, key) THEN 'name_absent_from_source'
  WHEN regexp_matches(name, '^(?i)(?:appendix\\b|figure\\s+[0-9]|table\\s+[0-9]|[0-9]+\\s+(?:method|experiment)|[a-f0-9]{{16,}})') THEN 'document_reference' END AS reason FROM ec JOIN src USING (response_id)""",
)(lambda t: X.check_entities(entities(t), responses(t), 2).select("response_id", "pos", "reason"))
query(
    "normalized_names",
    "H1",
    f"SELECT doc_id, md5({NORM.format('text')}) AS key FROM documents",
)(lambda t: t.documents.select("doc_id", F.md5(X.normalized("text")).alias("key")))


def suffixed(t):
    w = words(t)
    e = w.select(F.col("doc_id").alias("response_id"), F.lit(0).alias("pos"), F.concat("w2", F.lit(" Dataset")).alias("name"), F.when(F.col("doc_id") % 4 == 3, "Tool").otherwise("Dataset").alias("type"), F.lit("").alias("description"))
    r = w.select(F.col("doc_id").alias("response_id"), F.lit(0).alias("pos"), F.col("w1").alias("source"), F.concat("w2", F.lit(" Dataset")).alias("target"))
    return e, r


query(
    "dataset_aliases",
    "H3",
    f"""WITH w AS ({D_WORDS}) SELECT doc_id AS response_id, CASE WHEN doc_id % 4 <> 3 AND {NORM.format('w2')} NOT IN ('training', 'evaluation', 'our', 'the') THEN trim(w2, E' \\n\\t\\r') ELSE concat(w2, ' Dataset') END AS target FROM w""",
)(lambda t: X.apply_aliases(*suffixed(t))[1].select("response_id", "target"))


def previous(t):
    w = words(t)
    e = lambda pos, name: F.struct(F.lit(pos).alias("pos"), name.alias("name"), F.lit("Tool").alias("type"), F.lit("prior").alias("description"))
    return w.select(F.col("doc_id").alias("response_id"), F.inline(F.array(e(0, F.col("w1")), e(1, F.col("w3")), e(2, F.lit("never said here")))))


def inheritance(t):
    return X.inherited_entities(checked_entities(t), previous(t), responses(t))


D_INH = f"""{D_X}, pv AS (SELECT doc_id AS response_id, 0 AS pos, w1 AS name, {NORM.format('w1')} AS key FROM w UNION ALL SELECT doc_id, 1, w3, {NORM.format('w3')} FROM w),
pok AS (SELECT pv.* FROM pv JOIN src USING (response_id) WHERE NOT {MARK.format('name')} AND contains(sk, key) AND NOT regexp_matches(name, '^(?i)(?:appendix\\b|fig(?:ure)?\\.?\\s*[0-9]|tab(?:le)?\\.?\\s*[0-9]|[a-f0-9]{{16,}})')),
cf AS (SELECT DISTINCT pok.response_id, pok.key FROM pok JOIN er ON er.response_id = pok.response_id AND er.key = pok.key AND er.reason IS NULL AND er.type <> 'Tool'),
ih AS (SELECT response_id, key, arg_max(name, pos) AS name, min(pos) AS pos FROM pok WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.response_id = pok.response_id AND er.key = pok.key) GROUP BY ALL)"""
query("inherited_entities", "H6", f"WITH {D_INH} SELECT response_id, key, name FROM ih")(lambda t: inheritance(t)[0].select("response_id", "key", "name"))
query("inheritance_conflicts", "H6", f"WITH {D_INH} SELECT response_id, key FROM cf")(lambda t: inheritance(t)[1])
query(
    "used_inherited",
    "H6",
    f"""WITH {D_INH} SELECT response_id, key FROM ih JOIN w ON w.doc_id = response_id WHERE key = {NORM.format('w3')}""",
)(lambda t: X.used_inherited(inheritance(t)[0], words(t).select(F.col("doc_id").alias("response_id"), F.lit("zz").alias("source_key"), X.normalized("w3").alias("target_key"))).select("response_id", "key"))


def canonical(t):
    kept = checked_entities(t).where("reason IS NULL").withColumn("part", F.lit(0))
    return X.serialize(responses(t), kept, checked_relations(t).where("reason IS NULL"))


query(
    "canonical_tuples",
    "H8",
    f"""WITH {D_X}, tu AS (SELECT response_id, 0 AS part, pos, concat('("entity"<|>', name, '<|>', type, '<|>d)') AS t FROM er WHERE reason IS NULL
 UNION ALL SELECT response_id, 2, pos, concat('("relationship"<|>', an, '<|>', bn, '<|>', kind, ' [method]: d<|>1)') FROM rr WHERE reason IS NULL),
g AS (SELECT response_id, string_agg(t, concat(chr(10), '##', chr(10)) ORDER BY part, pos) AS body FROM tu GROUP BY response_id)
SELECT doc_id AS response_id, md5(concat(CASE WHEN body IS NULL THEN '' ELSE concat(body, chr(10), '##', chr(10)) END, '<|COMPLETE|>', chr(10), '##', chr(10))) AS canonical FROM documents LEFT JOIN g ON g.response_id = doc_id""",
)(lambda t: canonical(t).withColumn("canonical", F.md5("canonical")))
query(
    "extraction_accounting",
    "H7 H46",
    f"""WITH {D_X} SELECT response_id, count(*) FILTER (WHERE k = 'e') AS raw_entities, count(*) FILTER (WHERE k = 'e' AND reason IS NULL) AS entities, count(*) FILTER (WHERE k = 'r') AS raw_relationships,
  count(*) FILTER (WHERE k = 'r' AND reason IS NULL) AS relationships, count(reason) AS withheld, true AS all_accounted FROM (SELECT response_id, 'e' AS k, reason FROM er UNION ALL SELECT response_id, 'r', reason FROM rr) GROUP BY response_id""",
)(lambda t: X.accounting(checked_entities(t), checked_relations(t)))
query(
    "rejection_histogram",
    "H30 H46",
    f"""WITH {D_X} SELECT record_type, reason, count(*) AS records FROM (SELECT 'entity' AS record_type, reason FROM er UNION ALL SELECT 'relationship', reason FROM rr) WHERE reason IS NOT NULL GROUP BY ALL""",
)(lambda t: X.rejection_histogram(checked_entities(t), checked_relations(t)))
query(
    "canonical_mismatches",
    "H46",
    "SELECT doc_id AS response_id FROM documents WHERE doc_id % 9 = 0",
)(lambda t: X.canonical_mismatches(canonical(t).withColumn("canonical", F.when(F.col("response_id") % 9 == 0, F.concat("canonical", F.lit("x"))).otherwise(F.col("canonical"))), canonical(t)))
query(
    "declared_in_tuples",
    "H6",
    f"""WITH {D_X} SELECT response_id, trim(name, E' \\n') AS name, type FROM er WHERE reason IS NULL""",
)(
    lambda t: X.declared_in_tuples(canonical(t).select("response_id", F.lit("assistant").alias("role"), F.col("canonical").alias("content"))).select("response_id", F.trim(F.regexp_replace("name", r"^\n+|\n+$", "")).alias("name"), "type")
)


def replayed(t):
    """The second pass with the first pass's `Missing` declared."""
    extra = responses(t).select("response_id", F.lit(9).alias("pos"), F.lit("Missing").alias("name"), F.lit("Tool").alias("type"), F.lit("").alias("description"), F.lit("missing").alias("key"), F.lit(None).cast("string").alias("reason"))
    names = checked_entities(t).where("reason IS NULL").unionByName(extra.where("response_id % 2 = 0"), allowMissingColumns=True)
    return X.check_relations(relation_rows(t), names, responses(t))


query(
    "replay_candidates",
    "H30",
    f"""WITH {D_X} SELECT rr.response_id, pos, false AS pair_already_in_graph FROM rr JOIN (SELECT response_id FROM er JOIN w ON w.doc_id = response_id WHERE er.pos = 0 AND reason IS NULL) USING (response_id) WHERE pos = 1 AND response_id % 2 = 0 AND k1 <> k2""",
)(
    lambda t: X.replay_candidates(checked_relations(t), replayed(t), words(t).select(F.col("w2").alias("source"), F.col("w3").alias("target"))).select("response_id", "pos", "pair_already_in_graph")
)
query(
    "source_passages",
    "H45",
    "SELECT doc_id, md5(text) AS passage FROM documents",
)(
    lambda t: t.documents.select("doc_id", F.md5(X.source_passage(
        X.native_messages(F.array(F.struct(F.lit("transport").alias("role"), F.lit("CONTRACT retry").alias("content")),
                                  F.struct(F.lit("user").alias("role"), F.concat(F.lit("CONTRACT\nSOURCE_TEXT_BEGIN\n"), "text", F.lit("\nSOURCE_TEXT_END\n")).alias("content")))), ("CONTRACT",))).alias("passage"))
)

# ---- quoted relations ----------------------------------------------------------------
PROP = """SELECT source AS document_id, CAST(doc_id % 3 AS BIGINT) AS batch_id, doc_id AS rel_id, w1 AS subject, CASE WHEN doc_id % 10 = 9 THEN 'Dataset' ELSE 'Method' END AS subject_kind,
  CASE doc_id % 4 WHEN 0 THEN 'BUILT_ON' WHEN 1 THEN 'TRAINED_ON' WHEN 2 THEN 'USES_COMPONENT' ELSE 'USES_CONCEPT' END AS predicate, w2 AS object,
  CASE doc_id % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'Dataset' WHEN 2 THEN 'Method' ELSE 'Concept' END AS object_kind, 'e' AS explanation,
  concat('#/texts/', CAST(CASE WHEN doc_id % 8 = 5 THEN doc_id + 20 ELSE doc_id END AS STRING)) AS source_ref, concat(substring(text, 1, 60), CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' uses trained' END) AS quote"""


def prop(t):
    return t.spark.sql(PROP + " FROM {words}", words=words(t))


def proposals(t):
    return prop(t).drop("source_ref", "quote")


def quotes(t):
    return prop(t).select("document_id", "batch_id", "rel_id", F.lit(0).alias("pos"), "source_ref", "quote")


def doc_units(t):
    return t.documents.select(F.col("source").alias("document_id"), F.concat(F.lit("#/texts/"), "doc_id").alias("evidence_id"), "text")


def allowed(t):
    return t.documents.where("doc_id % 7 <> 3").select(F.col("source").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("batch_id"), F.concat(F.lit("#/texts/"), "doc_id").alias("ref"))


def judged(t):
    return R.check_proposals(proposals(t), quotes(t), doc_units(t), allowed(t))


WORDY = "regexp_matches(concat(' ', {0}, ' '), concat('[^\\p{{L}}\\p{{N}}_-]', regexp_escape({1}), '[^\\p{{L}}\\p{{N}}_-]'))"
D_P = f"""w AS ({D_WORDS}), p AS ({PROP.replace('STRING', 'VARCHAR')} FROM w),
pk AS (SELECT p.*, {NORM.format('subject')} AS s, {NORM.format('object')} AS o, {NORM.format('quote')} AS q, d.doc_id AS aid, {NORM.format('d.text')} AS body FROM p LEFT JOIN documents d ON d.source = p.document_id AND concat('#/texts/', d.doc_id) = p.source_ref),
pr AS (SELECT document_id, batch_id, rel_id, predicate, list_sort(list_filter([
  CASE WHEN subject_kind <> 'Method' THEN 'invalid_endpoint_types' END, CASE WHEN s = o THEN 'self_relation' END, CASE WHEN aid IS NULL OR aid % 7 = 3 THEN 'evidence_outside_supplied_scope' END,
  CASE WHEN aid IS NOT NULL AND aid % 7 <> 3 AND NOT CASE WHEN length(q) < 12 THEN length(q) >= 2 AND q = body ELSE contains(body, q) END THEN 'quote_not_found_at_reference' END,
  CASE WHEN NOT ({WORDY.format('q', 's')} AND {WORDY.format('q', 'o')}) THEN 'endpoint_names_missing_from_quotations' END,
  CASE WHEN NOT CASE predicate WHEN 'BUILT_ON' THEN regexp_matches(q, 'build|backbone|initializ|fine[\\s-]*tun|finetun|instruction[\\s-]*tun') WHEN 'TRAINED_ON' THEN regexp_matches(q, 'train|fine[\\s-]*tun|finetun')
    WHEN 'USES_COMPONENT' THEN regexp_matches(q, 'us[ei]|employ|integrat|incorporat|obtain|extract') ELSE regexp_matches(q, 'us[ei]|employ|attention|condition|incorporat|integrat') END THEN 'relationship_cue_missing' END,
  CASE WHEN predicate = 'TRAINED_ON' AND regexp_matches(q, 'not\\s+(?:been\\s+)?trained|never\\s+trained') THEN 'negated_training_requires_review' END,
  CASE WHEN predicate = 'TRAINED_ON' AND regexp_matches(q, 'retriev|database') THEN 'training_vs_retrieval_ambiguous' END], lambda x: x IS NOT NULL)) AS reasons FROM pk)"""
query("check_proposals", "H9", f"WITH {D_P} SELECT document_id, rel_id, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS accepted FROM pr")(
    lambda t: judged(t).select("document_id", "rel_id", F.array_join("reasons", ";").alias("reasons"), "accepted"))


def reviews(t):
    outcome = F.when(F.col("doc_id") % 5 == 0, "uncertain").when(F.col("doc_id") % 2 == 0, "relations_found").otherwise("no_supported_relation")
    return t.documents.where("doc_id % 11 <> 4").select(F.col("source").alias("document_id"), (F.col("doc_id") % 3).alias("batch_id"), F.concat(F.lit("#/texts/"), "doc_id").alias("source_ref"), outcome.alias("outcome"))


def batch_scope(t):
    return t.documents.select(F.col("source").alias("document_id"), (F.col("doc_id") % 3).alias("batch_id"), F.concat(F.lit("#/texts/"), "doc_id").alias("ref"))


query(
    "batch_issues",
    "H10",
    f"""WITH {D_P}, rv AS (SELECT source AS document_id, doc_id % 3 AS batch_id, concat('#/texts/', doc_id) AS source_ref, CASE WHEN doc_id % 5 = 0 THEN 'uncertain' WHEN doc_id % 2 = 0 THEN 'relations_found' ELSE 'no_supported_relation' END AS outcome, doc_id FROM documents WHERE doc_id % 11 <> 4),
tc AS (SELECT DISTINCT document_id, batch_id, source_ref FROM p)
SELECT DISTINCT source AS document_id, doc_id % 3 AS batch_id, 'source_review_coverage_mismatch' AS issue FROM documents WHERE doc_id % 11 = 4
UNION ALL SELECT document_id, batch_id, concat('uncertain_source:', source_ref) FROM rv WHERE outcome = 'uncertain'
UNION ALL SELECT rv.document_id, rv.batch_id, concat('source_review_relationship_mismatch:', rv.source_ref) FROM rv LEFT JOIN tc USING (document_id, batch_id, source_ref) WHERE (outcome = 'relations_found') <> (tc.source_ref IS NOT NULL)""",
)(lambda t: R.batch_issues(reviews(t), batch_scope(t), quotes(t)))
query(
    "typed_relation_groups",
    "H11",
    f"WITH {D_P} SELECT document_id, rel_id, predicate, object_kind FROM p",
)(
    lambda t: (lambda p: R.typed_groups(*[p.where(F.col("predicate") == x) for x in ("BUILT_ON", "TRAINED_ON", "USES_COMPONENT", "USES_CONCEPT")]).select("document_id", "rel_id", "predicate", "object_kind"))(proposals(t))
)


def catalog(t):
    return words(t).where("doc_id % 4 = 0").select(F.col("source").alias("document_id"), F.lit("Method").alias("kind"), F.col("w1").alias("name"), F.lit(None).cast("string").alias("source_ref"), F.lit(None).cast("string").alias("quote"))


query(
    "upsert_catalog",
    "H12",
    f"""WITH {D_P}, c AS (SELECT source AS document_id, 'Method' AS kind, {NORM.format('w1')} AS identity, 0 AS nw FROM w WHERE doc_id % 4 = 0 UNION ALL SELECT document_id, subject_kind, {NORM.format('subject')}, 1 FROM p
  UNION ALL SELECT document_id, object_kind, {NORM.format('object')}, 1 FROM p) SELECT document_id, kind, identity, min(nw) = 1 AS added FROM c GROUP BY ALL""",
)(lambda t: R.upsert_catalog(catalog(t), proposals(t), quotes(t))[0].select("document_id", "kind", "identity", "added"))
query(
    "relation_fields",
    "H12",
    f"WITH {D_P} SELECT DISTINCT document_id, predicate, {NORM.format('subject')} AS subject_key, {NORM.format('object')} AS object_key FROM p",
)(lambda t: R.relation_fields(proposals(t)))


def graph_nodes(t):
    w = words(t)
    subj = w.select(F.col("source").alias("document_id"), F.concat(F.lit("s"), "doc_id").alias("id"), F.lit("Method").alias("label"), F.upper("w1").alias("name"))
    obj = prop(t).select("document_id", F.concat(F.lit("o"), "rel_id").alias("id"), F.col("object_kind").alias("label"), F.col("object").alias("name"))
    return subj.unionByName(obj)


def graph_edges(t):
    return prop(t).select("document_id", F.col("rel_id").alias("edge_id"), F.concat(F.lit("s"), "rel_id").alias("source"), F.concat(F.lit("o"), "rel_id").alias("target"), F.col("predicate").alias("label"),
                          F.when(F.col("rel_id") % 3 == 0, "source_linked").otherwise("needs_review").alias("support_status"))


query(
    "attach_edge_evidence",
    "H13",
    f"""WITH {D_P} SELECT DISTINCT a.document_id, a.rel_id AS edge_id, b.source_ref, b.quote FROM pk a JOIN pk b ON a.document_id = b.document_id AND a.predicate = b.predicate AND b.subject_kind = 'Method' AND a.object_kind = b.object_kind AND a.s = b.s AND a.o = b.o""",
)(lambda t: R.attach_edge_evidence(graph_edges(t).drop("support_status"), graph_nodes(t), proposals(t), quotes(t)))
query(
    "relation_gate",
    "H14",
    f"WITH {D_P} SELECT document_id, count(*) FILTER (WHERE rel_id % 3 = 0) AS source_linked_domain_relationships, count(*) FILTER (WHERE rel_id % 3 = 0) > 0 AS passed FROM p GROUP BY document_id",
)(lambda t: R.relation_gate(graph_edges(t), graph_nodes(t)))


def candidates(t):
    return judged(t).select(F.concat_ws("-", "document_id", "batch_id").alias("batch_id"), F.col("rel_id").alias("candidate_id"), "accepted", "reasons")


def decisions(t):
    verdict = F.when(F.col("candidate_id") % 3 == 0, "supported").when(F.col("candidate_id") % 3 == 1, "unsupported").otherwise("uncertain")
    return candidates(t).where("NOT (batch_id LIKE 'src1%' AND candidate_id % 2 = 1)").select("batch_id", "candidate_id", verdict.alias("verdict"))


query(
    "review_faults",
    "H15",
    "SELECT concat(source, '-', doc_id % 3) AS batch_id, doc_id AS candidate_id, 'omitted' AS fault FROM documents WHERE source LIKE 'src1%' AND doc_id % 2 = 1",
)(lambda t: R.review_faults(candidates(t), decisions(t)))
query(
    "apply_review",
    "H15",
    f"""WITH {D_P}, c AS (SELECT concat(document_id, '-', batch_id) AS batch_id, rel_id, document_id, reasons FROM pr)
SELECT batch_id, rel_id AS candidate_id, len(reasons) = 0 AND rel_id % 3 = 0 AS accepted, array_to_string(list_sort(list_concat(reasons, CASE rel_id % 3 WHEN 1 THEN ['semantic_review_unsupported'] WHEN 2 THEN ['semantic_review_uncertain'] ELSE [] END)), ';') AS reasons
FROM c WHERE batch_id NOT IN (SELECT concat(source, '-', doc_id % 3) FROM documents WHERE source LIKE 'src1%' AND doc_id % 2 = 1)""",
)(lambda t: R.apply_review(candidates(t), decisions(t)).select("batch_id", "candidate_id", "accepted", F.array_join("reasons", ";").alias("reasons")))

# ---- research records ----------------------------------------------------------------
query(
    "metric_names",
    "H44",
    "SELECT p_partkey, concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' at 1' ELSE '' END) AS name FROM part",
)(lambda t: t.part.select("p_partkey", metric_name(F.concat(F.when(F.col("p_partkey") % 3 == 0, "Generation Quality - ").when(F.col("p_partkey") % 3 == 1, "physical stability: ").otherwise(""), "p_name",
                                                           F.when(F.col("p_partkey") % 2 == 0, " at 1 ↓†").otherwise(" ↑"))).alias("name")))
query(
    "canonical_metrics",
    "H16",
    "SELECT p_brand AS paper_id, p_partkey AS pos, first_value(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END) OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS canonical FROM part",
)(lambda t: S.canonical_metrics(t.part.select(F.col("p_brand").alias("paper_id"), F.col("p_partkey").alias("pos"), F.concat(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit(" ↑")).alias("name"))).select("paper_id", "pos", "canonical"))
query(
    "drop_backbone_components",
    "H16",
    """WITH r AS (SELECT p_brand AS paper_id, p_type AS method, CASE WHEN p_size % 2 = 0 THEN 'built_on' ELSE 'components' END AS role, p_name AS name, p_partkey FROM part)
SELECT paper_id, method, role, p_partkey FROM r WHERE role = 'built_on' OR NOT EXISTS (SELECT 1 FROM r b WHERE b.role = 'built_on' AND b.paper_id = r.paper_id AND b.method = r.method AND b.name = r.name)""",
)(lambda t: S.drop_backbone_components(t.part.select(F.col("p_brand").alias("paper_id"), F.col("p_type").alias("method"), F.when(F.col("p_size") % 2 == 0, "built_on").otherwise("components").alias("role"), F.concat(F.upper("p_name"), F.lit("†")).alias("name"), "p_partkey")).select("paper_id", "method", "role", "p_partkey"))
query(
    "recover_catalog",
    "H16",
    """WITH m AS (SELECT p_brand AS paper_id, p_name AS identity, p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'unknown' ELSE p_type END AS role FROM part)
SELECT paper_id, identity, coalesce(arg_min(role, pos) FILTER (WHERE role NOT IN ('', 'unknown')), arg_min(role, pos)) AS role, count(*) AS mentions FROM m GROUP BY ALL""",
)(
    lambda t: S.recover_catalog(t.part.select(F.col("p_brand").alias("paper_id"), F.lit("Method").alias("kind"), F.col("p_partkey").alias("pos"), F.upper("p_name").alias("name"), F.lit(None).cast("string").alias("experiment_name"),
                                              F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "unknown").otherwise(F.col("p_type")).alias("role")), ["role"]).select("paper_id", "identity", "role", "mentions")
)
query(
    "merge_sections",
    "H21",
    """WITH d AS (SELECT p_brand AS paper_id, p_name AS identity, p_type AS description, min(p_partkey) AS fst FROM part GROUP BY ALL)
SELECT paper_id, identity, substr(string_agg(description, ' ' ORDER BY fst), 1, 4096) AS description, (SELECT string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) FROM part p WHERE p.p_brand = paper_id AND p.p_name = identity) AS sizes FROM d GROUP BY ALL""",
)(
    lambda t: S.merge_sections(t.part.select(F.col("p_brand").alias("paper_id"), F.lit("Method").alias("kind"), F.col("p_name").alias("identity"), F.col("p_partkey").alias("section_no"), F.col("p_type").alias("description"), F.array(F.col("p_size").cast("string")).alias("sizes")), ["sizes"])
    .select("paper_id", "identity", "description", F.array_join("sizes", ",").alias("sizes"))
)


def papers(t):
    """A record tree per brand: its parts as methods, sizes as concepts, types as datasets."""
    method = F.struct(F.col("p_name").alias("name"), F.array(F.struct(F.col("p_type").alias("name"))).alias("training_datasets"), F.array(F.struct(F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("name"))).alias("concepts"))
    rows = t.part.groupBy(F.col("p_brand").alias("document_id")).agg(F.collect_list(method).alias("methods"))
    return rows.select("document_id", F.struct(F.col("document_id").alias("title"), "methods", F.transform("methods", lambda m: F.struct(m["training_datasets"][0]["name"].alias("name"))).alias("datasets")).alias("paper"))


query(
    "nested_graph_nodes",
    "H23",
    """SELECT DISTINCT p_brand AS document_id, 'ResearchPaper' AS label, p_brand AS name FROM part UNION ALL SELECT DISTINCT p_brand, 'Method', p_name FROM part UNION ALL SELECT DISTINCT p_brand, 'Dataset', p_type FROM part
UNION ALL SELECT DISTINCT p_brand, 'Concept', concat('size ', p_size) FROM part""",
)(lambda t: S.nested_graph(papers(t))[0].select("document_id", "label", "name"))
query(
    "nested_graph_edges",
    "H23",
    """WITH e AS (SELECT DISTINCT p_brand AS document_id, 'DISCUSSES_METHOD' AS label, p_brand AS s, p_name AS t FROM part UNION ALL SELECT DISTINCT p_brand, 'DESCRIBES_DATASET', p_brand, p_type FROM part
 UNION ALL SELECT DISTINCT p_brand, 'TRAINED_ON', p_name, p_type FROM part UNION ALL SELECT DISTINCT p_brand, 'USES_CONCEPT', p_name, concat('size ', p_size) FROM part)
SELECT document_id, label, count(*) AS edges FROM e GROUP BY ALL""",
)(lambda t: S.nested_graph(papers(t))[1].groupBy("document_id", "label").agg(F.count("*").alias("edges")))


def plain_cells(t):
    """The grid, without its code column except in one table."""
    return cells(t).where("NOT (idx >= 8 AND idx % 8 = 4) OR item_ref = '#/tables/ECONOMY'")


def plain_units(t):
    items = U.item_units(grid_items(t))
    return stage(items.unionByName(U.cell_units(plain_cells(t), items), allowMissingColumns=True))


def plain_labels(t):
    return stage(U.table_labels(U.item_units(grid_items(t)), U.own_context(t.sql(fx.ITEM_CONTEXT))))


def claims(t):
    """Experiments claim the tables of all types but one; one type is claimed twice."""
    return plain_labels(t).where("evidence_id NOT LIKE '%SMALL'").select(
        "document_id", "table_label", F.explode(F.when(F.col("evidence_id").like("%MEDIUM"), F.array(F.lit("exp a"), F.lit("exp b"))).otherwise(F.array(F.concat(F.lit("exp "), "evidence_id")))).alias("experiment"))


def measured(t):
    part = t.sql(fx.GRID_BASE)
    configs = part.where("p_partkey % 3 = 0").select("document_id", F.concat(F.lit("exp "), "item_ref").alias("experiment"), F.col("p_name").alias("name"))
    methods = part.where("p_partkey % 3 = 1").select("document_id", F.upper("p_name").alias("name"), F.lit(False).alias("proposed"))
    metrics = part.select("document_id", F.lit("size").alias("name")).distinct()
    return S.table_measurements(plain_units(t), U.cell_context(plain_cells(t)), plain_labels(t), claims(t), metrics, methods, configs)


D_M = f"""g AS ({duck(fx.GRID_BASE)}), lb AS (SELECT document_id, replace(item_ref, 'texts', 'tables') AS item_ref, concat('Table ', regexp_extract(text, 'Table ([0-9]+)', 1)) AS table_label FROM ({D_ITEMS}) WHERE kind = 'text'),
tb AS (SELECT *, CASE WHEN item_ref LIKE '%SMALL' OR item_ref LIKE '%MEDIUM' THEN 'table_experiment_assignment_not_unique'
   WHEN item_ref LIKE '%ECONOMY' AND EXISTS (SELECT 1 FROM g WHERE g.document_id = lb.document_id AND g.item_ref = lb.item_ref AND (p_partkey % 5 = 0 OR p_partkey % 7 = 0)) THEN 'ambiguous_table_cells' END AS reason FROM lb),
cf AS (SELECT document_id, item_ref, p_name, count(*) AS n FROM g WHERE p_partkey % 3 = 0 GROUP BY ALL), mt AS (SELECT DISTINCT document_id, p_name FROM g WHERE p_partkey % 3 = 1),
rw AS (SELECT g.*, tb.table_label, coalesce(cf.n, 0) = 1 OR (cf.n IS NULL AND mt.p_name IS NOT NULL) AS ok FROM g JOIN tb ON tb.document_id = g.document_id AND tb.item_ref = g.item_ref AND tb.reason IS NULL
  LEFT JOIN cf ON cf.document_id = g.document_id AND cf.item_ref = g.item_ref AND cf.p_name = g.p_name LEFT JOIN mt ON mt.document_id = g.document_id AND mt.p_name = g.p_name)"""
query(
    "table_measurements",
    "H17",
    f"""WITH {D_M} SELECT document_id, table_label, p_name AS row_label, 'Size' AS column_label, 'lower' AS direction, count(*) > 0 AS present FROM rw WHERE ok GROUP BY ALL UNION ALL
SELECT document_id, table_label, p_name, 'Price', 'higher', count(*) > 0 FROM rw WHERE ok GROUP BY ALL""",
)(lambda t: measured(t)[0].select("document_id", "table_label", "row_label", "column_label", "direction", F.lit(True).alias("present")))
query(
    "unresolved_measurements",
    "H17",
    f"""WITH {D_M} SELECT document_id, item_ref AS ref, reason FROM tb WHERE reason IS NOT NULL UNION ALL SELECT document_id, concat(item_ref, '::cell:', p_partkey * 8 + k), 'configuration_not_unique' FROM rw, (VALUES (10), (11)) v(k) WHERE NOT ok""",
)(lambda t: measured(t)[1])

# Graph nodes named by the first words of each document.
NODE_LABEL = "CASE CAST(floor(doc_id / 20) AS BIGINT) % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'Dataset' WHEN 2 THEN 'Concept' ELSE 'Metric' END"


def study_nodes(t):
    none = lambda k: F.lit(None).cast(k)
    return words(t).select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("id"), F.expr(NODE_LABEL).alias("label"), F.concat_ws(" ", "w1", "w2").alias("name"), none("string").alias("statement"),
                           none("string").alias("cell_ref"), none("string").alias("reported_value"), none("string").alias("row_label"), none("string").alias("column_label"), none("string").alias("table_label"), none("string").alias("experiment_name"),
                           F.when(F.col("doc_id") % 8 == 0, "proposed").otherwise("unknown").alias("role"))


def study_anchors(t):
    evidence = t.documents.where("doc_id % 3 <> 2").select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 50)).otherwise("nothing like this was written").alias("quote"),
                                                          F.concat(F.lit("#/texts/"), "doc_id").alias("source_ref"))
    empty = cells(t).select("document_id", U.cell_id("item_ref", "idx").alias("evidence_id"), F.lit("column_headers").alias("role"), F.lit("x").alias("ref"), F.lit(0).cast("long").alias("pos"))
    units = doc_units(t).withColumn("kind", F.lit("text")).withColumn("item_ref", F.col("evidence_id"))
    for c, k in (("row_end", "int"), ("col_start", "int"), ("col_end", "int"), ("issues", "array<string>")):
        units = units.withColumn(c, F.lit(None).cast(k))
    labels = doc_units(t).select("document_id", "evidence_id", F.lit("Table 1").alias("table_label"))
    groups, refs = S.node_anchors(study_nodes(t), evidence, units, empty, labels)
    return stage(groups), stage(refs)


def assessed(t):
    return stage(S.assess_nodes(study_nodes(t), study_anchors(t)))


D_NODES = f"""w AS ({D_WORDS}), nd AS (SELECT source AS document_id, doc_id, {NODE_LABEL} AS label, concat(w1, ' ', w2) AS name, {NORM.format("concat(w1, ' ', w2)")} AS k, {NORM.format('text')} AS body, {NORM.format('substr(text, 1, 50)')} AS q FROM w),
nm AS (SELECT DISTINCT a.document_id, a.doc_id, b.doc_id AS ref FROM nd a JOIN nd b ON a.document_id = b.document_id AND contains(b.body, a.k) AND regexp_matches(concat(' ', b.body, ' '), concat('[^\\p{{L}}\\p{{N}}_]', regexp_escape(a.k), '[^\\p{{L}}\\p{{N}}_]'))),
an AS (SELECT nd.document_id, nd.doc_id, CASE WHEN doc_id % 3 = 0 AND CASE WHEN length(q) < 12 THEN length(q) >= 2 AND q = body ELSE true END THEN 'quote_match' WHEN EXISTS (SELECT 1 FROM nm WHERE nm.document_id = nd.document_id AND nm.doc_id = nd.doc_id) THEN 'name_match_only' ELSE 'unresolved' END AS linkage FROM nd),
ns AS (SELECT nd.document_id, nd.doc_id, label, linkage, CASE WHEN (label = 'Concept' AND k IN (SELECT x.k FROM nd x WHERE x.label = 'Metric' AND x.document_id = nd.document_id)) OR (label = 'Method' AND k IN (SELECT x.k FROM nd x WHERE x.label = 'Dataset' AND x.document_id = nd.document_id)) THEN 'rejected'
  WHEN linkage <> 'unresolved' THEN 'source_linked' ELSE 'needs_review' END AS support_status FROM nd JOIN an USING (document_id, doc_id))"""
query("assess_nodes", "H18", f"WITH {D_NODES} SELECT document_id, doc_id::VARCHAR AS id, support_status, linkage FROM ns")(lambda t: assessed(t).select("document_id", "id", "support_status", "linkage"))
query("node_status_histogram", "H20", f"WITH {D_NODES} SELECT document_id, support_status, count(*) AS n FROM ns GROUP BY ALL")(lambda t: S.status_histogram(assessed(t)))


EDGE_LABEL = "CASE CAST(floor(doc_id / 20) AS BIGINT) % 4 WHEN 0 THEN CASE step WHEN 1 THEN 'TRAINED_ON' ELSE 'USES_CONCEPT' END WHEN 2 THEN 'USES_CONCEPT' ELSE 'RELATED_TO' END"


def study_edges(t):
    """Edges from every document to the next one of its source and the one after."""
    own = t.documents.select(F.col("source").alias("document_id"), "doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    following = t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("other"))
    joined = own.withColumn("other", F.col("doc_id") + 20 * F.col("step")).join(following, ["document_id", "other"])
    return joined.select(
        "document_id", (F.col("doc_id") * 2 + F.col("step")).alias("edge_id"), F.col("doc_id").cast("string").alias("source"), F.col("other").cast("string").alias("target"), F.expr(EDGE_LABEL).alias("label"))


CUED = " is trained with attention to "


def cued_units(t):
    """Passages of which three in five end with a cue and the name of the next document or the one after."""
    w = words(t).select(F.col("source").alias("document_id"), (F.col("doc_id") - 20 * (1 + F.pmod(F.floor(F.col("doc_id") / 20), F.lit(2)))).alias("doc_id"), F.concat_ws(" ", "w1", "w2").alias("next"))
    d = t.documents.select(F.col("source").alias("document_id"), "doc_id", "text").join(w.groupBy("document_id", "doc_id").agg(F.min("next").alias("next")), ["document_id", "doc_id"], "left")
    return d.select("document_id", F.concat(F.lit("#/texts/"), "doc_id").alias("evidence_id"), F.when((F.col("doc_id") % 5 < 3) & F.col("next").isNotNull(), F.concat("text", F.lit(CUED), "next")).otherwise(F.col("text")).alias("text"))


D_EDGES = f"""{D_NODES}, nx AS (SELECT document_id, doc_id - 20 * (1 + CAST(floor(doc_id / 20) AS BIGINT) % 2) AS doc_id, min(name) AS next FROM nd GROUP BY ALL),
cu AS (SELECT w.source AS document_id, w.doc_id, {NORM.format(f"CASE WHEN w.doc_id % 5 < 3 AND next IS NOT NULL THEN concat(w.text, '{CUED}', next) ELSE w.text END")} AS body FROM w LEFT JOIN nx ON nx.document_id = w.source AND nx.doc_id = w.doc_id),
rf AS (SELECT document_id, doc_id, doc_id AS ref FROM an WHERE linkage = 'quote_match' UNION SELECT nm.document_id, nm.doc_id, nm.ref FROM nm JOIN an ON an.document_id = nm.document_id AND an.doc_id = nm.doc_id WHERE linkage = 'name_match_only'),
eg AS (SELECT nd.document_id, nd.doc_id * 2 + step AS edge_id, nd.doc_id AS s, nd.doc_id + 20 * step AS t, {EDGE_LABEL.replace('doc_id', 'nd.doc_id')} AS label FROM nd, (VALUES (1), (2)) v(step)),
ge AS (SELECT eg.document_id, edge_id, s, t, eg.label, CASE WHEN a.support_status = 'rejected' OR b.support_status = 'rejected' OR (eg.label = 'TRAINED_ON' AND (a.label <> 'Method' OR b.label <> 'Dataset')) OR (eg.label = 'USES_CONCEPT' AND (a.label <> 'Method' OR b.label <> 'Concept')) THEN 'invalid_entity_type_or_relationship_pattern'
  WHEN a.label = 'Method' THEN CASE WHEN EXISTS (SELECT 1 FROM rf JOIN cu ON cu.document_id = rf.document_id AND cu.doc_id = rf.ref JOIN nd n ON n.document_id = rf.document_id WHERE rf.document_id = eg.document_id AND rf.doc_id = eg.s AND n.doc_id = eg.t AND n.k <> '' AND contains(cu.body, n.k)
      AND regexp_matches(cu.body, CASE eg.label WHEN 'TRAINED_ON' THEN 'train' WHEN 'USES_CONCEPT' THEN 'condition|attention|generat|context|represent|inject' END)) THEN 'target_and_relationship_cue_in_source_passage' ELSE 'source_support_not_resolved' END
  WHEN EXISTS (SELECT 1 FROM rf x JOIN rf y ON y.document_id = x.document_id AND y.ref = x.ref WHERE x.document_id = eg.document_id AND x.doc_id = eg.s AND y.doc_id = eg.t) THEN 'shared_source_passage' ELSE 'source_support_not_resolved' END AS support_reason
  FROM eg JOIN ns a ON a.document_id = eg.document_id AND a.doc_id = eg.s JOIN ns b ON b.document_id = eg.document_id AND b.doc_id = eg.t),
gs AS (SELECT *, CASE support_reason WHEN 'invalid_entity_type_or_relationship_pattern' THEN 'rejected' WHEN 'source_support_not_resolved' THEN 'needs_review' ELSE 'source_linked' END AS support_status FROM ge)"""


def assessed_edges(t):
    return S.assess_edges(study_edges(t), assessed(t), study_anchors(t), cued_units(t))


query("assess_edges", "H19", f"WITH {D_EDGES} SELECT document_id, edge_id, s::VARCHAR AS source, t::VARCHAR AS target, label, support_status, support_reason FROM gs")(assessed_edges)
query(
    "usable_graph", "H20",
    f"WITH {D_EDGES} SELECT document_id, doc_id::VARCHAR AS id, support_status FROM ns WHERE support_status <> 'rejected' AND EXISTS (SELECT 1 FROM gs WHERE gs.document_id = ns.document_id AND gs.support_status = 'source_linked' AND doc_id IN (s, t))",
)(lambda t: S.usable_graph(assessed(t), assessed_edges(t))[0].select("document_id", "id", "support_status"))
query(
    "combine_faults",
    "H22",
    """SELECT c_nationkey AS group_id, unnest(list_filter([CASE WHEN count(DISTINCT c_custkey % 2) <> 1 THEN 'different_sources' END, CASE WHEN count(DISTINCT c_mktsegment) <> 1 THEN 'different_schemas' END, CASE WHEN bool_or(c_acctbal < -900) THEN 'run_not_finished' END], lambda x: x IS NOT NULL)) AS fault
FROM customer GROUP BY c_nationkey""",
)(lambda t: S.combine_faults(t.customer.select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("run_id"), (F.col("c_custkey") % 2).alias("source_sha256"), F.col("c_mktsegment").alias("schema_sha256"), F.when(F.col("c_acctbal") < -900, "running").otherwise("done").alias("status"))))
query(
    "recovered_batches",
    "H22",
    """WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus, l_partkey % 10 AS ref FROM orders JOIN lineitem ON l_orderkey = o_orderkey), d AS (SELECT DISTINCT o_custkey, ref FROM b WHERE o_orderstatus = 'F'),
c AS (SELECT b.o_orderkey, bool_and(d.ref IS NOT NULL) AS ok FROM b LEFT JOIN d USING (o_custkey, ref) WHERE o_orderstatus <> 'F' GROUP BY o_orderkey)
SELECT DISTINCT b.o_orderkey AS batch_id, CASE WHEN c.ok THEN 'recovered_by_smaller_batches' WHEN o_orderstatus = 'F' THEN 'extracted' ELSE 'failed' END AS status FROM b LEFT JOIN c USING (o_orderkey)""",
)(
    lambda t: S.recovered_batches(t.orders.join(t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey") % 10).alias("refs")), "o_orderkey").select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "extracted").otherwise("failed").alias("status"), "refs")).select("batch_id", "status")
)
query(
    "section_coverage",
    "H35",
    """WITH r AS (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey FROM lineitem), n AS (SELECT DISTINCT l_suppkey, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10)
SELECT r.l_suppkey AS document_id, l_orderkey AS chunk_id, CASE WHEN bool_or(l_partkey % 10 = 0) THEN 'extracted_in_selected_scope' ELSE 'not_attempted' END AS extraction_status, count(DISTINCT p_brand) AS source_linked_nodes
FROM r LEFT JOIN n USING (l_suppkey, l_partkey) GROUP BY r.l_suppkey, l_orderkey""",
)(
    lambda t: S.section_coverage(
        t.lineitem.groupBy(F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("chunk_id")).agg(F.collect_list("l_partkey").alias("refs")),
        t.lineitem.where("l_partkey % 10 = 0").select(F.col("l_suppkey").alias("document_id"), F.col("l_partkey").alias("ref")),
        t.lineitem.join(t.part.where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("document_id"), F.col("p_brand").alias("id"), F.col("l_partkey").alias("ref")))
)
query(
    "run_outcomes",
    "H36",
    """SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'insufficient_extraction' WHEN c_custkey % 5 = 0 THEN 'partial_document_extraction' WHEN c_acctbal < 0 THEN 'insufficient_relationship_extraction' WHEN c_nationkey > 12 THEN 'complete_with_unresolved' ELSE 'complete' END AS status,
  c_custkey % 3 <> 0 AS substantive, c_custkey % 3 <> 0 AND c_acctbal >= 0 AS gate_passed FROM customer""",
)(
    lambda t: S.run_outcomes(t.customer.select(F.col("c_custkey").alias("run_id"), F.lit(1).alias("nodes_beyond_root"), (F.col("c_custkey") % 3).alias("edges"), (F.col("c_acctbal") >= 0).alias("relation_gate"),
                                               F.when(F.col("c_nationkey") > 12, 1).otherwise(0).alias("needs_review"), F.lit(0).alias("unresolved"), (F.col("c_custkey") % 5 == 0).alias("partial"), F.lit(True).alias("review_complete")))
)
query(
    "contract_outcomes",
    "H36",
    """WITH f AS (SELECT user_id, bool_or(event_type = 'view') AS dense, bool_or(event_type = 'view' AND value > 60) AS dok, bool_or(event_type = 'click' AND value > 60) AS ok FROM events GROUP BY user_id)
SELECT user_id AS run_id, CASE WHEN dense AND NOT dok AND ok THEN 'direct_fallback_after_dense_failure' WHEN dok THEN 'dense' WHEN ok THEN 'direct' ELSE 'unresolved_dense' END AS outcome FROM f""",
)(lambda t: S.contract_outcomes(t.events.select(F.col("user_id").alias("run_id"), F.lit("dense").alias("requested"), F.when(F.col("event_type") == "view", "chunk_batch").when(F.col("event_type") == "click", "chunk").otherwise("other").alias("source_type"), (F.col("value") > 60).alias("parsed"))))
query(
    "understanding",
    "H37",
    f"""WITH {D_P} SELECT document_id, subject AS name, coalesce(string_agg(DISTINCT object, '|' ORDER BY object) FILTER (WHERE predicate = 'BUILT_ON'), '') AS built_on, coalesce(string_agg(DISTINCT object, '|' ORDER BY object) FILTER (WHERE predicate = 'TRAINED_ON'), '') AS trained_on FROM p GROUP BY ALL""",
)(
    lambda t: S.understanding(
        graph_nodes(t).where("id LIKE 'o%'").unionByName(prop(t).select("document_id", F.concat(F.lit("s"), "rel_id").alias("id"), F.lit("Method").alias("label"), F.col("subject").alias("name"))).withColumn("label", F.when(F.col("id").startswith("o"), F.lit("Target")).otherwise(F.col("label"))),
        graph_edges(t)).select("document_id", "name", F.coalesce(F.array_join("built_on", "|"), F.lit("")).alias("built_on"), F.coalesce(F.array_join("trained_on", "|"), F.lit("")).alias("trained_on"))
)
