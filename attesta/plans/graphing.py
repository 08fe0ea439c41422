"""Graph tables over suppliers, parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.skew import shuffled_join
from attesta.functions.stage import stage
from attesta.operators import communities as C
from attesta.operators import graph_tables as G
from attesta.plans import duck, fixtures as fx, query
from attesta.plans.searching import D_QUERIES, hits

D_ENT = duck(fx.GRAPH_ENTITIES).replace("STRING", "VARCHAR")
D_OCC = duck(fx.GRAPH_OCCURRENCES).replace("STRING", "VARCHAR")


def entities(t):
    return t.sql(fx.GRAPH_ENTITIES).withColumn("description", F.lit(""))


def occurrences(t):
    return t.sql(fx.GRAPH_OCCURRENCES)


def relations(t):
    """Merged relations with endpoint titles, as native graph tables store them."""
    e = entities(t).select("id", "title")
    m = G.merge_relations(occurrences(t))
    titled = shuffled_join(m, e.select(F.col("id").alias("source"), F.col("title").alias("s")), ["source"])
    titled = shuffled_join(titled, e.select(F.col("id").alias("target"), F.col("title").alias("t")), ["target"])
    return stage(
        titled.select(F.concat_ws("-", "source", "target").alias("id"), F.col("s").alias("source"), F.col("t").alias("target"), F.lit("").alias("description"), "weight",
                F.col("source").alias("source_key"), F.col("target").alias("target_key"))
    )


D_REL = f"""ent AS ({D_ENT}), occ AS ({D_OCC}),
mrg AS (SELECT source, target, sum(weight)::BIGINT AS weight, count(DISTINCT unit_id) AS units FROM occ GROUP BY ALL),
rel AS (SELECT concat(m.source, '-', m.target) AS id, a.title AS source, b.title AS target, m.source AS sk, m.target AS tk, weight FROM mrg m JOIN ent a ON a.id = m.source JOIN ent b ON b.id = m.target)"""

query("merge_relations", "H24", f"WITH {D_REL} SELECT * FROM mrg")(lambda t: G.merge_relations(occurrences(t)))
query("relation_units", "H24", f"WITH {D_REL} SELECT DISTINCT source, target, unit_id FROM occ")(lambda t: G.merged_units(occurrences(t), ["source", "target"]))


def described(t):
    """A nation's suppliers as one entity, described by the priority and flag of the orders they were seen in."""
    return t.sql("""SELECT concat('NATION', CAST(s_nationkey AS STRING)) AS title, concat(o_orderpriority, ' ', l_returnflag) AS description, concat('u', CAST(o_orderkey AS STRING)) AS unit_id
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {supplier} ON s_suppkey = l_suppkey""")


query(
    "entity_descriptions",
    "H24",
    """SELECT concat('NATION', s_nationkey) AS title, concat(o_orderpriority, ' ', l_returnflag) AS description, min(concat('u', o_orderkey)) AS unit_id, count(*) AS times
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
)(lambda t: G.merged_descriptions(described(t), ["title"]))
query(
    "merge_entities",
    "H24",
    "SELECT c_mktsegment AS title, arg_min(type, (-n, type)) AS type, sum(n)::BIGINT AS occurrences FROM (SELECT c_mktsegment, c_nationkey::VARCHAR AS type, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_mktsegment",
)(lambda t: G.merge_entities(t.customer.select(F.col("c_mktsegment").alias("title"), F.col("c_nationkey").cast("string").alias("type"))))
query(
    "drop_orphans",
    "H24",
    f"WITH {D_REL} SELECT source, target, weight FROM mrg WHERE target IN (SELECT id FROM ent WHERE type = 'ECONOMY') AND source IN (SELECT id FROM ent WHERE type LIKE 'NATION%')",
)(lambda t: G.drop_orphans(G.merge_relations(occurrences(t)).drop("units"), entities(t).where("type = 'ECONOMY' OR type LIKE 'NATION%'"), "id"))
query(
    "replay_differences",
    "H24 H46",
    f"""WITH {D_REL} SELECT source, target, weight AS expected_weight, CASE WHEN weight > 1 THEN weight + 1 END AS actual_weight FROM mrg WHERE weight <> 2""",
)(
    lambda t: (lambda m: G.replay_differences(m, m.where("weight <> 1").withColumn("weight", F.when(F.col("weight") == 2, 2).otherwise(F.col("weight") + 1))))(
        G.merge_relations(occurrences(t)))
)


def units(t):
    return t.orders.select(
        F.concat(F.lit("u"), "o_orderkey").alias("id"),
        F.concat(F.lit("source_record_id: r"), "o_orderkey", F.lit("\nbody\nsource_record_id: x"), "o_custkey").alias("text"),
        F.array(F.concat(F.lit("d"), "o_custkey")).alias("document_ids"))


def sources(t):
    docs = t.customer.select(F.concat(F.lit("d"), "c_custkey").alias("id"), F.concat(F.lit("c"), "c_custkey").alias("source_id"))
    known = t.orders.select(F.concat(F.lit("r"), "o_orderkey").alias("source_id")).unionByName(docs.select("source_id"))
    return G.unit_sources(units(t), docs, known)


D_SRC = """src AS (SELECT concat('u', o_orderkey) AS unit_id, concat('r', o_orderkey) AS source_id FROM orders
  UNION SELECT concat('u', o_orderkey), concat('c', o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey)"""
query("unit_sources", "H25", f"WITH {D_SRC} SELECT * FROM src")(sources)


def ledger(t):
    occ = occurrences(t)
    eu = occ.select(F.col("target").alias("id"), "unit_id").unionByName(occ.select(F.col("source").alias("id"), "unit_id"))
    ru = occ.select(F.concat_ws("-", "source", "target").alias("id"), "unit_id")
    communities = t.orders.select(F.concat(F.lit("k"), "o_orderpriority").alias("id"), F.col("o_orderpriority").alias("community"), F.concat(F.lit("u"), "o_orderkey").alias("unit_id"))
    reports = communities.select("community").distinct().select(F.concat(F.lit("rep"), "community").alias("id"), "community")
    return G.source_ledger(stage(sources(t)), eu, ru, communities, reports)


D_LED = f"""{D_SRC}, occ AS ({D_OCC}),
led AS (SELECT 'text_units' AS "table", unit_id AS id, source_id FROM src
 UNION ALL SELECT DISTINCT 'entities', e.id, src.source_id FROM (SELECT target AS id, unit_id FROM occ UNION SELECT source, unit_id FROM occ) e JOIN src USING (unit_id)
 UNION ALL SELECT DISTINCT 'relationships', concat(source, '-', target), source_id FROM occ JOIN src USING (unit_id)
 UNION ALL SELECT DISTINCT 'communities', concat('k', o_orderpriority), source_id FROM orders JOIN src ON unit_id = concat('u', o_orderkey)
 UNION ALL SELECT DISTINCT 'community_reports', concat('rep', o_orderpriority), source_id FROM orders JOIN src ON unit_id = concat('u', o_orderkey))"""
query("source_ledger", "H25 A9", f"""WITH {D_LED} SELECT "table", id, source_id FROM led""")(ledger)


def context(t):
    p = t.part
    row = lambda cat, table, cid: p.select(F.col("p_brand").alias("answer_id"), F.lit(cat).alias("category"), F.lit(table).alias("table"), F.concat(F.lit(cid), F.col("p_partkey").cast("string")).alias("citation_id"))
    return row("entities", "entities", "").unionByName(row("sources", "text_units", ""))


def natives(t):
    e = t.part.select(F.lit("entities").alias("table"), F.col("p_partkey").cast("string").alias("citation_id"), F.concat(F.lit("p"), "p_partkey").alias("id"))
    u = t.orders.where("o_orderkey % 2 = 0").select(F.lit("text_units").alias("table"), F.col("o_orderkey").cast("string").alias("citation_id"), F.concat(F.lit("u"), "o_orderkey").alias("id"))
    return e.unionByName(u)


def refs(t):
    return t.orders.select(F.concat(F.lit("r"), "o_orderkey").alias("source_id"), F.concat(F.lit("#/texts/"), "o_orderkey").alias("ref"), (1 + F.col("o_orderkey") % 30).cast("int").alias("page_no"))


query(
    "resolve_context",
    "G9",
    f"""WITH {D_LED}, ctx AS (SELECT p_brand AS answer_id, 'entities' AS category, 'entities' AS tb, p_partkey::VARCHAR AS citation_id, concat('p', p_partkey) AS id FROM part
  UNION ALL SELECT p_brand, 'sources', 'text_units', p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 AND p_partkey IN (SELECT o_orderkey FROM orders) THEN concat('u', p_partkey) END FROM part),
pl AS (SELECT led."table" AS tb, led.id, count(DISTINCT page) AS pages, count(DISTINCT source_id) AS n FROM led LEFT JOIN (SELECT concat('r', o_orderkey) AS source_id, 1 + o_orderkey % 30 AS page FROM orders) USING (source_id) GROUP BY ALL)
SELECT answer_id, category, citation_id, ctx.id AS native_id, coalesce(n, 0) > 0 AS resolved, coalesce(pages, 0)::INT AS pages FROM ctx LEFT JOIN pl ON pl.tb = ctx.tb AND pl.id = ctx.id""",
)(lambda t: G.resolve_context(context(t), natives(t), ledger(t), refs(t)).select("answer_id", "category", "citation_id", "native_id", "resolved", F.coalesce(F.size("pages"), F.lit(0)).alias("pages")))

query("degrees", "H27", f"WITH {D_REL} SELECT title, count(*) AS degree FROM (SELECT source AS title FROM rel UNION ALL SELECT target FROM rel) GROUP BY title")(
    lambda t: G.degrees(relations(t)))


def odd_entities(t):
    k = F.col("c_custkey")
    title = F.when(k % 5 == 0, F.concat(F.lit("Smith et al., 20"), F.lpad((k % 100).cast("string"), 2, "0"))).when(k % 5 == 1, F.concat(F.lit("Table "), k.cast("string"))).when(
        k % 5 == 2, F.concat(F.lit("Appendix "), k.cast("string"))).otherwise(F.col("c_name"))
    return t.customer.select(k.cast("string").alias("id"), title.alias("title"), F.col("c_mktsegment").alias("type"))


def name_relations(t):
    e = odd_entities(t).select("id", "title")
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("rid"))
    return o.join(e, "id").select(F.col("rid").alias("id"), F.col("title").alias("source"), F.lit("Outcome").alias("target"), F.lit("").alias("description"))


D_ODD = """odd AS (SELECT c_custkey::VARCHAR AS id, CASE c_custkey % 5 WHEN 0 THEN concat('Smith et al., 20', lpad((c_custkey % 100)::VARCHAR, 2, '0')) WHEN 1 THEN concat('Table ', c_custkey) WHEN 2 THEN concat('Appendix ', c_custkey) ELSE c_name END AS title, c_mktsegment AS type FROM customer),
nr AS (SELECT o_orderkey AS id, title AS source FROM orders JOIN odd ON odd.id = o_custkey::VARCHAR WHERE o_orderstatus = 'F')"""
query(
    "name_audit",
    "H27 H30",
    f"""WITH {D_ODD} SELECT id, title, title NOT IN (SELECT source FROM nr) AS isolated, title LIKE 'Smith%' AS citation_like, title LIKE 'Table%' AS table_like, title LIKE 'Table%' OR title LIKE 'Appendix%' AS structure_like FROM odd""",
)(lambda t: G.name_audit(odd_entities(t), name_relations(t)))
query(
    "dangling_relations",
    "H31 H46",
    f"WITH {D_ODD} SELECT id FROM nr",
)(lambda t: G.dangling_relations(name_relations(t), odd_entities(t)))
query(
    "alias_collisions",
    "H31",
    """SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, count(*) AS titles, min(p_name) AS first_title, max(p_name) AS last_title FROM part GROUP BY key HAVING count(*) > 1""",
)(lambda t: G.alias_collisions(t.part.select(F.col("p_name").alias("title"))))
query("entity_types", "H31", f"SELECT type, count(*) AS entities FROM ({D_ENT}) GROUP BY type")(lambda t: G.type_histogram(entities(t)))
query(
    "unmapped_relations",
    "H31",
    f"WITH {D_REL} SELECT id FROM rel WHERE id LIKE '%5'",
)(lambda t: G.unmapped_relations(relations(t), ledger(t).where("id NOT LIKE '%5'")))


def membership(t):
    return t.part.select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_brand").alias("community"), F.lit(1).alias("level")).unionByName(
        t.part.select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_type").alias("community"), (F.col("p_size") % 2 * 2).cast("int").alias("level")))


def nodes(t):
    pages = refs(t).select("source_id", "page_no")
    reviews = t.supplier.where("s_acctbal < 0").select(F.col("s_name").alias("title"), F.lit("open").alias("review"))
    return G.node_payload(entities(t), relations(t), membership(t), ledger(t), pages, reviews)


query(
    "node_payload",
    "H26",
    f"""WITH {D_REL}, {D_SRC}, dg AS (SELECT k, count(*) AS degree FROM (SELECT sk AS k FROM rel UNION ALL SELECT tk FROM rel) GROUP BY k),
sr AS (SELECT id, count(DISTINCT source_id) AS sources, count(DISTINCT CASE WHEN source_id LIKE 'r%' THEN 1 + substr(source_id, 2)::BIGINT % 30 END) AS pages,
   min(CASE WHEN source_id LIKE 'r%' THEN 1 + substr(source_id, 2)::BIGINT % 30 END)::INT AS first_page
  FROM (SELECT target AS id, unit_id FROM occ UNION SELECT source, unit_id FROM occ) JOIN src USING (unit_id) GROUP BY id)
SELECT ent.id, title AS label, ent.type, coalesce(degree, 0) AS degree, CASE WHEN ent.id LIKE 'p%' THEN CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END END AS community,
  coalesce(sources, 0) AS sources, coalesce(pages, 0) AS pages, first_page, CASE WHEN s_acctbal < 0 THEN 'open' END AS review
FROM ent LEFT JOIN dg ON dg.k = ent.id LEFT JOIN sr USING (id) LEFT JOIN part ON ent.id = concat('p', p_partkey) LEFT JOIN supplier ON s_name = title""",
)(nodes)


def assertions(t):
    k = relations(t).where("weight > 1")
    return k.select("source", "target", F.lit("USES").alias("kind"), F.lit("q").alias("evidence"), F.col("id").alias("source_record_id")).unionByName(
        k.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("DERIVED_FROM").alias("kind"), F.lit("q").alias("evidence"), F.col("id").alias("source_record_id")))


def edges(t):
    reviews = relations(t).where("weight = 2").select(G.relationship_key(F.col("source"), F.col("target"), F.col("description")).alias("key"), F.lit("seen").alias("review"))
    return G.edge_payload(relations(t), entities(t), assertions(t), reviews)


query(
    "edge_payload",
    "H26 H43",
    f"""WITH {D_REL} SELECT id, sk AS source_id, tk AS target_id, source AS source_label, target AS target_label, weight, CASE WHEN weight > 1 THEN 2 ELSE 0 END::BIGINT AS assertions,
  CASE WHEN weight = 2 THEN 'seen' END AS review FROM rel""",
)(edges)
query(
    "edge_assertions",
    "H26",
    f"""WITH {D_REL} SELECT id, source, target, 'USES' AS kind, true AS forward FROM rel WHERE weight > 1 UNION ALL SELECT id, target, source, 'DERIVED_FROM', false FROM rel WHERE weight > 1""",
)(lambda t: G.edge_assertions(relations(t), assertions(t)).select("id", "source", "target", "kind", "forward"))
query(
    "relationship_keys",
    "H43",
    f"""WITH {D_REL} SELECT id, sha256(concat('["', source, '","', target, '",""]')) AS key FROM rel""",
)(lambda t: relations(t).select("id", G.relationship_key(F.col("source"), F.col("target"), F.col("description")).alias("key")))
query(
    "explore_nodes",
    "H41",
    f"""WITH {D_REL} SELECT id, title AS label FROM ent WHERE contains(lower(title), 'ring') AND type = 'ECONOMY'""",
)(lambda t: G.explore(nodes(t), edges(t), kind="ECONOMY", needle="Ring")[0].select("id", "label"))
query(
    "explore_edges",
    "H41",
    f"""WITH {D_REL} SELECT rel.id FROM rel WHERE contains(lower(source), '1') AND contains(lower(target), '1')""",
)(lambda t: G.explore(nodes(t), edges(t), needle="1")[1].select("id"))
query(
    "viewer_differences",
    "H29",
    f"""WITH {D_ENT.join(['e AS (', ')'])} SELECT id, 'missing' AS fault FROM e WHERE id LIKE 's%' UNION ALL SELECT concat(id, 'x'), 'extra' FROM e WHERE type = 'MEDIUM'
UNION ALL SELECT id, 'duplicate' FROM e WHERE type = 'ECONOMY'""",
)(
    lambda t: (lambda e: G.viewer_differences(e, e.where("id LIKE 'p%'").unionByName(e.where("type = 'ECONOMY'")).unionByName(e.where("type = 'MEDIUM'").withColumn("id", F.concat("id", F.lit("x"))))))(entities(t))
)
query(
    "wrong_endpoints",
    "H29",
    f"WITH {D_REL} SELECT id FROM rel WHERE weight > 1",
)(lambda t: G.wrong_endpoints(relations(t), edges(t).withColumn("source_id", F.when(F.col("weight") > 1, F.col("target_id")).otherwise(F.col("source_id"))), entities(t).select("id", F.col("title").alias("label"))))
query(
    "reference_relations",
    "H32",
    f"""WITH {D_REL} SELECT l_orderkey * 10 + l_linenumber AS fact_id, bool_or(l_returnflag = 'R') AS in_scope, CASE WHEN bool_or(l_returnflag = 'R') THEN bool_or(concat('s', (l_suppkey + 1)) || '-' || concat('p', l_partkey) IN (SELECT id FROM rel)) END AS endpoint_pair_present
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1""",
)(
    lambda t: G.reference_relations(
        t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first("l_partkey").alias("p"), F.first("l_suppkey").alias("s"), F.first("l_returnflag").alias("f")).where("n = 1")
        .join(entities(t).select(F.col("id").alias("pid"), F.col("title").alias("pt")), F.col("pid") == F.concat(F.lit("p"), "p"), "left")
        .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.coalesce("pt", F.lit("?")).alias("subject"),
                F.concat(F.lit("supplier#"), F.lpad((F.col("s") + 1).cast("string"), 9, "0")).alias("object"), F.array("f").alias("refs")),
        relations(t), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_returnflag").alias("ref")).distinct())
)
query(
    "review_sample",
    "H33",
    f"""WITH {D_REL} SELECT id, sample_key FROM (SELECT id, sha256(concat_ws(chr(31), '42', source, target, '')) AS sample_key FROM rel) ORDER BY sample_key LIMIT 24""",
)(lambda t: G.review_sample(relations(t)).select("id", "sample_key"))
query(
    "build_coverage",
    "H34",
    """SELECT 'unit_without_extraction' AS kind, concat('u', o_orderkey) AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL
SELECT 'unit_without_source', concat('u', o_orderkey) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT DISTINCT 'unmapped_record', concat('c', c_custkey) FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 <> 0) UNION ALL SELECT 'community_without_report', '1-URGENT'""",
)(
    lambda t: G.coverage(
        units(t), sources(t).where("CAST(substring(unit_id, 2, 20) AS BIGINT) % 7 <> 0"),
        units(t).join(t.orders.where("o_orderstatus <> 'P'").select(F.concat(F.lit("u"), "o_orderkey").alias("id")), "id").select(F.sha2(F.trim("text"), 256).alias("text_sha256")),
        t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("source_id")),
        t.orders.select(F.col("o_orderpriority").alias("community")), t.orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderpriority").alias("community")))
)


def gate_rules(t):
    """A targeted rule per region name: does an assertion about it exist?"""
    return t.region.select(F.concat(F.lit("targeted_"), "r_name").alias("gate"), F.lit("USES").alias("kind"), F.lit("supplier").alias("source_like"),
                           F.when(F.col("r_regionkey") % 2 == 0, "ring").otherwise("no such part").alias("target_like"), F.lit(True).alias("expected"))


query(
    "rebuild_gates",
    "H28 H36",
    f"""WITH {D_REL}, {D_ODD} SELECT 'no_citation_nodes' AS gate, NOT bool_or(title LIKE 'Smith%') AS passed FROM odd UNION ALL SELECT 'no_table_reference_nodes', NOT bool_or(title LIKE 'Table%') FROM odd
UNION ALL SELECT 'all_native_edges_have_assertion_provenance', count(*) FILTER (WHERE weight = 1) = 0 FROM rel UNION ALL SELECT 'processing_complete', count(*) FILTER (WHERE o_orderstatus = 'P') = 0 FROM orders
UNION ALL SELECT concat('targeted_', r_name), r_regionkey % 2 = 0 AND (SELECT count(*) > 0 FROM rel WHERE weight > 1 AND contains(target, 'ring')) FROM region""",
)(lambda t: G.rebuild_gates(relations(t), assertions(t), G.name_audit(odd_entities(t), name_relations(t)), t.orders.where("o_orderstatus = 'P'"), gate_rules(t)))

# Components: customers with their orders, and suppliers with their nation.
NODES = """SELECT concat('c', CAST(c_custkey AS STRING)) AS id FROM {customer} UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)) FROM {orders}
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)) FROM {supplier}"""
LINKS = """SELECT concat('o', CAST(o_orderkey AS STRING)) AS source, concat('c', CAST(o_custkey AS STRING)) AS target FROM {orders}
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('s', CAST(s_suppkey + 1 AS STRING)) FROM {supplier} WHERE s_suppkey % 10 <> 9"""

query(
    "connected_components",
    "H38",
    """SELECT concat('c', c_custkey) AS id, concat('c', c_custkey) AS component FROM customer UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey) FROM orders
UNION ALL SELECT concat('s', s_suppkey), least(concat('s', s_suppkey - s_suppkey % 10), concat('s', s_suppkey - s_suppkey % 10 + 9)) FROM supplier""",
)(lambda t: G.connected_components(t.sql(NODES), t.sql(LINKS)))


# Communities: customers hang on their nations, nations on their regions.
COMMUNITY_EDGES = """SELECT concat('c', CAST(c_custkey AS STRING)) AS source, concat('n', CAST(c_nationkey AS STRING)) AS target, 10 AS weight FROM {customer}
UNION ALL SELECT concat('n', CAST(c_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), CAST(8 * count(*) AS INT) FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY ALL"""
COMMUNITY_NODES = """SELECT concat('c', CAST(c_custkey AS STRING)) AS id FROM {customer} UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)) FROM {nation}
UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)) FROM {region}"""


def membership_levels(t):
    return stage(C.hierarchy(t.sql(COMMUNITY_NODES), t.sql(COMMUNITY_EDGES)))


# A region is the best part of the whole, a nation that of its region; the node of a region sides with its largest nation.
D_LEVELS = """cu AS (SELECT concat('c', c_custkey) AS id, concat('n', c_nationkey) AS nat, concat('r', n_regionkey) AS reg FROM customer JOIN nation ON n_nationkey = c_nationkey),
side AS (SELECT reg, nat FROM cu GROUP BY reg, nat QUALIFY row_number() OVER (PARTITION BY reg ORDER BY count(*) DESC, nat) = 1),
flat AS (SELECT id, nat, reg FROM cu UNION ALL SELECT DISTINCT nat, nat, reg FROM cu UNION ALL SELECT reg, nat, reg FROM side),
alone AS (SELECT id FROM (SELECT concat('n', n_nationkey) AS id FROM nation UNION ALL SELECT concat('r', r_regionkey) FROM region) WHERE id NOT IN (SELECT id FROM flat)),
l0 AS (SELECT id, reg, nat, concat('0-', min(id) OVER (PARTITION BY reg)) AS community, count(*) OVER (PARTITION BY reg) AS n, count(DISTINCT nat) OVER (PARTITION BY reg) AS parts FROM flat),
lv AS (SELECT id, 0 AS level, community, NULL AS parent FROM l0 UNION ALL SELECT id, 0, concat('0-', id), NULL FROM alone
  UNION ALL SELECT id, 1, concat('1-', min(id) OVER (PARTITION BY reg, nat)), community FROM l0 WHERE n > 10 AND parts > 1)"""
query("communities", "H39", f"WITH {D_LEVELS} SELECT id, level, community, parent FROM lv")(membership_levels)
query("community_sizes", "H39", f"WITH {D_LEVELS} SELECT community, level, parent, count(*) AS size FROM lv GROUP BY ALL")(lambda t: C.sizes(membership_levels(t)))


def graph_entities(t):
    return t.sql(COMMUNITY_NODES).select("id", F.col("id").alias("title"), F.substring("id", 1, 1).alias("type"))


def graph_links(t):
    return t.sql(COMMUNITY_EDGES).select(F.concat_ws(">", "source", "target").alias("id"), "source", "target")


query(
    "node_communities",
    "H26 H39",
    f"""WITH {D_LEVELS}, dg AS (SELECT title, count(*) AS degree FROM (SELECT id AS title FROM cu UNION ALL SELECT nat FROM cu UNION ALL SELECT DISTINCT nat FROM cu UNION ALL SELECT reg FROM (SELECT DISTINCT nat, reg FROM cu)) GROUP BY title)
SELECT id, substr(id, 1, 1) AS type, coalesce(degree, 0) AS degree, community FROM lv LEFT JOIN dg ON title = id WHERE level = 0""",
)(
    lambda t: G.node_payload(
        graph_entities(t), graph_links(t), membership_levels(t).withColumnRenamed("id", "entity_id"), ledger(t).where("false"), refs(t).select("source_id", "page_no"),
        t.region.select(F.col("r_name").alias("title"), F.lit("x").alias("review")).where("false")).select("id", "type", "degree", "community")
)


def entity_hits(t):
    """Nearest vectors per index; vector ids name parts."""
    h = hits(t, 10).where("channel = 'query_0'")
    return h.join(entities(t).select("id", "title"), F.concat(F.lit("p"), "chunk_id") == F.col("id")).select(F.col("query_id").alias("question_id"), "id", "title", "distance", "ordinal")


query(
    "local_graph_context",
    "H40",
    f"""WITH {D_QUERIES}, {D_REL}, eh AS (SELECT h.index_id AS question_id, ent.id, ent.title, row_number() OVER (PARTITION BY h.index_id ORDER BY distance, vec_id)::INT AS place FROM hits h JOIN ent ON ent.id = concat('p', vec_id) WHERE channel = 'query_0' AND rank <= 10 QUALIFY place <= 8),
rr AS (SELECT question_id, rel.id, row_number() OVER (PARTITION BY question_id ORDER BY weight DESC, rel.id)::INT AS place FROM eh JOIN rel ON rel.target = eh.title),
un AS (SELECT question_id, unit_id, count(*) AS n FROM eh JOIN (SELECT DISTINCT target, unit_id FROM occ) o ON o.target = eh.id GROUP BY question_id, unit_id),
uu AS (SELECT question_id, unit_id, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, unit_id)::INT AS place FROM un)
SELECT question_id, 'entities' AS category, id, place FROM eh UNION ALL SELECT question_id, 'relationships', id, place FROM rr WHERE place <= 12 UNION ALL SELECT question_id, 'sources', unit_id, place FROM uu WHERE place <= 20""",
)(lambda t: G.local_context(entity_hits(t), relations(t), occurrences(t).select(F.col("target").alias("id"), "unit_id").distinct()))
