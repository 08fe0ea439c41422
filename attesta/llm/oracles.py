"""DuckDB statements for the queries that SQL can express; they share nothing with the operators but the contract."""

from __future__ import annotations

from attesta.llm import decontamination, ranked, rules

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{GAP}'), lambda x: x <> '')"


def decontamination_sql() -> str:
    """Containment of every item in every document that shares a shingle with it."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    grams = "unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))"
    return f"""WITH i AS (SELECT item_id, w, least(len(w), {decontamination.WIDTH}) AS k FROM (SELECT DISTINCT item_id, {_words(low)} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, k, {grams} AS g FROM i), n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
d AS (SELECT doc_id, w, k FROM (SELECT doc_id, {_words(low)} AS w FROM documents WHERE doc_id IS NOT NULL), (SELECT DISTINCT k FROM i)),
g AS (SELECT DISTINCT doc_id, k, {grams} AS g FROM d), s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM g JOIN q USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM s JOIN n USING (item_id) WHERE n_shared >= {decontamination.CONTAINED} * n_item"""


def rules_sql() -> str:
    """Exact quartiles by rank stand for the sketches, which are exact as long as a group has fewer rows than their accuracy."""
    quarter = lambda m, p: f"list_sort(list({m}))[greatest(1, ceil({p} * count(*)))::INT]"
    fences = lambda m, least: (
        f"{quarter(m, 0.25)} - {rules.REACH} * greatest({quarter(m, 0.5)} - {quarter(m, 0.25)}, {least / rules.REACH}) AS {m}_low, "
        f"{quarter(m, 0.75)} + {rules.REACH} * greatest({quarter(m, 0.75)} - {quarter(m, 0.5)}, {least / rules.REACH}) AS {m}_high"
    )
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"
    inside = " AND ".join(f"{m} BETWEEN coalesce(a.{m}_low, b.{m}_low, c.{m}_low) AND coalesce(a.{m}_high, b.{m}_high, c.{m}_high)" for m in rules.MEASURES)
    limits = ", ".join(fences(m, least) for m, least in rules.MEASURES.items())
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
wn AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wn) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c0 AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN rw ON rw.doc_id = d.doc_id),
m AS (SELECT *, {share('word_chars', 'n_words')} AS mean_word, {share('n_symbols', 'n_words')} AS symbol_share, {share('n_dup_lines', 'n_lines')} AS dup_line_share, {share('n_repeat_words', 'n_words')} AS repeat_share,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c0),
a AS (SELECT lang, source, {limits} FROM m WHERE NOT base_failed GROUP BY lang, source HAVING count(*) >= {rules.LEAST_ROWS}),
b AS (SELECT lang, {limits} FROM m WHERE NOT base_failed GROUP BY lang HAVING count(*) >= {rules.LEAST_ROWS}),
c AS (SELECT {limits} FROM m WHERE NOT base_failed)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {inside}, false) AS kept
FROM m LEFT JOIN a ON a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source LEFT JOIN b ON b.lang IS NOT DISTINCT FROM m.lang, c"""


def shards_sql(shards: int) -> str:
    """Prefix sums by a window over all rows; CRC-32 as a fold of the bytes over its table, made by its rule."""
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    octets = "list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"""WITH t AS MATERIALIZED (SELECT {table} AS crc), d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM documents, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS begins, sum(size) OVER () AS whole FROM d),
s AS (SELECT *, (begins * {shards} // whole)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM s"""


def ranked_sql(k: int) -> str:
    """Every document scored by a join of its terms with those of the items."""
    terms = lambda table: f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^{ranked.BREAK[1:-2]}]+') AS w FROM {table}"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms('documents')}),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS whole FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(w) AS t FROM (SELECT item_id, {terms('benchmark WHERE item_id IS NOT NULL')})),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // whole))))::BIGINT AS score
  FROM tf JOIN df USING (t) JOIN q USING (t), c WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= {k}"""


def trie_sql() -> str:
    """Prefixes as strings; the subtree of a node is all nodes whose least member passes through it that far down."""
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    octets = "list_transform(regexp_extract_all(hex(c::VARCHAR), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"""WITH t AS MATERIALIZED (SELECT {table} AS crc),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, n, xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT % 9 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY c), t),
l AS (SELECT v.c, v.h, v.n, least(v.h, coalesce(b.n, 0)) AS taken FROM v LEFT JOIN v AS b ON b.c = v.c - v.c % 5),
r AS (SELECT l.c, i AS d, role, text FROM l JOIN o ON o.c = l.c - l.c % 5 WHERE i <= h UNION ALL SELECT l.c, i - h + taken, role, text FROM l JOIN o ON o.c = l.c WHERE i > h),
s AS (SELECT c, d, text, string_agg(length(role) || ':' || length(text) || ':' || role || text, ',') OVER (PARTITION BY c ORDER BY d) AS p FROM r),
k AS (SELECT c, d, text, p FROM s UNION ALL SELECT c, 0, '', '' FROM v),
z AS (SELECT c, max(d) AS n FROM k GROUP BY c),
n AS (SELECT d, p, min(c) AS m, count(*) AS n_convs, (count(*) - 1) * octet_length(encode(any_value(text))) AS own, string_agg(CASE WHEN z.n = d THEN c::VARCHAR END, ',' ORDER BY c) AS ids FROM k JOIN z USING (c) GROUP BY d, p),
w AS (SELECT k.c, k.d, n.m FROM k JOIN n USING (d, p)),
g AS (SELECT n.*, a.m AS up FROM n LEFT JOIN w AS a ON a.c = n.m AND a.d = n.d - 1),
f AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY up, d),
e AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN f ON f.up = g.m AND f.d = g.d),
u AS (SELECT w.m, w.d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM e JOIN w ON w.c = e.m AND w.d <= e.d GROUP BY w.m, w.d)
SELECT e.m AS conv_id, e.d::BIGINT AS depth, up AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM e JOIN u ON u.m = e.m AND u.d = e.d"""
