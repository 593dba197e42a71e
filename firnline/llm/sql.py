"""SQL of the queries that DuckDB can express, over whole tables."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"[\x20\x09-\x0D]+"
_TERMS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: str, by: str) -> str:
    return f"list_filter(string_split_regex({text}, '{by}'), lambda x: x <> '')"


OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, n - 50)) AS s FROM n)),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS first FROM w) WHERE first < doc_id),
b AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM f),
g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM b),
r AS (SELECT doc_id, min(s) AS lo, max(s) + 50 AS hi FROM g GROUP BY doc_id, g),
e AS (SELECT doc_id, lo, hi FROM r UNION ALL SELECT doc_id, n, n FROM n),
p AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 0) AS before FROM e),
q AS (SELECT p.doc_id, sum(hi - lo)::BIGINT AS n_removed, sum(CASE WHEN hi > lo THEN 1 ELSE 0 END)::BIGINT AS n_spans,
  string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo, hi) AS kept FROM p JOIN n USING (doc_id) GROUP BY p.doc_id)
SELECT n.doc_id, n.n AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN q USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_split("coalesce(text, '')", _SPACES)} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s+19], ' ') ORDER BY doc_id, s) AS n FROM s),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM k WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_split(_LOW, _TERMS)} AS w FROM documents),
i AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, w, least(10, len(w)) AS span FROM (SELECT item_id, {_split(_LOW, _TERMS)} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, span, array_to_string(w[s:s+span-1], ' ') AS k FROM (SELECT item_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS s FROM i)),
dw AS (SELECT doc_id, span, s, array_to_string(w[s:s+span-1], ' ') AS k FROM (SELECT doc_id, w, span, unnest(generate_series(1, len(w) - span + 1)) AS s FROM d, (SELECT DISTINCT span FROM iw))),
h AS (SELECT doc_id, s, dw.span, item_id FROM dw JOIN iw ON dw.span = iw.span AND dw.k = iw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + span - 1)) AS p FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_split(_LOW, _SPACES)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+2], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

SQL = {"op1_suffixes": OP1, "op4_recompression": OP4, "op5_decontamination": OP5, "op9_near_duplicates": OP9}
