"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .urls import ALPHABET, RULES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_SPACED, _ALNUM = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[p.k:p.k+4], ' ') AS g FROM d, (SELECT unnest(range(1, 1000000)) AS k) p WHERE len(w) > 0 AND p.k <= greatest(1, len(w)-4)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*c >= 80*(x.n+y.n-c)),
 e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
 m AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.u = documents.doc_id""".replace("(SELECT unnest(range(1, 1000000)) AS k)", "(SELECT unnest(range(1, (SELECT max(len(w))+1 FROM d))) AS k)")

CONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark),
 k AS (SELECT unnest(range(1, (SELECT max(len(w))+1 FROM d))) AS k),
 bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k+least(10, len(w))-1], ' ') AS g FROM b, k WHERE len(w) > 0 AND k <= len(w)-least(10, len(w))+1),
 dw AS (SELECT doc_id, k, z.n, array_to_string(w[k:k+z.n-1], ' ') AS g FROM d, k, (SELECT DISTINCT n FROM bw) z WHERE k <= len(w)-z.n+1),
 hit AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k+n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""

BACKOFF = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
 t AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w)+1)) AS p FROM d),
 c AS (SELECT *, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 c1 AS (SELECT w, count(*) AS n FROM c GROUP BY w), c2 AS (SELECT v, w, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY v, w), c3 AS (SELECT u, v, w, count(*) AS n FROM c WHERE u IS NOT NULL GROUP BY u, v, w),
 x AS (SELECT c.doc_id, least(c.p, 3) AS m, c3.n AS n3, c2.n AS n2, c1.n AS n1, b2.n AS x3, b1.n AS x2, (SELECT count(*) FROM t) AS x1
  FROM c JOIN c1 USING (w) LEFT JOIN c2 ON c2.v = c.v AND c2.w = c.w LEFT JOIN c3 ON c3.u = c.u AND c3.v = c.v AND c3.w = c.w LEFT JOIN c2 b2 ON b2.v = c.u AND b2.w = c.v LEFT JOIN c1 b1 ON b1.w = c.v),
 y AS (SELECT doc_id, CASE WHEN n3 >= 2 THEN ln(n3::DOUBLE/x3) WHEN n2 >= 2 THEN ln(n2::DOUBLE/x2)+(m-2)*ln(0.4::DOUBLE) ELSE ln(n1::DOUBLE/x1)+(m-1)*ln(0.4::DOUBLE) END AS l, n3 IS NULL OR n3 < 2 AS back FROM x),
 z AS (SELECT doc_id, count(*) AS n_words, sum(l) AS log_prob, count(*) FILTER (back) AS n_backoff FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log_prob, 0), 3) AS log_prob, round(log_prob/n_words, 6) AS score, coalesce(n_backoff, 0) AS n_backoff FROM d LEFT JOIN z USING (doc_id)"""

_SIZE = float(len(ALPHABET))


def _rule() -> str:
    cases = []
    for _, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1])):
        domain, _, start = r.partition("/")
        cases.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{start}') THEN '{r}'")
    return "CASE " + " ".join(cases) + " END"


def _smoothed(c: str) -> str:
    p0 = f"((o0.c{c}+1.0::DOUBLE)/(z0.s{c}+{_SIZE}::DOUBLE))"
    p1 = f"(CASE WHEN z1.s{c}+z1.d{c} > 0 THEN (o1.c{c}+z1.d{c}*{p0})/(z1.s{c}+z1.d{c}) ELSE {p0} END)"
    return f"(CASE WHEN z2.s{c}+z2.d{c} > 0 THEN (o2.c{c}+z2.d{c}*{p1})/(z2.s{c}+z2.d{c}) ELSE {p1} END)"


_SETTLED = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES) + " END"
URLS = rf"""WITH h AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 b AS (SELECT *, {_rule()} AS rule FROM h),
 s AS (SELECT page_id, host, path, rule, {_SETTLED} AS settled, '^^' || regexp_replace(regexp_replace(translate(regexp_replace(coalesce(url, ''), '(?s)^.*?://', ''), '{_UPPER}', '{_UPPER.lower()}'), '[0-9]+', '0', 'g'), '(?s)[^a-z0\-./?=&_:#]', '~', 'g') || '$' AS s FROM b),
 g AS (SELECT page_id, settled, unnest([s[k:k+2] for k in range(1, length(s)-1)]) AS gram FROM s),
 c AS (SELECT gram, count(*) FILTER (settled = 'allow') AS n0, count(*) FILTER (settled = 'block') AS n1 FROM g GROUP BY gram),
 {', '.join(f"o{k} AS (SELECT gram[{3 - k}:3] AS t, sum(n0)::DOUBLE AS c0, sum(n1)::DOUBLE AS c1 FROM c GROUP BY 1), z{k} AS (SELECT t[1:{k}] AS x, sum(c0) AS s0, sum(c1) AS s1, count(*) FILTER (c0 > 0)::DOUBLE AS d0, count(*) FILTER (c1 > 0)::DOUBLE AS d1 FROM o{k} GROUP BY 1)" for k in range(3))},
 m AS (SELECT gram, ln({_smoothed('1')})-ln({_smoothed('0')}) AS delta FROM c {' '.join(f"JOIN o{k} ON o{k}.t = gram[{3 - k}:3] JOIN z{k} ON z{k}.x = gram[{3 - k}:2]" if k else "JOIN o0 ON o0.t = gram[3:3] JOIN z0 ON true" for k in range(3))}),
 a AS (SELECT page_id, sum(delta)/count(*) AS score FROM g JOIN m USING (gram) GROUP BY page_id),
 f AS (SELECT avg(score) FILTER (settled = 'allow') AS m0, avg(score) FILTER (settled = 'block') AS m1 FROM s JOIN a USING (page_id))
SELECT page_id, host, path, rule, coalesce(settled, CASE WHEN (m1-m0)*(score-(m0+m1)/2) > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM s JOIN a USING (page_id), f"""

ORACLE_SQL = {"op6_jaccard_join": JACCARD, "op7_lm_scoring": BACKOFF, "op9_url_filter": URLS, "op10_decontamination": CONTAMINATION}
