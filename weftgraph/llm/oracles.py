"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WARC = """WITH p AS (SELECT CAST(page_id AS BIGINT) page_id, coalesce(html, '') html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) n, sha256(html) h FROM p),
g AS (SELECT h, min(page_id) f FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
CASE WHEN g.f IS NOT NULL AND page_id IS DISTINCT FROM g.f THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN g.f IS NOT NULL AND page_id IS DISTINCT FROM g.f THEN g.f END AS refers_to FROM d LEFT JOIN g ON d.h = g.h AND n >= 100"""

# Two sets of that similarity share one at least of each set's n - ceil(0.8 n) + 1 rarest shingles, so only such pairs are counted.
NEAR = r"""WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) x FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id), f AS (SELECT x, count(*) f FROM s GROUP BY x),
rare AS MATERIALIZED (SELECT doc_id, x, n FROM (SELECT s.doc_id, s.x, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, s.x) r FROM s JOIN f USING (x) JOIN n USING (doc_id)) WHERE r <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.doc_id a, b.doc_id b FROM rare a JOIN rare b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
k AS (SELECT a, b, count(*) k FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b AND q.x = p.x GROUP BY a, b),
e AS MATERIALIZED (SELECT a, b FROM k JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
y AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT y.b, r.c FROM r JOIN y ON y.a = r.id WHERE r.c < y.b), z AS (SELECT id, min(c) c FROM r GROUP BY id)
SELECT w.doc_id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN z ON z.id = w.doc_id"""


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind, its pattern with one group around all and, for assign, one around the value, least length.
_KINDS = (
    ("assign", rf"""((?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),  # runs are as long as they can be, so the short ones need not be listed
    ("pem", r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, 0),
    ("ghp", r"(gh[pousr]_[A-Za-z0-9]{36})", 1, 0),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 0),
)


def _secrets() -> str:
    """Matches of a kind, and the pieces between them, whose lengths give the places."""
    parts = []
    for i, (kind, pattern, group, least) in enumerate(_KINDS):
        q = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} k, '{kind}' kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0), 'n': len(m[i]), 'v': len(v[i])}})) s, {least} least "
            f"FROM (SELECT doc_id, regexp_extract_all(t, '{q}', 1) m, regexp_extract_all(t, '{q}', {group}) v, string_split_regex(t, '{q}') p FROM t)"
        )
    return (
        "WITH t AS MATERIALIZED (SELECT CAST(doc_id AS BIGINT) doc_id, coalesce(text, '') t FROM documents), raw AS (" + " UNION ALL ".join(parts) + "), "
        "f AS (SELECT doc_id, k, kind, CAST(s.a AS BIGINT) a, kind || ':' || CAST(s.a AS BIGINT) || ':' || CAST(s.a + s.n AS BIGINT) span FROM raw WHERE s.v >= least), "
        "g AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) na, count(*) FILTER (WHERE k = 1) nc, count(*) FILTER (WHERE k = 2) nh, string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3) base, string_agg(span, ',' ORDER BY a, k) spans FROM f GROUP BY doc_id) "
        "SELECT t.doc_id AS doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON g.doc_id = t.doc_id"
    )


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

SEARCH = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () r, CAST(vec_id AS BIGINT) vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.r, q.vec_id query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) k FROM s) WHERE k <= 20"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and exact floored means, written out."""
    at = lambda n: f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) c, min(d) d FROM (SELECT v.r, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) d FROM v, c{n} c) GROUP BY r)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () r, CAST(vec_id AS BIGINT) vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 c, v FROM v) WHERE c < {k})",
        at(0),
    ]
    for n in range(1, rounds + 1):
        parts += [
            f"m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) v FROM (SELECT c, i, sum(v[i]) s, count(*) n FROM (SELECT a.c, v.v, unnest(range(1, 65)) i FROM a{n - 1} a JOIN v ON v.r = a.r) GROUP BY c, i) GROUP BY c)",
            f"c{n} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) v FROM c{n - 1} o LEFT JOIN m{n} m USING (c))",
            at(n),
        ]
    return (
        "WITH " + ", ".join(parts) + f" SELECT v.vec_id AS vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a ON a.r = v.r JOIN c{rounds} c ON c.c = a.c"
    )


SQL = {"op11_impact_search": SEARCH, "op13_centroid_clusters": _clusters(), "op3_warc": WARC, "op4_near_dedup": NEAR, "op6_secret_scan": _secrets()}
