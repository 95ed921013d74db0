"""DuckDB SQL for the queries of ``catalog``."""

from __future__ import annotations

RAW = """raw AS (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+') AS l FROM documents)),
words AS (SELECT doc_id, i, w AS word FROM raw WHERE w <> '')"""
TOKENS = RAW + r""",
kept AS (SELECT doc_id, i, replace(word, '&#039;', '') AS w FROM words),
trimmed AS (SELECT doc_id, i, regexp_replace(replace(w, '''', ''), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') AS w FROM kept
  WHERE strlen(w) <= 50 AND NOT contains(w, '&#') AND NOT contains(w, '&nbsp') AND NOT contains(w, '&lrm') AND NOT contains(w, '&rlm')),
parts AS (SELECT doc_id, i, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS j
  FROM (SELECT doc_id, i, list_filter(string_split(w, '-'), lambda x: x <> '') AS p FROM trimmed WHERE w <> '')),
postings AS (SELECT (doc_id % 5)::INTEGER AS chunk, doc_id AS doc_idx,
  translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j))::INTEGER AS pos FROM parts)"""
DOCS = """docs AS (SELECT doc_id AS doc_idx, (doc_id % 5)::INTEGER AS chunk,
  'https://' || coalesce(source, 'none') || '.example.org/' || coalesce(lang, 'none') || '/' || doc_id AS url FROM documents)"""


def low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def has(term: str) -> str:
    return f"SELECT DISTINCT chunk, doc_idx FROM postings WHERE term = '{term}'"


def phrase(*terms: str) -> str:
    joins = " ".join(f"JOIN postings p{k} ON p{k}.doc_idx = p0.doc_idx AND p{k}.pos = p0.pos + {k} AND p{k}.term = '{t}'" for k, t in enumerate(terms) if k)
    return f"SELECT DISTINCT p0.chunk, p0.doc_idx FROM postings p0 {joins} WHERE p0.term = '{terms[0]}'"


def with_tokens(sql: str, *more: str) -> str:
    return f"WITH {', '.join([TOKENS, *more])} {sql}"


def spans(terms: list[str]) -> str:
    """anchors(chunk, doc_idx, pos, span) of the matches m(chunk, doc_idx)."""
    order = " ".join(f"WHEN bool_or(term = '{t}') THEN '{t}'" for t in terms)
    listed = ", ".join(f"('{t}', {k})" for k, t in enumerate(terms))
    return f"""q(term, k) AS (VALUES {listed}),
hits AS (SELECT p.* FROM postings p JOIN m USING (chunk, doc_idx) WHERE p.term IN (SELECT term FROM q)),
anchor AS (SELECT doc_idx, CASE {order} END AS term FROM hits GROUP BY doc_idx),
a AS (SELECT h.chunk, h.doc_idx, h.term, h.pos FROM hits h JOIN anchor USING (doc_idx, term)),
near AS (SELECT a.chunk, a.doc_idx, a.pos, q.k, coalesce(min(abs(h.pos - a.pos)), 1000) AS d
  FROM a JOIN q ON q.term <> a.term LEFT JOIN hits h ON h.doc_idx = a.doc_idx AND h.term = q.term GROUP BY a.chunk, a.doc_idx, a.pos, q.k),
anchors AS (SELECT a.chunk, a.doc_idx, a.pos, coalesce(sum(n.d), 0)::INTEGER AS span
  FROM a LEFT JOIN near n ON n.doc_idx = a.doc_idx AND n.pos = a.pos GROUP BY a.chunk, a.doc_idx, a.pos)"""


def dynamic(n: int) -> str:
    limit = n * (n + 1)
    return f"""dyn AS (SELECT chunk, doc_idx, (32 * least(8, count(*) FILTER (span > 0 AND span < {limit})) + count(*) FILTER (pos < 256)
  + 16 * least(8, count(*) FILTER (span > 0 AND span < {limit} AND pos < 256)))::INTEGER AS score FROM anchors GROUP BY chunk, doc_idx)"""


URL_PARTS = f"""url_cut AS (SELECT *, contains(url, '://') AS has, regexp_extract(url, '://([^/?#]*)', 1) AS h0,
    regexp_matches(url, '://[^/?#]*[/?#]') AS ended, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p0, contains({low('url')}, 'wikipedia') AS fold FROM urls),
url_case AS (SELECT *, CASE WHEN NOT has THEN '' WHEN fold THEN {low('h0')} ELSE h0 END AS h1,
    CASE WHEN NOT (has AND ended) THEN '/' WHEN fold THEN {low('p0')} ELSE p0 END AS p1 FROM url_cut),
url_parts AS (SELECT *, translate(h1, '-_', '  ') AS host, translate(p1, '-_', '  ') AS path, regexp_extract(p1, '^/([^/]+)', 1) AS first_path_segment FROM url_case)"""


def url_scores(leaves: list[list[str]]) -> str:
    """url_scored(*, url_score) over url_parts."""
    terms = [t for leaf in leaves for t in leaf]
    share = lambda t, p: f"CASE WHEN strlen({p}) > 0 AND contains({p}, '{t}') THEN {len(t)}::FLOAT * (1.0::DOUBLE / greatest(strlen({p}), 1))::FLOAT ELSE 0::FLOAT END"
    best = lambda p: "greatest(" + ", ".join(["0::FLOAT", *(share(t, p) for t in terms), "0::FLOAT"]) + ")"
    extra = " + ".join(["0", *(f"CASE WHEN {' AND '.join(f"contains({p}, '{t}')" for t in leaf)} THEN {n} ELSE 0 END" for leaf in leaves if len(leaf) > 1 for p, n in (("host", 128), ("path", 64)))])
    steps = lambda s, cuts, n: "CASE " + " ".join(f"WHEN {s} > {c}::FLOAT THEN {n >> k}" for k, c in enumerate(cuts)) + " END"
    narrow, wide = (0.5, 0.3, 0.15), (0.7, 0.5, 0.3)
    return f"""url_best AS (SELECT *, {best('host')} AS hs, {best('path')} AS ps, {extra} AS extra FROM url_parts),
url_scored AS (SELECT *, (coalesce(CASE WHEN strlen(host) <= 16 THEN {steps('hs', narrow, 256)} ELSE {steps('hs', wide, 256)} END,
    CASE WHEN strlen(path) <= 16 THEN {steps('ps', narrow, 256)} ELSE {steps('ps', wide, 128)} END, 0) + extra)::INTEGER AS url_score,
    CASE WHEN strlen(path) <= 16 THEN 64 ELSE 0 END AS short_path FROM url_best)"""


def search(match_sql: str, leaves: list[list[str]]) -> str:
    """WITH clause of ranked(chunk, doc_idx, url, rank) for a match query over postings."""
    terms = [t for leaf in leaves for t in leaf]
    parts = [TOKENS, DOCS, f"m AS ({match_sql})"]
    if len(terms) > 1:
        parts += [spans(terms), dynamic(len(terms)), "urls AS (SELECT m.chunk, m.doc_idx, docs.url FROM m JOIN docs USING (chunk, doc_idx))", URL_PARTS, url_scores(leaves),
                  "ranked AS (SELECT u.chunk, u.doc_idx, u.url, (d.score + u.url_score + u.short_path)::INTEGER AS rank FROM url_scored u JOIN dyn d USING (chunk, doc_idx))"]
    else:
        w = terms[0]
        bonus = f"""CASE WHEN (contains(host, 'wikipedia') OR contains(host, 'dictionary')) AND strpos(path, '{w}') > 0
          AND (strpos(path, '{w}') = 1 OR substr(path, strpos(path, '{w}') - 1, 1) = '/') AND substr(path, strpos(path, '{w}') + {len(w)}, 1) IN ('', '/') THEN 1000 ELSE 0 END"""
        parts += ["urls AS (SELECT m.chunk, m.doc_idx, docs.url FROM m JOIN docs USING (chunk, doc_idx) WHERE strlen(docs.url) < 64)", URL_PARTS, url_scores(leaves),
                  f"ranked AS (SELECT chunk, doc_idx, url, (url_score + short_path + {bonus})::INTEGER AS rank FROM url_scored)"]
    return "WITH " + ", ".join(parts)


ENTITY_ROWS = ["a &amp; b", "x &lt;y&gt; &quot;z&quot;", "&unknown; &amp", "&#65;&#x42;", "caf&#233; &euro;5 &hellip;", "&amp;lt;", "&#1114112;|"]
ENTITY_WANT = ["a & b", 'x <y> "z"', "&unknown; &amp", "AB", "café €5 …", "&lt;", "|"]
ARITH_ROWS = ["1 2", "2*+3", "--5", "7/-2", "(1+2)*3", "1/0", "2(3)", "9223372036854775807+1", "a1b+c2"]
ARITH_WANT = ["12", "6", "5", "-3", "9", "Syntax error", "Syntax error", "-9223372036854775808", "3"]
