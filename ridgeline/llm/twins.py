"""SQL twins of corpus operators whose results do not depend on the method: the contract, spelled as brute force."""

from __future__ import annotations

from ridgeline.llm.secret_ledger import BASE
from ridgeline.llm.url_templates import CRITICAL, LIMIT, LOWER, RULES, SHAPES, STRENGTH, UPPER


def _any_case(pattern: str) -> str:
    """The keywords before the first closing bracket with both cases of each letter; a case-blind match
    would also take letters outside ASCII that fold to these."""
    head, tail = pattern.split(")", 1)
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail


def _hits(number: int) -> str:
    """List of {start, kind, stop} of one rule: where a match starts follows from the pieces between the matches."""
    rule = BASE[number]
    pattern = (_any_case(rule.pattern) if rule.any_case else rule.pattern).replace("'", "''")
    matched, between = f"regexp_extract_all(text, '{pattern}')", f"string_split_regex(text, '{pattern}')"
    start = "length(coalesce(array_to_string(b[1:i], ''), '')) + length(coalesce(array_to_string(m[1:i - 1], ''), ''))"
    long_enough = f"length(regexp_extract(m[i], '{pattern}', {rule.group})) >= {rule.least}"
    return (
        f"SELECT row, list({{'start': {start}, 'kind': {number}, 'stop': {start} + length(m[i])}}) AS hits FROM "
        f"(SELECT row, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT row, {matched} AS m, {between} AS b FROM t)) WHERE {long_enough} GROUP BY row"
    )


SECRETS_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
k0 AS ({_hits(0)}), k1 AS ({_hits(1)}), k2 AS ({_hits(2)}),
together AS (
  SELECT doc_id, coalesce(len(k0.hits), 0)::BIGINT AS n_assign, coalesce(len(k1.hits), 0)::BIGINT AS n_access, coalesce(len(k2.hits), 0)::BIGINT AS n_hex,
         list_sort(list_concat(coalesce(k0.hits, []), coalesce(k1.hits, []), coalesce(k2.hits, []))) AS found
  FROM t LEFT JOIN k0 USING (row) LEFT JOIN k1 USING (row) LEFT JOIN k2 USING (row)
), spelled AS (
  SELECT *, coalesce(array_to_string(list_transform(found, lambda x: ['assign', 'access', 'hex'][x.kind + 1] || ':' || x.start || ':' || x.stop), ','), '') AS spans
  FROM together
)
SELECT doc_id, n_assign, n_access, n_hex, sha256(spans) AS base_sha256, spans FROM spelled
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT row, doc_id, list_sort(list_distinct(list_transform(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END),
         lambda i: array_to_string(w[i:i + 4], ' ')))) AS items
  FROM words
), named AS (
  SELECT doc_id, items, md5(array_to_string(items, chr(10))) AS name FROM shingled
), classes AS (
  SELECT name, any_value(items) AS items, len(any_value(items)) AS n, count(*) AS docs, min(doc_id) AS low FROM named GROUP BY name
), tokens AS (
  SELECT name, n, unnest(items) AS item FROM classes
), linked AS (
  SELECT a.name AS a, b.name AS b FROM tokens a JOIN tokens b ON a.item = b.item AND a.name <> b.name AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.name, b.name, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), reached AS (
  SELECT name AS a, name AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
), lowest AS (
  SELECT r.a AS name, min(c.low) AS class_id FROM reached r JOIN classes c ON r.b = c.name GROUP BY r.a
), links AS (
  SELECT l.a AS name, sum(c.docs) AS others FROM linked l JOIN classes c ON l.b = c.name GROUP BY l.a
)
SELECT d.doc_id, w.class_id, (c.docs - 1 + coalesce(l.others, 0))::BIGINT AS n_links
FROM named d JOIN classes c USING (name) JOIN lowest w USING (name) LEFT JOIN links l USING (name)
"""

FOREST_SQL = """
WITH RECURSIVE listed AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
  SELECT * FROM listed WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.98 END
), reached AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS low FROM reached GROUP BY a
), links AS (
  SELECT a, count(*) AS n FROM linked GROUP BY a
)
SELECT e.vec_id::BIGINT AS vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, e.vec_id)::BIGINT AS component_id, coalesce(low, e.vec_id) = e.vec_id AS kept
FROM listed e LEFT JOIN links ON links.a = e.vec_id LEFT JOIN lowest ON lowest.a = e.vec_id
"""

IMPORTANCE_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS step
), texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), words AS (
  SELECT row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), runs AS (
  SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
  FROM words
), counted AS (
  SELECT row, feature, count(*) AS n FROM runs GROUP BY row, feature
), hashed AS (
  SELECT feature, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda h: ('0x' || h)::BIGINT),
         lambda c, b: xor(c >> 8, step[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), crc
), placed AS (
  SELECT row, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (feature) GROUP BY row, bucket
), totals AS (
  SELECT coalesce(sum(n) FILTER (WHERE row > 0), 0) AS s, coalesce(sum(n) FILTER (WHERE row < 0), 0) AS t FROM placed
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(p.n) FILTER (WHERE row < 0), 0) + 1)::DOUBLE * (any_value(a.s) + 10000)::DOUBLE
         / ((coalesce(sum(p.n) FILTER (WHERE row > 0), 0) + 1)::DOUBLE * (any_value(a.t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM placed p, totals a GROUP BY bucket
), weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE row > 0 GROUP BY row
), scored AS (
  SELECT row, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row) WHERE row > 0
), places AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE able
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 5 // 100 FROM places) THEN place END AS rank
FROM scored LEFT JOIN places USING (row)
"""


def _by_rule(value: str) -> str:
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    ]
    return f"CASE {' '.join(cases)} END"


def _differs(cells: list[str]) -> str:
    """The chi-square distance of a branch from its siblings, above the critical value for the cells in use."""
    expected = {c: f"(p_{c} * n / p_n)" for c in cells}
    terms = [f"CASE WHEN {e} > 0 THEN pow({c} - {e}, 2) / {e} ELSE 0 END" for c, e in expected.items()]
    used = " + ".join(f"(p_{c} > 0)::INTEGER" for c in cells)
    return f"{' + '.join(terms)} > {list(CRITICAL)}[greatest({used} - 1, 1)]"


_NEXT = [f"next_{s}" for s in SHAPES]
_LABELS = ["blocked", "allowed", "open"]
_counted = ", ".join(f"coalesce(sum(n) FILTER (WHERE next = '{s}'), 0)::BIGINT AS next_{s}" for s in SHAPES)
_shape = (
    "CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'number' WHEN regexp_full_match(x, '[0-9]+[.][A-Za-z]+') THEN 'page' "
    "WHEN regexp_full_match(x, '[^0-9]{1,24}') THEN 'word' ELSE 'mixed' END"
)

URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), heads AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), urls AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM heads
), ruled AS (
  SELECT *, {_by_rule('text')} AS rule, {_by_rule('verdict')} AS by_rule FROM urls
), paths AS (
  SELECT host, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, count(*) AS n,
         count(*) FILTER (WHERE by_rule = 'block') AS blocked, count(*) FILTER (WHERE by_rule = 'allow') AS allowed
  FROM ruled GROUP BY host, path
), shaped AS (
  SELECT *, list_transform(parts, lambda x: {_shape}) AS shapes FROM paths
), placed AS (
  SELECT *, unnest(range(len(parts))) AS pos FROM shaped
), segments AS (
  SELECT host, path, n, blocked, allowed, pos, parts[pos + 1] AS segment, shapes[pos + 1] AS shape,
         coalesce(array_to_string(shapes[1:pos], '/'), '') AS above, coalesce(shapes[pos + 2], 'end') AS next
  FROM placed
), counts AS (
  SELECT host, pos, above, segment, sum(n)::BIGINT AS n, {_counted}, sum(blocked)::BIGINT AS blocked, sum(allowed)::BIGINT AS allowed,
         sum(n - blocked - allowed)::BIGINT AS open
  FROM segments WHERE shape = 'word' GROUP BY host, pos, above, segment
), pooled AS (
  SELECT host, pos, above, sum(n)::BIGINT AS p_n, count(*) AS siblings, {", ".join(f"sum({c})::BIGINT AS p_{c}" for c in _NEXT + _LABELS)}
  FROM counts GROUP BY host, pos, above
), literal AS (
  SELECT host, pos, above, segment, true AS is_literal FROM counts JOIN pooled USING (host, pos, above)
  WHERE siblings = 1 OR {_differs(_NEXT)} OR {_differs(_LABELS)}
), generalised AS (
  SELECT host, path, string_agg(CASE WHEN is_literal THEN '=' || segment ELSE '*' || shape END, '/' ORDER BY pos) AS template
  FROM segments LEFT JOIN literal USING (host, pos, above, segment) GROUP BY host, path
), rated AS (
  SELECT host, path, coalesce(template, '') AS template, blocked, allowed FROM paths LEFT JOIN generalised USING (host, path)
), base AS (
  SELECT (sum(blocked) + 0.5::DOUBLE) / (sum(blocked + allowed) + 1.0::DOUBLE) AS base FROM rated
), purity AS (
  SELECT host, template, (sum(blocked) + {STRENGTH}::DOUBLE * (SELECT base FROM base)) / (sum(blocked) + sum(allowed) + {STRENGTH}::DOUBLE) AS blocked_share,
         sum(blocked) + sum(allowed) AS told
  FROM rated GROUP BY host, template
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN told > 0 AND blocked_share > {LIMIT} AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict,
       template, blocked_share
FROM ruled JOIN rated USING (host, path) JOIN purity USING (host, template)
"""
