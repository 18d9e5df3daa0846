"""DuckDB SQL that gives the rows of those text queries that SQL can express."""

from __future__ import annotations

from framelake.llm.quality_rules import RULES as QUALITY_RULES
from framelake.llm.url_filters import RULES as URL_RULES

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_filters() -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda values: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in values) + " END"
    rule, verdict = case([(h + p, h, p) for _, h, p in ordered]), case(ordered)
    behind = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
    host = lambda u: f"translate(regexp_extract({behind(u)}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = lambda u: f"regexp_extract({behind(u)}, '^[^/?#]*([^?#]*)', 1)"
    bare = lambda u: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '([?&])&+', '\1', 'g')"

    def address(cols: str, table: str, u: str, name: str) -> str:
        return rf"SELECT {cols}, regexp_replace(regexp_replace({host('b')}, '^(?:www|m)\.', '') || regexp_extract({behind('b')}, '^[^/?#]*(.*)$', 1), '/+$', '') AS {name} FROM (SELECT *, {bare(u)} AS b FROM {table})"

    return rf"""WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
hp AS (SELECT page_id, url, html, {host("url")} AS host, {path("url")} AS path FROM p), r AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM hp),
n AS ({address("*", "r", "url", "node")}),
raw AS (SELECT url, host, path, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) AS t FROM n WHERE host <> ''),
ab AS (SELECT url AS src, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*):', 1) || ':' || t
  WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:/?#]*):', 1) || '://' || host || t ELSE regexp_extract(url, '^([^:/?#]*):', 1) || '://' || host || regexp_replace(path, '[^/]*$', '') || t END AS url FROM raw WHERE t <> ''),
lk AS (SELECT * FROM ({address("*", "ab", "url", "dst")}) WHERE {host("url")} <> ''), lr AS (SELECT *, {verdict} AS ruled FROM (SELECT *, {host("url")} AS host, {path("url")} AS path FROM lk)),
nd AS (SELECT url, ruled FROM n WHERE host <> '' UNION ALL SELECT url, ruled FROM lr),
e0 AS (SELECT url AS a, 'address ' || node AS b FROM n WHERE host <> '' UNION SELECT src, url FROM lk UNION SELECT url, 'address ' || dst FROM lk),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
told AS (SELECT reach.a AS url, max(ruled = 'allow') AS allowed, max(ruled = 'block') AS blocked FROM reach JOIN nd ON nd.url = reach.b GROUP BY ALL)
SELECT page_id, n.host, path, rule, coalesce(ruled, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict,
  ruled IS NULL AND coalesce(blocked, false) AND NOT coalesce(allowed, false) AS by_alias FROM n LEFT JOIN told ON told.url = n.url AND n.host <> ''"""


def _quality_rules() -> str:
    names = list(QUALITY_RULES)
    rules = ", ".join(f"({e}) AS {n}" for n, e in QUALITY_RULES.items())
    failed = " OR ".join(names)
    rates = " OR ".join(f"(k_{n} + m_{n} * w_{n}) / (documents + w_{n}) > 0.5" for n in names)
    moments = ", ".join(f"sum(k_{n}) / sum(documents) AS m_{n}, sum(k_{n} * k_{n} / documents) / sum(documents) AS s_{n}" for n in names)
    between = ", ".join(f"s_{n} - m_{n} * m_{n} - m_{n} * (1 - m_{n}) * (hosts - 1) / n AS b_{n}" for n in names)
    weights = ", ".join(f"CASE WHEN b_{n} > 1e-12 AND hosts >= 2 THEN least(1e4, greatest(1.0, m_{n} * (1 - m_{n}) / b_{n} - 1)) ELSE 1e4 END AS w_{n}" for n in names)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
t AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM t) WHERE n > 1),
marked AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS j FROM twice, range(3) r(k)) GROUP BY ALL),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY ALL),
q AS (SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (rid) LEFT JOIN marked USING (rid)),
f AS (SELECT *, {rules} FROM q), h AS (SELECT source, count(*) AS documents, {", ".join(f"sum(CAST({n} AS INT)) AS k_{n}" for n in names)} FROM f GROUP BY ALL),
a AS (SELECT sum(documents) AS n, count(*) AS hosts, {moments} FROM h), v AS (SELECT *, {between} FROM a), p AS (SELECT *, {weights} FROM v),
bad AS (SELECT source, {rates} AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({failed}) AS base_failed, NOT ({failed}) AND NOT host_failed AS kept FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source"""


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || rpad(substr(x, i * 5 // 4 + 1, 2), 2, '0') AS INT) >> (3 - i * 5 % 4)) % 32 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
classes AS (SELECT min(doc_id) AS rep, list(doc_id) AS ids, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
r AS (SELECT rep, n, unnest(g) AS x FROM classes),
o AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM r a JOIN r b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
comp AS (SELECT a AS rep, least(a, min(b)) AS component FROM reach GROUP BY a),
named AS (SELECT unnest(ids) AS doc_id, coalesce(component, rep) AS component_id FROM classes LEFT JOIN comp USING (rep))
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM s LEFT JOIN named USING (doc_id)"""


def _merkle_manifest(levels: int = 6) -> str:
    """Trees of up to 16**levels leaves, a level a step; a tree that is down to one node stays as it is."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(id)), lambda i: CAST(ascii(substr(id, i + 1, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

    def tree(name: str, start: str, key: str) -> list[str]:
        out, at = [], start
        for j in range(levels):
            nodes = f"(SELECT *, count(*) OVER (PARTITION BY {key}) AS width FROM {at})"
            out.append(f"{name}s{j} AS (SELECT a.{key}, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {nodes} a JOIN {at} b ON a.{key} = b.{key} AND a.i // 16 = b.i // 16 WHERE a.width > 1 GROUP BY ALL)")
            out.append(f"{name}{j + 1} AS (SELECT {key}, i // 16 AS i, CASE WHEN min(width) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {nodes} GROUP BY ALL)")
            at = f"{name}{j + 1}"
        return out

    def climb(rows: str, name: str, key: str, index: str) -> str:
        return rows + "".join(f" LEFT JOIN {name}s{j} {name}p{j} ON {name}p{j}.{key} = d.{key} AND {name}p{j}.i = d.{index} // {16**j}" for j in range(levels))

    steps = [f"{name}p{j}" for name in "tg" for j in range(levels)]
    proof = " || ".join(f"coalesce({s}.l || {s}.r, '')" for s in steps)
    folded, ends = [], "start"
    for j, s in enumerate(steps):
        folded.append(f"f{j} AS (SELECT *, CASE WHEN l{j} IS NULL THEN {ends} ELSE sha256(l{j} || {ends} || r{j}) END AS e{j} FROM {f'f{j - 1}' if j else 'm'})")
        ends = f"e{j}"
    sides = ", ".join(f"{s}.l AS l{j}, {s}.r AS r{j}" for j, s in enumerate(steps))
    return f"""WITH c AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, {leaf("text")} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS other FROM documents),
d0 AS (SELECT doc_id, leaf, CASE WHEN id IS NOT NULL AND {crc} % 5 = 0 THEN other ELSE leaf END AS start, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM c),
t0 AS (SELECT g, i, leaf AS h FROM d0), {", ".join(tree("t", "t0", "g"))},
g0 AS (SELECT 0 AS z, g AS i, h FROM t{levels}), {", ".join(tree("g", "g0", "z"))}, d AS (SELECT *, 0 AS z FROM d0),
m AS (SELECT d.doc_id, d.leaf, d.start, d.g, {sides}, sha256({proof}) AS proof_sha256 FROM {climb(climb("d", "t", "g", "i"), "g", "z", "g")}),
{", ".join(folded)}
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, proof_sha256, {ends} AS folded_root, {ends} = r.h AS verified FROM f{len(steps) - 1} f JOIN t{levels} s ON s.g = f.g CROSS JOIN g{levels} r"""


COLLOCATIONS = rf"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase FROM p, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30), c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
cuts AS (SELECT lang, phrase, a, w, m, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y FROM c, (SELECT unnest(range(1, 4)) AS k) WHERE k < m),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, fx.a AS l, fy.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (fx.a + fy.a) AS BIGINT) AS score FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, max(a) AS longer FROM c, (SELECT unnest(range(1, 4)) AS i), (SELECT unnest(range(2, 4)) AS s) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _url_filters(), "op5_quality_rules": _quality_rules(), "op8_warc": WARC, "op9_topk_search": TOP_K, "op10_near_dedup": NEAR_DUPLICATES, "op11_merkle_manifest": _merkle_manifest(), "op12_collocations": COLLOCATIONS}
