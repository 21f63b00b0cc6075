"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from corpusprep.llm import quality as q


def _s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORD = _s("[^\\x20\\x09-\\x0D]")
_OUT = "regexp_replace({x}, {p}, '', 'g')"


def _count(x: str, outside: str) -> str:
    return f"length({_OUT.format(x=x, p=_s(outside))})"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, [x for x in string_split_regex(t, {_s(q.SPACE + "+")}) if x <> ''] AS w FROM d),
windows AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s
            FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(8)) AS k FROM twice) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
coded AS (SELECT rid, x, length(x) AS n, regexp_matches(x, {_WORD}) AS filled,
    CASE WHEN NOT regexp_matches(x, {_WORD}) THEN {q.BLANK}
         WHEN regexp_matches(x, {_s(q.NAVIGATION)}) OR regexp_matches(x, {_s(q.TRAIL.replace("}+", "}"))}) THEN {q.NAV}
         WHEN length(x) > 4 AND ({_count("x", f"[^{q.SYMBOLS}{{}}]+")} * 20 > length(x) OR {_count("x", "[^!?]+")} * 12 > length(x) + 24) THEN {q.SYMBOL}
         WHEN length(x) <= 300 AND regexp_matches(x, {_s(q.BOILERPLATE)}) THEN {q.BOILER}
         WHEN NOT (regexp_matches(x, {_s(q.ENDS)}) OR (regexp_matches(x, {_s(q.LONG_PROSE)}) AND regexp_matches(x, {_s(q.INNER)}))) THEN {q.UNFINISHED}
         ELSE {q.KEPT} END AS code FROM lines),
by_doc AS (SELECT rid, count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE filled) - count(DISTINCT CASE WHEN filled THEN x END) AS n_dup,
    {", ".join(f"count(*) FILTER (WHERE code = {k}) AS lost_{name}" for name, k in q.RULES.items())},
    coalesce(sum(n) FILTER (WHERE filled), 0) AS chars, coalesce(sum(n) FILTER (WHERE code = {q.KEPT}), 0) AS rest,
    coalesce(sum(n + 1) FILTER (WHERE code IN ({q.BLANK}, {q.KEPT})) - 1, 0) AS clean_chars FROM coded GROUP BY rid),
stats AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({_count("t", q.SPACE + "+")} AS BIGINT) AS word_chars,
    CAST({_count("t", f"[^{q.SYMBOLS}]+")} AS BIGINT) AS n_symbols, CAST(n_dup AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, b.*
    FROM d JOIN words USING (rid) JOIN by_doc b USING (rid) LEFT JOIN repeated r USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (chars > 0 AND 1 - rest / chars > 0.5) AS kept, CAST(n_lines AS BIGINT) AS n_lines,
    {", ".join(f"CAST(lost_{name} AS BIGINT) AS lost_{name}" for name in q.RULES)}, CAST(clean_chars AS BIGINT) AS clean_chars
FROM judged"""

OP4 = """
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
    [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
each AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(g) AS x FROM s WHERE doc_id IS NOT NULL),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
way AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM way UNION SELECT r.a, w.b FROM reach r JOIN way w ON r.b = w.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, least(s.doc_id, m.c) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id"""

#: CRC-32 in SQL: eight steps a byte over the list of a text's bytes.
_HEX = "instr('0123456789abcdef', substr({h}, {i}, 1)) - 1"
_BYTE = f"({_HEX.format(h='lower(hex(encode(f)))', i='2 * i - 1')}) * 16 + {_HEX.format(h='lower(hex(encode(f)))', i='2 * i')}"
_CRC = (f"xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, octet_length(encode(f)) + 1), "
        f"lambda i: [({_BYTE})::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
        "lambda c, x: xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1))), 4294967295::UBIGINT)")


def _features(table: str, key: str) -> str:
    return f"""SELECT rid, {key} AS id, w, list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS fs
        FROM (SELECT row_number() OVER () AS rid, {key}, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> ''] AS w FROM {table})"""


OP11 = f"""
WITH d AS MATERIALIZED ({_features("documents", "doc_id")}),
b AS MATERIALIZED ({_features("benchmark", "item_id")}),
df AS MATERIALIZED (SELECT rid, unnest(fs) AS f FROM d),
bf AS MATERIALIZED (SELECT unnest(fs) AS f FROM b),
hashed AS MATERIALIZED (SELECT f, CAST({_CRC} % 10000 AS BIGINT) AS k FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT k, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY k),
gain AS MATERIALIZED (SELECT x.k, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM df) + 10000) AS DOUBLE)
    / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bf) + 10000) AS DOUBLE))) AS BIGINT) AS g
    FROM (SELECT DISTINCT k FROM hashed) x LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
weighed AS (SELECT rid, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (k) GROUP BY rid),
scored AS MATERIALIZED (SELECT d.id AS doc_id, len(d.w) AS n_words, CAST(len(d.fs) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    list_reduce(list_transform(range(1, 9), lambda i: CAST({_HEX.format(h="sha256('7:' || coalesce(CAST(d.id AS VARCHAR), ''))", i='i')} AS BIGINT)),
                lambda a, x: a * 16 + x) AS h
    FROM d LEFT JOIN weighed USING (rid)),
drawn AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r FROM drawn)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_words >= 20 AND r <= (SELECT 25 * count(*) // 100 FROM drawn WHERE n_words >= 20) THEN r END AS rank FROM ranked"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p),
r AS (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first END AS refers_to FROM r"""

OP13 = """
WITH u AS (SELECT vec_id, min(struct_pack(y := CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT),
                                          v := list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))))) AS r
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
e AS MATERIALIZED (SELECT vec_id, r.y AS y, r.v AS v, len(r.v) AS n FROM u),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.y = b.y AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.n = b.n AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
q AS (SELECT p.a, p.b, p.score AS ps, s.b AS c, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(r AS INTEGER) AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score FROM q WHERE r <= 3"""
