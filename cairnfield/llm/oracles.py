"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality, urlfilter

W = r"[^\x20\x09-\x0D]+"


def op1() -> str:
    low = "(CASE WHEN bucket < 64 THEN bucket ELSE (bucket - 32 * (bucket // 32 - 1)) << (bucket // 32 - 1) END)"
    judged = list(quality.STEPS)
    quartile = lambda k, part: f"CAST(MIN(v) FILTER (WHERE measure = '{k}' AND 4 * upto >= {part} * total) AS DOUBLE)"
    spread = lambda k: f"({quality.SPREADS} * GREATEST(q3_{k} - q1_{k}, {quality.STEPS[k][0]}.0 / GREATEST(q2_{quality.STEPS[k][1]}, 1.0)))"

    def fence(source: str, keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        q = ", ".join(f"{quartile(k, n)} AS q{n}_{k}" for k, n in [(k, n) for k in judged for n in (1, 3)] + [("words", 2), ("lines", 2)])
        sides = ", ".join(f"q3_{k} + {spread(k)} AS upper_{k}, q1_{k} - {spread(k)} AS lower_{k}, q3_{k} + 2 * {spread(k)} AS outer_upper_{k}, q1_{k} - 2 * {spread(k)} AS outer_lower_{k}" for k in judged)
        return f"""SELECT {keys + ", " if keys else ""}total, {sides} FROM (SELECT {keys + ", " if keys else ""}CAST(MAX(total) AS DOUBLE) AS total, {q}
  FROM (SELECT *, {low} AS v, SUM(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, SUM(n) OVER (PARTITION BY {by}) AS total FROM ({source})) {f"GROUP BY {keys}" if keys else "HAVING COUNT(*) > 0"})"""

    pull = lambda side, k, most: f"{most}((n.total * n.{side}_{k} + {quality.PRIOR} * f.{side}_{k}) / (n.total + {quality.PRIOR}), f.outer_{side}_{k}) AS {side}_{k}"
    pulled = ", ".join(pull("upper", k, "LEAST") + ", " + pull("lower", k, "GREATEST") for k in judged)
    outer = ", ".join(f"n.outer_{side}_{k}" for k in judged for side in ("upper", "lower"))
    why = " ".join(f"WHEN {k} > upper_{k} THEN '{k}'" + (f" WHEN {k} < lower_{k} THEN '{k}'" if k == "length" else "") for k in judged)
    return rf"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(text, '') AS text, COALESCE('=' || lang, '') AS lk, COALESCE('=' || source, '') AS sk FROM documents),
ws AS (SELECT rid, REGEXP_EXTRACT_ALL(text, '{W}') AS ws FROM d),
flat AS (SELECT rid, UNNEST(ws) AS w, GENERATE_SUBSCRIPTS(ws, 1) AS i FROM ws),
tri AS (SELECT rid, i, w || ' ' || LEAD(w, 1) OVER p || ' ' || LEAD(w, 2) OVER p AS t FROM flat WINDOW p AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, t) AS n FROM tri WHERE t IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, COUNT(DISTINCT i + k) AS n FROM again CROSS JOIN (SELECT UNNEST([0, 1, 2]) AS k) GROUP BY rid),
lin AS (SELECT rid, COUNT(*) AS n, COUNT(DISTINCT l) AS u FROM (SELECT rid, UNNEST(STR_SPLIT(text, CHR(10))) AS l FROM d) WHERE REGEXP_MATCHES(l, '{W}') GROUP BY rid),
cnt AS (SELECT rid, COUNT(*) AS n, SUM(LENGTH(w)) AS c FROM flat GROUP BY rid),
f AS (SELECT d.rid, doc_id, lk, sk, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n_words, CAST(COALESCE(cnt.c, 0) AS BIGINT) AS word_chars, CAST(LENGTH(REGEXP_REPLACE(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(COALESCE(lin.n - lin.u, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(COALESCE(lin.n, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN cnt USING (rid) LEFT JOIN lin USING (rid) LEFT JOIN rep USING (rid)),
m AS (SELECT *, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS symbol,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS dup, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeat, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words END AS length, n_words AS words, n_lines AS lines FROM f),
v AS (SELECT lk, sk, measure, value FROM m UNPIVOT (value FOR measure IN (symbol, dup, repeat, length, words, lines)) WHERE NOT base_failed),
s AS (SELECT lk, sk, measure, (value >> GREATEST(LENGTH(BIN(value)) - 6, 0)) + 32 * GREATEST(LENGTH(BIN(value)) - 6, 0) AS bucket, COUNT(*) AS n FROM v GROUP BY ALL),
f0 AS ({fence("SELECT measure, bucket, SUM(n) AS n FROM s GROUP BY ALL", "")}),
l0 AS ({fence("SELECT lk, measure, bucket, SUM(n) AS n FROM s GROUP BY ALL", "lk")}),
l1 AS (SELECT n.lk, {pulled}, {outer} FROM l0 n CROSS JOIN f0 f),
g0 AS ({fence("SELECT * FROM s", "lk, sk")}),
g1 AS (SELECT n.lk, n.sk, {pulled} FROM g0 n JOIN l1 f ON f.lk = n.lk),
j AS (SELECT m.*, CASE {why} END AS why FROM m LEFT JOIN g1 ON g1.lk = m.lk AND g1.sk = m.sk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN 'base' ELSE why END AS rejected_by, (NOT base_failed AND why IS NULL) AS kept FROM j"""


def op3() -> str:
    term = lambda t: f"CAST(REGEXP_MATCHES(s, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)"
    fits = lambda h, p: f"((host = '{h}' OR SUFFIX(host, '.{h}')) AND PREFIX(path, '{p}'))"
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[0] + r[1]))
    return rf"""
WITH u AS (SELECT page_id, TRANSLATE(COALESCE(REGEXP_EXTRACT(url, '://([^/?#]*)', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, COALESCE(REGEXP_EXTRACT(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
s AS (SELECT *, host || LOWER(path) AS s FROM u),
n AS (SELECT *, {" + ".join(map(term, urlfilter.STRICT))} AS n_strict, {" + ".join(map(term, urlfilter.SOFT))} AS n_soft,
  CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)} END AS rule, CASE {" ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)} END AS ruled FROM s)
SELECT page_id, host, path, rule, COALESCE(ruled, CASE WHEN {urlfilter.LIMIT} * n_strict + n_soft >= {urlfilter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM n"""


def op6() -> str:
    one, most = mixing.ONE, mixing.MAX_COPIES
    up = lambda rest: f"CAST({rest} + u >= {one} AS BIGINT)"
    shift = "GREATEST(LENGTH(BIN(size)) - 4, 0)"
    return rf"""
WITH d AS (SELECT doc_id, source, COALESCE('=' || source, '') AS key, CAST(COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '{W}')), 0) AS BIGINT) AS size, MD5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
s0 AS (SELECT source, key, CAST(SUM(size) AS BIGINT) AS source_size, (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS weight FROM d GROUP BY source, key),
s1 AS (SELECT *, CAST({most} * source_size AS DOUBLE) / weight AS room FROM s0),
s2 AS (SELECT *, CAST(SUM(source_size) OVER () - SUM({most} * source_size) OVER r + {most} * source_size AS DOUBLE) / (SUM(weight) OVER () - SUM(weight) OVER r + weight) AS share FROM s1
  WINDOW r AS (ORDER BY room, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT share AS level FROM s2 WHERE share <= room ORDER BY room, share DESC LIMIT 1),
t AS (SELECT key, source_size, LEAST(CAST({most} * source_size AS DOUBLE), level * weight) AS target FROM s2 CROSS JOIN lv),
tr AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN FLOOR(target / source_size * {one}) ELSE 0 END AS HUGEINT) AS rate, CAST('0x' || SUBSTR(MD5('{mixing.SEED}:' || key), 1, 10) AS BIGINT) AS u FROM t),
i AS (SELECT d.*, source_size, target, rate, u, ROW_NUMBER() OVER (PARTITION BY d.key ORDER BY (size >> {shift}) + 8 * {shift}, hash, doc_id, size) AS i FROM d JOIN tr USING (key)),
c AS (SELECT *, i * rate // {one} AS w1, i * rate % {one} AS r1, (i - 1) * rate // {one} AS w0, (i - 1) * rate % {one} AS r0 FROM i)
SELECT doc_id, size, source_size, target, CAST(size * (w1 - w0 + {up('r1')} - {up('r0')}) AS BIGINT) AS taken FROM c"""


OP7 = """
WITH p AS (SELECT page_id, CAST(STRLEN(COALESCE(html, '')) AS BIGINT) AS n, SHA256(COALESCE(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN MIN(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


ORACLES = {"op1_quality": op1(), "op3_urlfilter": op3(), "op6_mixing": op6(), "op7_warc": OP7}
