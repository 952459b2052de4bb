"""SQL twins of the queries that SQL can express, in DuckDB's dialect.

They say the contracts anew and share only fixed values with the operators.
"""

from __future__ import annotations

from . import centroids, importance, mixing, pii, quality_rules, secret_scan, suffix_dedup
from .spans import NEAR

_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(name: str, pattern: str) -> str:
    """CTE of all matches of a pattern, with the text around and their places."""
    p = _quoted(pattern)
    return f"""{name}_all AS (SELECT doc_id, regexp_extract_all(t, {p}) AS h, string_split_regex(t, {p}) AS p FROM d WHERE regexp_matches(t, {p})),
{name}_each AS (SELECT doc_id, i, h[i] AS hit, p[i] AS before, p[i + 1] AS after FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM {name}_all)),
{name} AS (SELECT doc_id, hit, right(before, {NEAR}) AS before, left(after, {NEAR}) AS after,
  (sum(length(before) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit))::BIGINT AS s,
  (sum(length(before) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM {name}_each)"""

_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "list_max(list_transform(string_split(hit, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 999))) <= 255",
    ),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        """length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND list_sum(list_transform(
  range(1, length(regexp_replace(hit, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1
  THEN substr(reverse(regexp_replace(hit, '[^0-9]', '', 'g')), i, 1)::INT
  ELSE substr('0246813579', substr(reverse(regexp_replace(hit, '[^0-9]', '', 'g')), i, 1)::INT + 1, 1)::INT END)) % 10 = 0""",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
    "iban": (
        pii.IBAN,
        """length(replace(hit, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(
  string_split(substr(replace(hit, ' ', ''), 5) || left(replace(hit, ' ', ''), 4), ''),
  lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)),
  lambda r, c: ((CASE WHEN c > 9 THEN r * 100 ELSE r * 10 END) + c) % 97) = 1""",
    ),
    "ssn": (
        pii.SSN,
        """NOT regexp_matches(right(before, 1), '[0-9-]') AND NOT regexp_matches(left(after, 1), '[0-9-]')
  AND NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$')""",
    ),
}


def _score(kind: str) -> str:
    near = "lower(before || ' ' || after)"
    return (
        f"round({pii.SCORES[kind]} + CASE WHEN regexp_matches({near}, {_quoted(pii.CONTEXT[kind])}) THEN {pii.BONUS} ELSE 0.0 END"
        f" - CASE WHEN regexp_matches({near}, {_quoted(pii.SAMPLE_WORDS)}) THEN {pii.DISCOUNT} ELSE 0.0 END, 2)::DOUBLE"
    )


def personal_data() -> str:
    kinds = [*pii.BASE, *pii.ADDED]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {no} AS no, '{k}' AS kind, s, e, {_score(k)} AS score FROM {k}_m WHERE {_PII[k][1]}"
        for no, k in enumerate(kinds)
    )
    n = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    one = "concat(kind, ':', s, ':', e)"
    return f"""WITH {_DOCS}, {", ".join(_matches(f"{k}_m", _PII[k][0]) for k in kinds)},
x AS (SELECT * FROM ({found}) WHERE no < {len(pii.BASE)} OR score >= {pii.MIN_SCORE})
SELECT doc_id, {n}, sha256(coalesce(string_agg({one}, ',' ORDER BY no, s) FILTER (no < {len(pii.BASE)}), '')) AS base_sha256,
coalesce(string_agg({one}, ',' ORDER BY no, s) FILTER (no >= 0), '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY no, s), '') AS scores
FROM d LEFT JOIN x USING (doc_id) GROUP BY doc_id"""


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_SECRETS = {
    "assign": (
        rf"(?i:password|passwd|secret|token|api_?key){_VALUE}[A-Za-z0-9+/_.=-]+",
        "length(regexp_extract(hit, {}, 1)) >= 12".format(
            _quoted(rf"^(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)$")
        ),
    ),
    "access": ("AKIA[A-Z0-9]+", "length(hit) >= 18"),
    "hex": ("[0-9a-f]+", "length(hit) >= 16"),
    "id": (
        rf"(?i:user(?:name)?|login|account|client_?id|access_?id){_VALUE}[A-Za-z0-9@._-]{{3,}}",
        "true",
    ),
    "key": (
        "[A-Za-z0-9+/_=-]+",
        "length(hit) >= 24 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')",
    ),
    "endpoint": (secret_scan.ENDPOINT, "true"),
}


def secrets() -> str:
    kinds = [*secret_scan.BASE, *secret_scan.WEAK]
    base = len(secret_scan.BASE)
    found = " UNION ALL ".join(
        f"SELECT doc_id, {no} AS no, '{k}' AS kind, s, e FROM {k}_m WHERE {_SECRETS[k][1]}" for no, k in enumerate(kinds)
    )
    n = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    one = "concat(kind, ':', s, ':', e)"
    scope = secret_scan.SCOPE
    return f"""WITH {_DOCS}, {", ".join(_matches(f"{k}_m", _SECRETS[k][0]) for k in kinds)}, x AS ({found}),
y AS (SELECT * FROM x WHERE no < {base} OR EXISTS (SELECT 1 FROM x o WHERE o.doc_id = x.doc_id
  AND (x.kind = 'key') = (o.kind NOT IN ('assign', 'hex', 'key')) AND o.s <= x.e + {scope} AND x.s <= o.e + {scope}))
SELECT doc_id, {n}, sha256(coalesce(string_agg({one}, ',' ORDER BY s, no) FILTER (no < {base}), '')) AS base_sha256,
coalesce(string_agg({one}, ',' ORDER BY s, no) FILTER (no >= 0), '') AS spans FROM d LEFT JOIN y USING (doc_id) GROUP BY doc_id"""


def mixing_targets() -> str:
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))), 1, {mixing.DIGITS}))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS w FROM r GROUP BY source),
o AS (SELECT *, row_number() OVER b AS place, {mixing.MAX_PASSES} * source_size AS most,
  (sum(source_size) OVER () - coalesce(sum({mixing.MAX_PASSES} * source_size) OVER b, 0))::DOUBLE
  / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM s
  WINDOW b AS (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, place) FILTER (w * level <= most) AS level FROM o),
g AS (SELECT source, source_size, least(w * l.level, most::DOUBLE) AS target FROM o, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
q AS (SELECT *, target - passes * source_size AS budget FROM p),
t AS (SELECT source, h, sum(size) AS inside, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS running FROM r GROUP BY source, h),
u AS (SELECT t.source, h, budget > 0 AND running - inside < budget
  AND (running < budget OR 2 * (budget - (running - inside)) > inside) AS more FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source)
SELECT r.doc_id, r.size::BIGINT AS size, q.source_size, q.target, ((q.passes + u.more::INT) * r.size)::BIGINT AS taken,
(q.passes + u.more::INT)::BIGINT AS copies
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source JOIN u ON r.source IS NOT DISTINCT FROM u.source AND r.h = u.h"""


def quality() -> str:
    word = "'[^\\x20\\x09-\\x0D]+'"
    classes = {"lower": "a-z", "symbol": "#*$%&|<>", "upper": "A-Z", "digit": "0-9"}
    counted = ", ".join(f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g')) AS c_{n}" for n, c in classes.items())
    bins = quality_rules.BINS
    in_bins = ", ".join(f"len(list_filter(lw, lambda x: x = '{b}'))::DOUBLE" for b in bins)

    def js(p: str, q: str) -> str:
        part = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        each = part.format(a=f"{p}[i]", b=f"{q}[i]") + " + " + part.format(a=f"{q}[i]", b=f"{p}[i]")
        return f"CASE WHEN len({p}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {each})) / 2, 0.0)) END"

    def mean(name: str, size: int) -> str:
        return "[" + ", ".join(f"avg({name}[{i + 1}])" for i in range(size)) + "]"

    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, {word}) AS w, regexp_extract_all(lower(t), {word}) AS lw, {counted},
  length(t) - length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) AS c_ascii,
  length(t) - length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS c_space,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
b AS (SELECT *, len(w) AS n, length(t) - c_space AS word_chars,
  [c_lower, c_symbol, c_upper, c_digit, c_ascii - c_space - c_lower - c_symbol - c_upper - c_digit, length(t) - c_ascii]::DOUBLE[] AS cc,
  [{in_bins}] AS wc FROM a),
c AS (SELECT *, list_append(wc, n::DOUBLE - list_sum(wc)) AS wr FROM b),
e AS (SELECT *, CASE WHEN word_chars >= {quality_rules.CHARS_GUARD} THEN list_transform(cc, lambda x: x / list_sum(cc)) END AS ps,
  CASE WHEN n >= {quality_rules.COMMON_GUARD} THEN list_transform(wr, lambda x: x / list_sum(wr)) END AS pw FROM c),
m AS (SELECT lang, {mean("ps", 6)} AS ms, {mean("pw", len(bins) + 1)} AS mw FROM e GROUP BY lang),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {quality_rules.WINDOW - 1}], ' ') AS five FROM
  (SELECT doc_id, w, unnest(range(1, n - {quality_rules.WINDOW - 2})) AS i FROM e)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
k AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM h, range({quality_rules.WINDOW}) AS o(j) GROUP BY doc_id),
f AS (SELECT e.*, coalesce(n_repeat, 0) AS n_repeat, {js("ps", "ms")} AS ds, {js("pw", "mw")} AS dw
  FROM e LEFT JOIN k USING (doc_id) JOIN m ON e.lang IS NOT DISTINCT FROM m.lang),
v AS (SELECT *, n < {quality_rules.MIN_WORDS} OR 100 * n_repeat > {quality_rules.MAX_REPEAT_PERCENT} * n AS base_failed FROM f)
SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols,
(len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words, base_failed,
NOT base_failed AND coalesce(ds, 0) <= {quality_rules.CHARS_LIMIT} AND coalesce(dw, 0) <= {quality_rules.COMMON_LIMIT} AS kept,
round(ds, 4) AS chars_distance, round(dw, 4) AS common_distance FROM v"""


EXACT = """WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
row_number() OVER w = 1 AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""

def clusters() -> str:
    dims, k, rounds = centroids.DIMENSIONS, centroids.CENTROIDS, centroids.ROUNDS
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c}}) AS m
  FROM v, c{r} GROUP BY r)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT m.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (r), range(1, {dims + 1}) AS z(i) GROUP BY m.c, i),
n{r} AS (SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(n{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN n{r} USING (c))""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM
  (SELECT x, sha256('{centroids.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, x LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, m.c::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
(sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} f ON m.c = f.c"""


def drawn() -> str:
    n = importance.BUCKETS
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

    def words(table: str, key: str) -> str:
        return f"SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), {word}) AS w FROM {table}"

    def runs(table: str) -> str:
        return f"""SELECT k, unnest(w) AS f FROM {table}
  UNION ALL SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM {table} WHERE len(w) > 1"""

    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"""WITH RECURSIVE r AS (SELECT b, b::BIGINT AS c, 0 AS i FROM range(256) AS z(b) UNION ALL SELECT b, {step}, i + 1 FROM r WHERE i < 8),
tab AS (SELECT list(c ORDER BY b) AS z FROM r WHERE i = 8),
d AS ({words("documents", "doc_id")}), q AS ({words("benchmark", "item_id")}),
fd AS ({runs("d")}), fq AS ({runs("q")}),
u AS (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fq)),
x AS (SELECT f, hex(encode(f)) AS h FROM u),
c AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
  lambda v, b: xor(v // 256, z[(xor(v % 256, b)) + 1])), 4294967295) % {n} AS b FROM x, tab),
nd AS (SELECT b, count(*) AS s FROM fd JOIN c USING (f) GROUP BY b), nq AS (SELECT b, count(*) AS t FROM fq JOIN c USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM nd) + {n})::DOUBLE
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM nq) + {n})::DOUBLE)))::BIGINT AS gain
  FROM range({n}) AS z(b) LEFT JOIN nd USING (b) LEFT JOIN nq USING (b)),
m AS (SELECT k, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM fd JOIN c USING (f) JOIN g USING (b) GROUP BY k),
e AS (SELECT d.k AS doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || left(sha256('{importance.SEED}:' || coalesce(d.k::VARCHAR, '')), 8))::BIGINT AS h FROM d LEFT JOIN m USING (k)),
o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_words >= {importance.MIN_WORDS}
  QUALIFY rank <= {importance.PERCENT} * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM o LEFT JOIN p USING (doc_id)"""


def repeats() -> str:
    n = suffix_dedup.DEPTH
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * n})) AS m FROM (SELECT r, h, unnest(range(len(h) // 2 - {n - 1})) AS i FROM d)),
o AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
s AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + {n}, -1) AS is_first FROM o),
g AS (SELECT r, i, sum(is_first::INT) OVER (PARTITION BY r ORDER BY i) AS no FROM s),
x AS (SELECT r, no, min(i) AS a, max(i) + {n} AS b FROM g GROUP BY r, no),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM x),
k AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


SQL = {
    "op1_pii": personal_data(),
    "op2_secret_scan": secrets(),
    "op4_mixing": mixing_targets(),
    "op6_quality_rules": quality(),
    "op8_exact_dedup": EXACT,
    "op11_centroids": clusters(),
    "op12_importance": drawn(),
    "op13_suffix_dedup": repeats(),
}
