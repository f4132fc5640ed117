"""The secret scan as SQL: base spans, battery, evidence and cutoff, for the oracle."""

from __future__ import annotations

from answerscope.llm.common import LAST_ID
from answerscope.llm.secrets import ACCESS, ASSIGN, CANDIDATE, ENCODINGS, FDR, HEX, KINDS, LEAST, MOST, PRIOR, REJECT, SCALE, SYMBOLS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(pattern: str, rank: int, least: int = 0) -> str:
    """(doc_id, spans) with spans a list of {start, rank, end, value} in code points."""
    p = _quoted(pattern)
    value = f"regexp_extract_all(text, {p}, 2)" if least else "h"
    length = "list_transform({0}, lambda x: length(x))"
    before = f"CAST(list_sum({length.format('g[:i]')}) + coalesce(list_sum({length.format('h[:i - 1]')}), 0) AS BIGINT)"
    return f"""
SELECT doc_id, list_filter(list_transform(range(1, len(h) + 1), lambda i: {{
         'start': {before}, 'rank': {rank}, 'end': {before} + length(h[i]), 'value': v[i]}}), lambda s: length(s.value) >= {least}) AS spans
FROM (SELECT *, {value} AS v FROM (SELECT doc_id, text, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}, 0) AS h FROM texts))"""


def _upper_tail(z: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({z}) / sqrt(2)))"
    series = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    half = f"({series} * exp(-({z}) * ({z}) / 2) / 2)"
    return f"(CASE WHEN ({z}) >= 0 THEN {half} ELSE 1 - {half} END)"


def _case(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


_ENC = _case([(f"translate(value, {_quoted(a)}, '') = ''", _quoted(n)) for n, a in ENCODINGS.items()], "NULL")
_ALPHABET = _case([(f"enc = {_quoted(n)}", _quoted(a)) for n, a in ENCODINGS.items()], "NULL")
_SIZE = len(SYMBOLS) + 1
_LOW, _HIGH = "ceil(c * size / cells)", "ceil((c + 1) * size / cells)"
_PAIRS = "list_transform(range(1, len(vals)), lambda i: {0})"

SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT doc_id, list_sort(flatten(list(list_transform(spans, lambda s: {{'start': s.start, 'rank': s.rank, 'end': s.end}})))) AS base
         FROM ({_spans(ASSIGN, 0, 6)} UNION ALL {_spans(ACCESS, 1)} UNION ALL {_spans(HEX, 2)}) GROUP BY doc_id),
runs AS (SELECT doc_id, unnest(spans) AS s FROM ({_spans(CANDIDATE, 3)})),
free AS (SELECT r.doc_id, s.start AS a, s.end AS z, s.value AS value FROM runs r JOIN base b USING (doc_id)
         WHERE len(list_filter(base, lambda x: x.start < s.end AND s.start < x.end)) = 0),
coded AS (SELECT *, {_ALPHABET} AS alphabet FROM (SELECT *, {_ENC} AS enc FROM free) WHERE enc IS NOT NULL),
vals AS (SELECT *, length(value)::DOUBLE AS n, length(alphabet)::DOUBLE AS size,
                list_transform(string_split(value, ''), lambda c: strpos({_quoted(SYMBOLS)}, c)) AS places,
                list_transform(string_split(value, ''), lambda c: (strpos(alphabet, c) - 1)::DOUBLE) AS vals FROM coded),
cut AS (SELECT *, greatest(2, least(size, floor(n / 5))) AS cells, list_sum(list_transform(vals, lambda v: (v >= size / 2)::INT))::DOUBLE AS up, list_sum(vals) / n AS centre FROM vals),
stats AS (SELECT *, list_sum(list_transform(range(0, cells::INT), lambda c: len(list_filter(vals, lambda v: v >= {_LOW} AND v < {_HIGH})) ** 2 * size / (n * ({_HIGH} - {_LOW})))) - n AS chi,
                 1 + list_sum({_PAIRS.format('abs((vals[i + 1] >= size / 2)::INT - (vals[i] >= size / 2)::INT)')}) AS turned,
                 2 * up * (n - up) / n + 1 AS mean, list_sum(list_transform(vals, lambda v: (v - centre) * (v - centre))) AS square,
                 list_sum({_PAIRS.format('(vals[i + 1] - centre) * (vals[i] - centre)')}) AS lagged FROM cut),
spread AS (SELECT *, 2.0::DOUBLE / (9 * (cells - 1)) AS w, (mean - 1) * (mean - 2) / (n - 1) AS var FROM stats),
p AS (SELECT *, {_upper_tail('(cbrt(chi / (cells - 1)) - (1 - w)) / sqrt(w)')} AS uniform,
             CASE WHEN var > 0 THEN 2 * {_upper_tail('abs(turned - mean) / sqrt(var)')} ELSE 0 END AS runs,
             CASE WHEN square > 0 THEN 2 * {_upper_tail('abs(lagged / square + 1 / n) * sqrt(n)')} ELSE 0 END AS serial FROM spread),
words AS (SELECT word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM texts)
          WHERE length(word) < {LEAST} GROUP BY word HAVING min(coalesce(doc_id, {LAST_ID})) < max(coalesce(doc_id, {LAST_ID}))),
pairs AS (SELECT strpos({_quoted(SYMBOLS)}, word[i]) AS a, strpos({_quoted(SYMBOLS)}, word[i + 1]) AS b, count(*) AS n
          FROM (SELECT word, unnest(range(1, length(word))) AS i FROM words) GROUP BY ALL
          UNION ALL SELECT 0, strpos({_quoted(SYMBOLS)}, word[1]) AS b, count(*) FROM words GROUP BY b
          UNION ALL SELECT strpos({_quoted(SYMBOLS)}, word[-1]) AS a, 0, count(*) FROM words GROUP BY a),
grid AS (SELECT g.a, g.b, coalesce(n, 0) AS n FROM (SELECT i // {_SIZE} AS a, i % {_SIZE} AS b FROM range({_SIZE * _SIZE}) t(i)) g LEFT JOIN pairs p ON g.a = p.a AND g.b = p.b),
odds AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS before, (sum(n) OVER (PARTITION BY b) + 1)::DOUBLE / (sum(n) OVER () + {_SIZE}) AS single FROM grid),
costs AS (SELECT list(CAST(floor(-{SCALE} * log2((n + {PRIOR} * single) / (before + {PRIOR}))) AS BIGINT) + (CASE WHEN b = 0 THEN {2 * SCALE} ELSE 0 END) ORDER BY a, b) AS cost FROM odds),
weighed AS (SELECT doc_id, a, z, value, CASE WHEN 1 - (1 - least(uniform, runs, serial)) ** 3 < {REJECT} THEN 0 ELSE greatest(0, least({MOST}, CAST(floor(
              (list_sum(list_transform(range(1, len(places) + 1), lambda i: cost[(CASE WHEN i = 1 THEN 0 ELSE places[i - 1] END) * {_SIZE} + places[i] + 1]))
               - n * ceil({SCALE} * log2(size))) / {SCALE}) AS INT) - 3)) END AS bits FROM p, costs),
hist AS (SELECT bits, count(*) AS k FROM (SELECT DISTINCT value, bits FROM weighed) GROUP BY 1),
told AS (SELECT b, (SELECT sum(k) FROM hist WHERE bits >= b) AS told, (SELECT sum(k) FROM hist) AS m FROM range(1, {MOST + 1}) t(b)),
cutoff AS (SELECT min(b) AS lowest FROM told WHERE told * power(2.0::DOUBLE, b) * {FDR}::DOUBLE >= m),
added AS (SELECT doc_id, list({{'start': a, 'rank': 3, 'end': z}}) AS added FROM weighed, cutoff WHERE bits >= lowest GROUP BY 1),
named AS (SELECT doc_id, base, list_sort(base || coalesce(added, [])) AS spans FROM base LEFT JOIN added USING (doc_id))
SELECT doc_id, {", ".join(f"len(list_filter(base, lambda s: s.rank = {r})) AS n_{k}" for r, k in enumerate(KINDS[:3]))},
       sha256(array_to_string(list_transform(base, lambda s: {KINDS[:3]!r}[s.rank + 1] || ':' || s.start || ':' || s.end), ',')) AS base_sha256,
       array_to_string(list_transform(spans, lambda s: {KINDS!r}[s.rank + 1] || ':' || s.start || ':' || s.end), ',') AS spans
FROM named"""
SQL = SQL.replace(repr(KINDS[:3]), repr(list(KINDS[:3]))).replace(repr(KINDS), repr(list(KINDS)))
