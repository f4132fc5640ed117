"""Building blocks of the oracle SQL."""

from __future__ import annotations

from answerscope.functions.stemming import IRREGULAR, STEP2, STEP3, STEP4

BIG = 1_000_000


def log_det_ctes(pooled: str, key: str, ridge: float = 0.001, centre: str = "row", log: str = "log10") -> str:
    """CTEs ending in ``det(key, k, ld)`` from a SELECT giving (key, gen_id, vec).

    ``centre='row'`` subtracts each vector's own mean (covariance between generations),
    ``'column'`` each dimension's mean (the K-sized Gram matrix of the covariance between
    dimensions). The determinant is a recursive elimination on a list of rows.
    """
    if centre == "row":
        centred = f"""
cent AS (SELECT {key}, gen_id, list_transform(vec, lambda x: x - mu) AS c, len(vec) - 1 AS dof
         FROM (SELECT {key}, gen_id, vec, list_avg(vec) AS mu FROM pooled))"""
    else:
        centred = f"""
dims AS (SELECT {key}, gen_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM pooled),
cent AS (SELECT {key}, gen_id, list(x - mu ORDER BY d) AS c, any_value(n) - 1 AS dof
         FROM (SELECT *, avg(x) OVER (PARTITION BY {key}, d) AS mu, count(*) OVER (PARTITION BY {key}, d) AS n FROM dims)
         GROUP BY {key}, gen_id)"""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in key.split(","))
    return f"""
pooled AS ({pooled}),{centred},
cov AS (SELECT {ak}, a.gen_id AS i, b.gen_id AS j,
               list_dot_product(a.c, b.c) / a.dof + CASE WHEN a.gen_id = b.gen_id THEN {ridge}::DOUBLE ELSE 0 END AS v
        FROM cent a JOIN cent b ON {on}),
rws AS (SELECT {key}, i, list(v ORDER BY j) AS r FROM cov GROUP BY {key}, i),
mats AS (SELECT {key}, list(r ORDER BY i) AS m, CAST(count(*) AS INT) AS k FROM rws GROUP BY {key}),
elim AS (SELECT {key}, k, m, 0::DOUBLE AS ld FROM mats
         UNION ALL
         SELECT {key}, k, list_transform(m[2:], lambda r: list_transform(r[2:], lambda x, q: x - r[1] * m[1][q + 1] / m[1][1])),
                ld + {log}(m[1][1]) FROM elim WHERE len(m) > 0),
det AS (SELECT {key}, k, ld FROM elim WHERE len(m) = 0)"""


TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"


def tokens(col: str) -> str:
    return TOKENS.format(col)


def lcs(a: str, b: str) -> str:
    """LCS length of two token lists by thresholds: entry k is the smallest prefix of ``b``
    that holds a common subsequence of length k with the tokens of ``a`` read so far."""
    places = f"list_transform({a}, lambda x: list_filter(range(1, len({b}) + 1), lambda p: {b}[p] = x))"
    return f"""len(list_reduce(list_prepend([0::BIGINT], list_transform({places}, lambda q: list_transform(q, lambda v: v::BIGINT))),
  lambda th, ps: list_filter(list_transform(range(1, len(th) + 2), lambda k:
      CASE WHEN k = 1 THEN 0 ELSE least(coalesce(th[k], {BIG}),
        coalesce(list_min(list_filter(ps, lambda p: p > th[k - 1])), {BIG})) END), lambda v: v < {BIG}))) - 1"""


def f_measure(common: str, na: str, nb: str) -> str:
    p, r = f"({common} / ({na})::DOUBLE)", f"({common} / ({nb})::DOUBLE)"
    return f"CASE WHEN {common} = 0 OR {na} = 0 OR {nb} = 0 THEN 0::DOUBLE ELSE 2 * {p} * {r} / ({p} + {r}) END"


def _shape(w: str) -> str:
    """A word as c (consonant) and v (vowel); y is a vowel after a consonant. Runs of up to 9 y."""
    out = f"regexp_replace(regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[^yV]', 'c', 'g'), 'V', 'v', 'g')"
    out = f"regexp_replace({out}, '^y', 'c')"
    for _ in range(4):
        out = f"regexp_replace(regexp_replace({out}, 'cy', 'cv', 'g'), 'vy', 'vc', 'g')"
    return out


def stem_ctes(tokens_sql: str) -> str:
    """CTEs ending in ``stems(token, stem)`` from a SELECT of distinct lower-case tokens.

    The Porter steps as one CTE each over (token, w, s): the word so far and its shape. The shape
    of a prefix is the prefix of the shape, so a suffix's measure needs no new shape.
    """
    cut = lambda n: f"left(w, length(w) - {n})"
    measure = lambda n: f"len(regexp_extract_all(left(s, length(w) - {n}), 'v+c+'))"
    cvc = lambda w, s: f"CASE WHEN length({w}) = 2 THEN {s} = 'vc' ELSE right({s}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y') END"

    def table(rules) -> str:
        return "CASE " + " ".join(
            f"WHEN w LIKE '%{a}' THEN CASE WHEN {measure(len(a))} > 0 THEN {cut(len(a))} || '{b}' ELSE w END" for a, b in rules
        ) + " ELSE w END"

    def step(name: str, source: str, value: str) -> str:
        return f"{name} AS (SELECT token, w, {_shape('w')} AS s FROM (SELECT token, {value} AS w FROM {source}))"

    short = f"CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END"
    plural = f"CASE WHEN w LIKE '%ies' THEN {short} WHEN w LIKE '%sses' THEN {cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut(1)} ELSE w END"
    rest = f"""CASE WHEN w LIKE '%ied' OR w LIKE '%eed' THEN NULL
  WHEN w LIKE '%ed' AND contains(left(s, length(w) - 2), 'v') THEN {cut(2)} WHEN w LIKE '%ing' AND contains(left(s, length(w) - 3), 'v') THEN {cut(3)} END"""
    mended = f"""CASE WHEN b LIKE '%at' OR b LIKE '%bl' OR b LIKE '%iz' THEN b || 'e'
  WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND right(bs, 1) = 'c' THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE left(b, length(b) - 1) END
  WHEN len(regexp_extract_all(bs, 'v+c+')) = 1 AND {cvc('b', 'bs')} THEN b || 'e' ELSE b END"""
    past = f"CASE WHEN b IS NOT NULL THEN {mended} WHEN w LIKE '%ied' THEN {short} WHEN w LIKE '%eed' AND {measure(3)} > 0 THEN {cut(1)} ELSE w END"
    final_y = f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND right(left(s, length(w) - 1), 1) = 'c' THEN {cut(1)} || 'i' ELSE w END"
    alli = f"CASE WHEN w LIKE '%alli' AND {measure(4)} > 0 THEN {cut(2)} ELSE w END"
    logi = f"CASE WHEN w LIKE '%logi' THEN CASE WHEN {measure(3)} > 0 THEN {cut(1)} ELSE w END ELSE {table(STEP2)} END"
    drop = "CASE " + " ".join(
        f"WHEN w LIKE '%{a}' THEN CASE WHEN {measure(len(a))} > 1" + (f" AND right({cut(3)}, 1) IN ('s', 't')" if a == "ion" else "") + f" THEN {cut(len(a))} ELSE w END"
        for a in STEP4
    ) + " ELSE w END"
    final_e = f"CASE WHEN w LIKE '%e' AND ({measure(1)} > 1 OR {measure(1)} = 1 AND NOT ({cvc(cut(1), 'left(s, length(w) - 1)')})) THEN {cut(1)} ELSE w END"
    final_l = f"CASE WHEN w LIKE '%ll' AND {measure(1)} > 1 THEN {cut(1)} ELSE w END"
    listed = "CASE token " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items()) + " END"
    return f"""
vocabulary AS ({tokens_sql}),
{step('st0', '(SELECT token, token AS w FROM vocabulary WHERE length(token) > 3)', 'w')},
{step('st1', 'st0', plural)},
{step('st2', f'(SELECT *, left(s, length(b)) AS bs FROM (SELECT *, {rest} AS b FROM st1))', past)},
{step('st3', 'st2', final_y)}, {step('st4', 'st3', alli)}, {step('st5', 'st4', logi)}, {step('st6', 'st5', table(STEP3))},
{step('st7', 'st6', drop)}, {step('st8', 'st7', final_e)}, {step('st9', 'st8', final_l)},
stems AS (SELECT v.token, CASE WHEN length(v.token) <= 3 THEN v.token ELSE coalesce({listed.replace('token', 'v.token')}, w) END AS stem
          FROM vocabulary v LEFT JOIN st9 ON v.token = st9.token)"""


def stemmed(source: str, keys: str, cols: list[str]) -> str:
    """SELECT of ``keys`` and the stemmed token list of each text column in ``cols``, from a table or CTE; needs ``stems``."""
    parts = [
        f"(SELECT {keys}, list(coalesce(stem, t) ORDER BY pos) FILTER (t IS NOT NULL) AS {c}_s FROM (SELECT {keys}, unnest(tok) AS t, generate_subscripts(tok, 1) AS pos "
        f"FROM (SELECT {keys}, {tokens(c)} AS tok FROM {source})) LEFT JOIN stems ON stems.token = t GROUP BY {keys})"
        for c in cols
    ]
    joined = f"(SELECT {keys} FROM {source})" + "".join(f" LEFT JOIN {p} USING ({keys})" for p in parts)
    return f"SELECT {keys}, " + ", ".join(f"coalesce({c}_s, []) AS {c}_s" for c in cols) + f" FROM {joined}"


def logistic_ctes(train: str, features: int, C: float, l1_ratio: float, name: str = "fit", rounds: int = 3000) -> str:
    """CTEs ending in ``{name}(w, b)``: logistic regression with an elastic net on (id, layer_scores, label).

    Accelerated proximal gradient on the mean loss with penalty weight 1 / (C n); the step is 1 over
    the bound (mean squared norm + 1) / 4 of the curvature, momentum restarts every 300 rounds.
    """
    soft = "sign(v) * greatest(abs(v) - step * l1, 0)"
    return f"""
{name}_data AS (SELECT x, y, n, list_transform(range(1, {features} + 1), lambda d: list_transform(x, lambda r: r[d])) AS xt,
         4 / (list_avg(list_transform(x, lambda r: list_dot_product(r, r))) + 1) AS step, {l1_ratio} / ({C}::DOUBLE * n) AS l1, (1 - {l1_ratio}) / ({C}::DOUBLE * n) AS l2
  FROM (SELECT list(layer_scores ORDER BY id) AS x, list(label::DOUBLE ORDER BY id) AS y, count(*) AS n FROM ({train}))),
{name}_walk AS (
  SELECT 0 AS k, list_transform(range({features}), lambda d: 0::DOUBLE) AS w, 0::DOUBLE AS b, list_transform(range({features}), lambda d: 0::DOUBLE) AS zw, 0::DOUBLE AS zb
  UNION ALL
  SELECT k + 1, nw, nb, list_transform(list_zip(nw, w), lambda p: p[1] + m * (p[1] - p[2])), nb + m * (nb - b)
  FROM (SELECT k, w, b, k % 300 / (k % 300 + 3.0::DOUBLE) AS m, zb - step * list_sum(r) / n AS nb,
               list_transform(list_transform(list_zip(zw, xt), lambda p: p[1] - step * (list_dot_product(p[2], r) / n + l2 * p[1])), lambda v: {soft}) AS nw
        FROM (SELECT s.*, d.xt, d.n, d.step, d.l1, d.l2,
                     list_transform(list_zip(d.x, d.y), lambda p: 1 / (1 + exp(-(list_dot_product(p[1], s.zw) + s.zb))) - p[2]) AS r
              FROM {name}_walk s, {name}_data d WHERE s.k < {rounds}))),
{name} AS (SELECT w, b FROM {name}_walk WHERE k = {rounds})"""
