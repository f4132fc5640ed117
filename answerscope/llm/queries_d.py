"""Registered queries: collocations, substring dedup, ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.llm import collocations, passages, search
from answerscope.llm.common import documents, query

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_collocations", f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, range(1, 6) AS r(m)) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, f, m, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM grams WHERE m > 1),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.m, k, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN total t ON c.lang = t.lang
  JOIN grams l ON c.lang = l.lang AND l.phrase = array_to_string(w[1 : k], ' ')
  JOIN grams r ON c.lang = r.lang AND r.phrase = array_to_string(w[k + 1 :], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT b.lang, array_to_string(string_split(b.phrase, ' ')[i : i + s - 1], ' ') AS phrase, b.f
  FROM grams b, range(2, 5) AS x(s), range(1, 5) AS y(i) WHERE s < b.m AND i + s - 1 <= b.m),
closed AS (SELECT o.* FROM lowest o ANTI JOIN inside i ON o.lang = i.lang AND o.phrase = i.phrase AND i.f >= o.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM closed)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""")
def _collocations(spark, sf):
    return collocations.collocations(documents(spark, sf).select("text", "lang"))


@query("op12_passages", """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)),
again AS (SELECT v.doc_id, v.i FROM windows v JOIN (SELECT h, min(doc_id) AS holder FROM windows GROUP BY h) USING (h) WHERE v.doc_id > holder),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(0, 13) AS r(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
left_over AS (SELECT s.* FROM words s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM left_over GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id""")
def _passages(spark, sf):
    found = passages.remove_repeated_passages(documents(spark, sf).select("doc_id", "text"))
    return found.select("key.doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce({}, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op13_search", f"""
WITH docs AS (SELECT doc_id, {_TERMS.format("text")} AS t FROM documents),
whole AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t)) AS n_terms FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, whole GROUP BY term, n_docs),
impact AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * n_docs) // n_terms AS BIGINT)))) AS s
  FROM tf JOIN weight USING (term), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scores QUALIFY rank <= 50""")
def _search(spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    return search.search(documents(spark, sf).select("doc_id", "text"), benchmark)
