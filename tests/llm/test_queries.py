"""The registered queries themselves: columns, types and rows on a given table."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_fingerprint, brute_quality

from answerscope.llm import secrets
from answerscope.llm.queries_b import _secrets
from answerscope.llm.registered import ORACLES, QUERIES
from answerscope.llm.secrets_sql import SQL

SF = "/root/testdata/sf0.001"

CONTRACT = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op5_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, name):
    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert [f"{c} {kinds[c]}" for c in df.columns][: CONTRACT[name].count(",") + 1] == CONTRACT[name].split(", ")
    ids = {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs])
    got = [tuple(r) for r in QUERIES["op6_simhash"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted([(i, f"{p:016x}", c) for i, p, c in want], key=str)


def test_quality_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_quality_rules"](spark, SF).collect():
        counts = brute_quality(docs[r["doc_id"]])
        assert tuple(r)[1:6] == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["base_failed"] and r["kept"])


def test_secret_query_and_its_sql(spark, tmp_path):
    """A table with random strings, words and base spans, so that every column has something to say."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(200):
        key = "".join(rng.choice(list(secrets.ENCODINGS["base62"]), int(rng.integers(28, 60))))
        parts = [f"é text {key} and", "/".join(rng.choice(["home", "data", "users", "public"], 9)), f'Token: "{key[:12]}"', "AKIA" + "A1B2C3D4E5F6G7H8" * 1, "0123456789abcdef" * 2]
        rows.append((k, " ".join(rng.permutation(parts)[: int(rng.integers(0, 6))])))
    rows += [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in _secrets(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({SQL})").fetchall()
    assert sorted(got) == sorted(want)
    assert sum("random" in r[5] for r in got) > 80 and sum(r[1] for r in got) > 50 and sum(r[2] for r in got) > 50


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
