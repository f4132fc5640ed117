"""Every registered query runs; those with oracle SQL agree with DuckDB."""

import __spark_entry__ as entry
import pytest
from compare import compare, oracle_connection

from answerscope.plans.views import records

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    plans = []

    def run(session, sf):
        df = entry.queries()[name](session, sf)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    ok, note = compare(spark, con, name, run, SQL.get(name), SF)
    assert ok, note
    assert "CartesianProduct" not in plans[0] and "NestedLoopJoin" not in plans[0]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0.0 <= rows[0]["auroc"] <= 1.0


def test_oracles_name_known_queries():
    assert set(SQL) <= set(entry.queries())


def test_every_generation_has_its_rating_prompt(spark):
    """One prompt for each generation of each record, with that generation as the answer."""
    rows = entry.queries()["rating_prompts"](spark, SF).collect()
    told = {(r["id"], r["gen_id"]): r["prompt"] for r in rows}
    want = {(r["id"], k): g for r in records(spark, SF).select("id", "generations").collect() for k, g in enumerate(r["generations"])}
    assert len(rows) == len(told) and set(told) == set(want) and max(k for _, k in want) > 1
    assert all(told[k].endswith(f"\nAnswer: {g.strip()}\nRating:") for k, g in want.items())
