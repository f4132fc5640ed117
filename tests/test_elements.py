"""Large JSON documents cut at their elements: the same rows as the reader of whole documents."""

import json
import random

import pytest

from answerscope.sources import elements as E
from answerscope.sources import questions as Q

ODD = ['plain', 'a } b', '{"data": [', 'quote " and } and {', "back\\slash", '\\" } \\\\', "]", "tab\t", "line\nbreak", "Ünïcode } ✓", ""]


def coqa(rng, stories, first=0):
    turn = lambda n: [{"input_text": rng.choice(ODD) + str(i)} for i in range(n)]
    out = []
    for s in range(first, first + stories):
        n = rng.randrange(0, 6)
        out.append({
            "source": "x", "id": f"s{s}", "story": " ".join(rng.choices(ODD, k=rng.randrange(1, 30))), "questions": turn(n),
            "answers": [{"span_start": i, "input_text": rng.choice(ODD)} for i in range(n)],
            "additional_answers": {k: turn(n) for k in "012"}, "name": rng.choice(ODD),
        })
    return out


def squad(rng, articles):
    qa = lambda i: {"id": str(i), "question": rng.choice(ODD), "is_impossible": rng.random() < 0.3, "answers": [{"text": rng.choice(ODD), "answer_start": k} for k in range(rng.randrange(0, 3))]}
    return [{"title": rng.choice(ODD), "paragraphs": [{"context": rng.choice(ODD), "qas": [qa(f"{a}-{p}-{q}") for q in range(rng.randrange(0, 4))]} for p in range(rng.randrange(0, 4))]} for a in range(articles)]


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def same(a, b):
    key = lambda r: json.dumps(r.asDict(recursive=True), sort_keys=True)
    a, b = sorted(map(key, a.collect())), sorted(map(key, b.collect()))
    assert a == b
    return len(a)


@pytest.mark.parametrize("seed, indent", [(1, None), (2, 1), (3, None)])
def test_rows_equal_those_of_whole_documents(spark, tmp_path, small_ranges, seed, indent):
    rng = random.Random(seed)
    c, s = tmp_path / "coqa", tmp_path / "squad"
    c.mkdir(), s.mkdir()
    ascii_only = seed == 3
    for k in range(2):  # two documents, each over many byte ranges
        (c / f"{k}.json").write_text(json.dumps({"version": 'v "1" }', "n": 3, "data": coqa(rng, 40, 100 * k)}, indent=indent, ensure_ascii=ascii_only))
    (s / "0.json").write_text(json.dumps({"data": squad(rng, 60), "version": "v2.0"}, indent=indent, ensure_ascii=ascii_only) + "\n")
    assert spark.read.text(str(c), lineSep="}").rdd.getNumPartitions() > 8
    assert same(Q.read_coqa(spark, str(c), split=True), Q.read_coqa(spark, str(c))) > 100
    assert same(Q.read_squad(spark, str(s), split=True), Q.read_squad(spark, str(s))) > 50


def test_edges(spark, tmp_path):
    for name, doc in {"empty": {"data": []}, "bare": {"data": [{}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    rows = lambda name: E.json_elements(spark, str(tmp_path / f"{name}.json"), "data array<struct<id:string>>").collect()
    assert rows("empty") == [] and [r["d"]["id"] for r in rows("bare")] == [None]
    (tmp_path / "cut.json").write_text('{"data": [{"id": "a"}, {"id": "b')
    assert [r["d"]["id"] for r in rows("cut")] == ["a"]
    (tmp_path / "two.json").write_text('{"data": [{"id": "a"}], "more": [{"id": "b"}]}')
    with pytest.raises(Exception, match="split=False"):
        rows("two")
