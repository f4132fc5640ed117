"""Scores of many pairs at once against one pair at a time."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerscope.functions import aligned, overlap
from answerscope.operators import similarity


@pytest.mark.parametrize("measure", overlap.MEASURES)
@pytest.mark.parametrize("longest,vocabulary", [(6, 3), (70, 10), (300, 40), (900, 12)])
def test_scores(measure, longest, vocabulary, monkeypatch):
    rng = np.random.default_rng(longest)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, int(rng.integers(0, longest)))) for _ in range(60)] + ["", "?!", "w1"]
    tokens = aligned.Tokens(False)
    i, j = rng.integers(0, len(texts), (2, 150))
    want = [overlap.pair_score(overlap.tokens_of(texts[x], False), overlap.tokens_of(texts[y], False), measure) for x, y in zip(i, j)]
    for work, worth in ((1, 0), (500, 0), (1 << 20, 0), (1 << 20, 10), (1 << 20, 1 << 20)):
        monkeypatch.setattr(aligned, "WORK", work)
        monkeypatch.setattr(aligned, "WORTH", worth)
        got = aligned.scores([tokens(texts[x]) for x in i], [tokens(texts[y]) for y in j], measure)
        assert got.tolist() == want
    assert aligned.scores([], [], measure).tolist() == []


def test_long_texts_take_linear_time():
    rng = np.random.default_rng(1)
    tokens = aligned.Tokens(False)
    a, b = (tokens(" ".join(f"w{x}" for x in rng.integers(0, 50, 20_000))) for _ in range(2))
    for measure in ("rouge1", "rouge2"):
        start = time.perf_counter()
        assert 0.5 < aligned.scores([a], [b], measure)[0] < 1
        assert time.perf_counter() - start < 1


def test_nulls_and_copies(spark):
    rows = [(1, ["a b c", None, "a b c", "x"], "a b", ["a b c", None]), (2, ["q"], None, []), (3, [], "a", None), (4, None, "a", ["b"])]
    df = spark.createDataFrame(rows, "id int, generations array<string>, answer string, additional_answers array<string>")
    got = {(r["id"], r["gen_id"]): (r["exact_match"], r["rouge1"], r["rouge2"], r["rougeL"]) for r in similarity.score_generations(df).collect()}
    assert got[1, 0] == got[1, 2] == (1.0, 1.0, 1.0, 1.0) and got[1, 1][1:] == (None, None, None) and got[1, 3][3] == 0.0
    assert got[2, 0][1:] == (None, None, None) and set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    pairs = spark.createDataFrame([("a b", "a c"), (None, "a"), ("a", None), ("", "")], "p string, r string")
    assert [r[0] for r in pairs.select(overlap.rouge_n(F.col("p"), F.col("r"), 1)).collect()] == [0.5, None, None, 0.0]


def test_a_record_of_many_generations_is_scored_in_linear_time(spark):
    start = time.perf_counter()
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda k: F.concat(F.lit("answer "), k.cast("string"))).alias("generations"), F.lit("answer 77").alias("answer"), F.array(F.lit("other")).alias("additional_answers"))
    got = similarity.score_generations(df).agg(F.count(F.lit(1)), F.sum("exact_match"), F.sum((F.col("rougeL") == 1).cast("int"))).first()
    assert tuple(got) == (30_000, 1.0, 1) and time.perf_counter() - start < 30


@pytest.fixture
def small_pieces(spark, monkeypatch):
    """The same bounds, for small batches."""
    monkeypatch.setattr(aligned, "WORK", 1 << 14)
    monkeypatch.setattr(aligned, "SLICE", 1 << 15, raising=False)
    for module in (similarity, overlap):
        monkeypatch.setattr(module, "PAIRS", 1 << 11, raising=False)


def _peak(fn, *columns) -> int:
    fn(*columns)  # caches of words
    tracemalloc.start()
    fn(*columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def _tiles(n: int, size: int, words: int):
    """Diagonal tiles of ``size`` texts."""
    rng = np.random.default_rng(n)
    texts = lambda: [{"text": " ".join(f"w{x}" for x in rng.integers(0, 500, words)), "copies": 1} for _ in range(size)]
    left = pa.array([texts() for _ in range(n)])
    return pa.array([True] * n), left, left


def test_memory_of_document_tiles_does_not_grow_with_the_batch(small_pieces):
    run = similarity._tile_sums(("rougeL",), True).func
    assert _peak(run, *_tiles(240, 5, 100)) < 2 * _peak(run, *_tiles(60, 5, 100))


def test_memory_of_answer_tiles_does_not_grow_with_the_batch(small_pieces):
    run = similarity._tile_sums(overlap.MEASURES, False).func
    assert _peak(run, *_tiles(1600, 6, 20)) < 2 * _peak(run, *_tiles(400, 6, 20))


def _records(n: int):
    rng = np.random.default_rng(n)
    texts = lambda size, words: [" ".join(f"w{x}" for x in rng.integers(0, 500, words)) for _ in range(size)]
    return pa.array([texts(15, 12) for _ in range(n)]), pa.array([texts(10, 12) for _ in range(n)])


def test_memory_of_records_does_not_grow_with_the_batch(small_pieces):
    run = overlap._best_each_udf(overlap.MEASURES, False).func
    assert _peak(run, *_records(400)) < 2 * _peak(run, *_records(100))


def test_slices_change_nothing(spark, monkeypatch):
    tiles, records = _tiles(40, 6, 20), _records(40)
    flat = records[0].flatten(), pa.array([x for x in records[1].to_pylist() for _ in range(15)])
    runs = [
        (similarity._tile_sums(overlap.MEASURES, True).func, tiles),
        (similarity._tile_matrix(False).func, (tiles[0], pa.array([[{"ans_id": i, "text": x["text"]} for i, x in enumerate(t)] for t in tiles[1].to_pylist()]), pa.nulls(40))),
        (overlap._best_each_udf(overlap.MEASURES, False).func, records),
        (overlap._best_udf(overlap.MEASURES, False).func, flat),
        (overlap._pair_udf("rouge2", False).func, (flat[0], flat[0].take(pa.array(np.arange(600)[::-1])))),
    ]
    whole = [run(*columns).to_pylist() for run, columns in runs]
    monkeypatch.setattr(aligned, "SLICE", 300)
    for module in (similarity, overlap):
        monkeypatch.setattr(module, "PAIRS", 7)
    assert [run(*columns).to_pylist() for run, columns in runs] == whole
    assert [run(*(c.slice(0, 0) for c in columns)).to_pylist() for run, columns in runs] == [[]] * 5
