"""Collocations, substring dedup and ranked search against brute force, and their edge cases."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import LONG, ODD, SCHEMA, empty, odd, texts_of  # noqa: F401 - fixtures

from answerscope.llm import bitmaps, collocations, passages, search
from answerscope.llm.common import segments, slices
from answerscope.llm.queries_d import _collocations, _passages, _search
from answerscope.llm.registered import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def prose(rng, n, words=12, planted=()):
    """Texts of few words with punctuation; some hold planted passages."""
    out = []
    for _ in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 60))):
            parts.append(f"w{min(int(rng.geometric(0.2)), words)}" if rng.random() < 0.9 or not planted else planted[int(rng.integers(len(planted)))])
            parts.append(str(rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", É "])))
        out.append("".join(parts))
    return out


def test_helpers(spark):
    raw = b" ".join(b"x" * (i % 50) for i in range(400))
    for size in (1, 7, 64, 10_000_000):
        parts = list(segments(raw, size))
        assert b" ".join(parts) == raw and (size > 100 or len(parts) > 50)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 1000] * 50, "id": list(range(50))})
    cut = list(slices([batch], "text", 5000))
    assert len(cut) > 8 and [i for b in cut for i in b.column("id").to_pylist()] == list(range(50))
    keys = spark.range(1000).select(F.xxhash64(F.lit("en"), F.col("id").cast("string")).alias("key"), (F.col("id") % 2).alias("of"))
    even, uneven = bitmaps.bitmaps(keys, F.col("key"), F.col("of"), 2)
    seed = xxhash.xxh64_intdigest("en", 42)
    told = np.array([xxhash.xxh64_intdigest(str(i), seed) for i in range(20_000)], np.uint64)
    assert even.has(told[:1000:2]).all() and uneven.has(told[1:1000:2]).all() and even.has(told[1000:]).mean() < 0.1


# collocations


def brute_collocations(rows, least, longest, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        f = {p: c for p, c in f.items() if c >= least}
        inside = {(p[i : i + s], c) for p, c in f.items() for s in range(2, len(p)) for i in range(len(p) - s + 1)}
        found = []
        for p, a in f.items():
            if len(p) > 1 and (p, a) not in inside:
                score, _, le, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), le, r))
        for rank, (score, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,longest,top", [(3, 5, 8), (2, 4, 40), (4, 2, 1000)])
def test_collocations(spark, least, longest, top):
    rng = np.random.default_rng(least)
    rows = [(["en", "fr", None, "und"][i % 4], t) for i, t in enumerate(prose(rng, 160, 14, ["Alpha beta GAMMA", "one two three four five six", "de la"]))]
    rows += [("en", None), ("en", ""), ("zz", "lonely"), ("zz", "\n.;")] + rows[:7]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    docs = docs.withColumn("phrase", F.lit(1)).withColumn("f", F.lit("x"))
    want = brute_collocations(rows, least, longest, top)
    for most in (0, 1000) if top == 40 else (1000,):  # words numbered by chunk, or from a list
        assert sorted(map(tuple, collocations.collocations(docs, least=least, longest=longest, top=top, most_words=most).collect())) == want


def test_collocations_odd(odd, empty):  # noqa: F811
    assert [tuple(r) for r in collocations.collocations(odd, least=2).orderBy("lang", "rank").collect()] == brute_collocations([(r["lang"], r["text"]) for r in odd.collect()], 2, 5, 2000)
    assert collocations.collocations(empty).collect() == []


def test_chunks_change_no_count(monkeypatch):
    """Chunks that end inside a text count the same grams and see the same neighbours."""
    rng = np.random.default_rng(3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr", "en", "en"], "text": [*prose(rng, 3), " ".join(prose(rng, 60)).replace(".", " ")]})
    everything = bitmaps.Bitmap(np.full(1024, 2**64 - 1, np.uint64))
    told = SimpleNamespace(value=collocations.Wave(everything, everything, everything, everything, {2, 3, 4, 5}, 5))
    listed = {lang: sorted({w for t in t_ for p in collocations.words_of(t) for w in p} - {b"\xff"}) for lang, t_ in (("en", batch["text"].to_pylist()), ("fr", batch["text"].to_pylist()))}

    def summed():
        out = {}
        for b in collocations._counts(told)([batch]):
            for r in b.to_pylist():
                old = out.get((r["lang"], r["phrase"]), (0, r["nlo"], r["nhi"], r["plo"], r["phi"]))
                out[r["lang"], r["phrase"]] = (old[0] + r["c"], min(old[1], r["nlo"]), max(old[2], r["nhi"]), min(old[3], r["plo"]), max(old[4], r["phi"]))
        return out

    whole = summed()
    for chunk, part in ((1, 40), (50, 200), (300, 1 << 20)):
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        monkeypatch.setattr(collocations, "segments", lambda raw, n=part: segments(raw, n))
        assert summed() == whole
    assert len(whole) > 1000
    told.value.dictionary = listed
    assert summed() == whole


def test_numbered_rows_change_no_count(monkeypatch):
    """Rows that end inside a text, put together again, count the same grams and see the same neighbours."""
    rng = np.random.default_rng(4)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr", "zz", "en", "en"], "text": [*prose(rng, 4), " ".join(prose(rng, 60)).replace(".", " ")]})
    everything = bitmaps.Bitmap(np.full(1024, 2**64 - 1, np.uint64))
    listed = {lang: [b"w%d" % i for i in range(1, most)] for lang, most in (("en", 9), ("fr", 70_000))}
    told = SimpleNamespace(value=collocations.Wave(everything, everything, everything, everything, {2, 3, 4, 5}, 5, listed))

    def summed(batches):
        out = {}
        for b in batches:
            for r in b.to_pylist():
                old = out.get((r["lang"], r["phrase"]), (0, r["nlo"], r["nhi"], r["plo"], r["phi"]))
                out[r["lang"], r["phrase"]] = (old[0] + r["c"], min(old[1], r["nlo"]), max(old[2], r["nhi"]), min(old[3], r["plo"]), max(old[4], r["phi"]))
        return out

    whole = summed(collocations._counts(told)([batch]))
    assert {lang for lang, _ in whole} == {"en", "fr"} and len(whole) > 500
    for row, chunk, part in ((1, 1, 20), (1, 1 << 20, 5), (50, 300, 200), (1 << 16, 1 << 20, 1 << 20)):
        monkeypatch.setattr(collocations, "ROW", row)
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        monkeypatch.setattr(collocations, "segments", lambda raw, n=part: segments(raw, n))
        rows = list(collocations._numbered(SimpleNamespace(value=listed), 5)([batch]))
        assert summed(collocations._counts(told, True)(rows)) == whole


def test_waves_do_not_read_texts_again(spark):
    """Texts are read for the words and to be numbered, however many waves there are."""
    rows = [("en", t) for t in prose(np.random.default_rng(2), 100, 14, ["alpha beta gamma", "one two three four five six"])]
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: read.add(1) or t, "string").asNondeterministic()
    docs = spark.createDataFrame(rows, "lang string, text string").select("lang", seen("text").alias("text"))
    got = sorted(map(tuple, collocations.collocations(docs, least=3, top=20).collect()))
    assert got == brute_collocations(rows, 3, 5, 20) and read.value == 2 * len(rows)


# substring dedup


def brute_passages(rows, window):
    rank = lambda i: math.inf if i is None else i
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    holder = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            holder[key] = min(holder.get(key, math.inf), rank(i))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if holder[tuple(w[k : k + window])] < rank(i) for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def removed(docs, window):
    return sorted((tuple(r) for r in passages.remove_repeated_passages(docs, window=window).select("key.doc_id", "n_words", "n_removed", "kept").collect()), key=str)


@pytest.mark.parametrize("window", [1, 5, 13, 30])
def test_passages(spark, window):
    rng = np.random.default_rng(window)
    texts = prose(rng, 120, 60, [" ".join(f"p{k}.{j}" for j in range(10 + 9 * k)) for k in range(6)])
    rows = [(int(i), t) for i, t in zip(rng.permutation(120), texts)]
    rows += [(i + 500, t) for i, t in rows[:6]] + [(3, texts[9]), (3, texts[9]), (None, texts[2]), (None, texts[2]), (700, None), (701, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = removed(docs.withColumn("id", F.lit("x")).withColumn("pos", F.lit(1)), window)
    assert got == brute_passages(rows, window)
    assert sum(r[2] for r in got) > 100


def test_passages_odd(odd, empty):  # noqa: F811
    assert removed(odd, 13) == brute_passages([(r["doc_id"], r["text"]) for r in odd.collect()], 13)
    assert removed(empty, 13) == []


def test_lengths_double():
    assert passages.lengths(13) == [4, 7, 13] and passages.lengths(4) == [4] and passages.lengths(50)[-3:] == [13, 25, 50]
    for window in range(1, 200):
        sizes = passages.lengths(window)
        assert sizes[-1] == window and all(a < b <= 2 * a for a, b in zip(sizes, sizes[1:]))


def test_slices_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 4000, n)) for n in (3000, 12, 13, 700, 0)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(5), pa.int64()), "th": pa.array(range(5), pa.int64()), "text": texts})

    def rows(fn):
        return sorted({tuple(r.values()) for b in fn([batch]) for r in b.to_pylist()})

    everything = SimpleNamespace(value=bitmaps.Bitmap(np.full(1024, 2**64 - 1, np.uint64)))
    run = lambda: (rows(passages._windows(13, None, None, [])), rows(passages._level(13, everything, [])))
    windows, grown = run()
    seeds = rows(passages._first_level(13))
    stretches = rows(passages._windows(13, everything, SimpleNamespace(value=bitmaps.Bitmap(np.zeros(1024, np.uint64))), []))
    assert len(windows) == 2988 + 1 + 688 and 0.15 < len(seeds) / 3700 < 0.25 and len(grown) < 2 * len(seeds)
    assert len(stretches) == len(seeds) and sum(r[4] + 1 for r in stretches) == len(windows)
    monkeypatch.setattr(passages, "SLICE", 100)
    monkeypatch.setattr(passages, "segments", lambda raw: segments(raw, 90))
    assert run() == (windows, grown)


def test_levels_leave_few_candidates(spark):
    """Only what repeats is extended: of the words of one planted passage, not of all texts."""
    rng = np.random.default_rng(4)
    passage = " ".join(f"q{j}" for j in range(40))
    rows = [(i, " ".join(f"u{k}" for k in rng.integers(0, 1 << 40, 300)) + (" " + passage if i % 10 == 0 else "")) for i in range(60)]
    seen = []
    real = passages.stored
    try:
        passages.stored = lambda df, name: seen.append((name, real(df, name))) or seen[-1][1]
        got = removed(spark.createDataFrame(rows, "doc_id long, text string"), 13)
    finally:
        passages.stored = real
    assert got == brute_passages(rows, 13)
    counts = [(name, df.count()) for name, df in seen]
    assert [name for name, _ in counts] == ["repeated", "repeated", "windows", "repeats"]
    assert all(n < 60 for name, n in counts if name == "repeated") and dict(counts)["windows"] < 6 * 28 + 300


# search


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(rows, queries, k):
    docs = [(math.inf if i is None else i, Counter(brute_terms(t))) for i, t in rows]
    total = sum(bool(c) for _, c in docs)
    length = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c in docs:
            s = 0
            for t in set(brute_terms(text)) & set(c):
                m = 100 - 50 + (50 * sum(c.values()) * total) // length
                s += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if i == math.inf else i, -s))
    return sorted(out, key=str)


@pytest.mark.parametrize("k,block", [(3, 1 << 20), (10, 40), (500, 200)])
def test_search(spark, k, block):
    rng = np.random.default_rng(k)
    rows = [(int(i), t) for i, t in zip(rng.permutation(300), prose(rng, 300, 40, ["Éa9", "x_y", "Z"]))]
    rows += [*rows[:20], (None, "w1 w2 éa9"), (None, "w3"), (900, None), (901, "?!")]
    queries = [(i, t) for i, t in enumerate(prose(rng, 12, 40, ["Éa9 nowhere", "x-y"]))] + [(99, None), (98, ""), (97, "nothing of that kind"), (0, "w1"), (None, "w5 w5 éA9"), (3, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("n", F.lit("x")).withColumn("score", F.lit(2))
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("q1", F.lit(None)).withColumn("rank", F.lit(0))
    got = search.search(docs, asked, k=k, block_chars=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, queries, k)


def test_search_odd(spark, odd, empty):  # noqa: F811
    asked = spark.createDataFrame([(1, "same line password word3x3 É"), (2, LONG)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, search.search(odd, asked, k=4).collect()), key=str) == brute_search(rows, [tuple(r) for r in asked.collect()], 4)
    assert search.search(empty, asked).collect() == [] and search.search(odd, asked.limit(0)).collect() == []


def test_reading_stops_early():
    """Intervals close before the lists end, and in time a threshold from elsewhere helps."""
    rng = np.random.default_rng(5)
    size, postings = 4000, 30_000
    docs, term = rng.integers(0, size, postings), rng.integers(0, 6, postings)
    docs, term = np.append(docs, np.repeat(np.arange(60), 6)), np.append(term, np.tile(np.arange(6), 60))  # sixty hold every term
    both = np.unique(docs * 6 + term)
    docs, term = both // 6, both % 6
    tf = np.where(docs < 60, 400, 1) + rng.geometric(0.02, len(docs))
    weight = np.array([5000, 4000, 3000, 20, 10, 5])
    shard = search.Shard(np.arange(size), rng.integers(50, 500, size), docs, term, tf, weight, size, size * 200)
    want = np.zeros(size, np.int64)
    np.add.at(want, shard.docs, shard.impact)
    query = np.arange(6)
    found, scores, read = shard.best(query, 50, 1)
    cut = np.sort(want)[-50]
    assert sorted(found.tolist()) == np.flatnonzero(want >= cut).tolist() and (scores == want[found]).all()
    again, _, less = shard.best(query, 50, int(cut))
    assert sorted(again.tolist()) == sorted(found.tolist()) and less <= read < 0.5 * len(docs)


CONTRACT = {
    _collocations: "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    _passages: "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    _search: "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.mark.parametrize("fn", CONTRACT)
def test_contract(spark, fn):
    assert fn in QUERIES.values()
    assert ", ".join(" ".join(x) for x in fn(spark, "/root/testdata/sf0.001").dtypes) == CONTRACT[fn]
