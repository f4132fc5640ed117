"""The pipeline's stages against brute force, stage by stage, and what the entry module offers."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm import LONG, ODD, SCHEMA, WORDS, brute_components, brute_fingerprint, brute_lines, brute_targets, check_pieces

from answerscope.llm import quality
from answerscope.llm.common import documents

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def brute_quality_stage(docs, labels):
    marks = {}
    for r in labels:
        if r["doc_id"] is not None and r["quality"] in (0, 1):
            marks.setdefault(r["doc_id"], set()).add(r["quality"])
    score = lambda d: min(int(quality.measure(d["text"] or "")[5] * quality.STEPS), quality.LAST_BIN)
    texts = {}
    for d in docs:
        if len(marks.get(d["doc_id"], ())) >= 1:
            texts.setdefault((d["lang"], d["text"], score(d)), set()).update(marks[d["doc_id"]])
    good, bad = {}, {}
    for (lang, _, at), seen in texts.items():
        if len(seen) == 1:
            for side, value in ((good, 1), (bad, 0)):
                side.setdefault(lang, {}).setdefault(at, 0)
                side[lang][at] += value in seen
    cut = {s: quality.certified_cutoff(good[s], bad[s], quality.MAX_FALSE, quality.DELTA / len(good)) for s in good}
    out = []
    for d in docs:
        n, _, _, _, repeated, _ = quality.measure(d["text"] or "")
        if n >= 50 and 100 * repeated <= 50 * n and score(d) <= cut.get(d["lang"], quality.LAST_BIN):
            out.append(d)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows, on a table with nulls, repeats and long texts beside real documents."""
    odd = spark.createDataFrame([(None if r[0] is None else r[0] - 100, *r[1:]) for r in ODD], SCHEMA)
    docs = documents(spark, SF).filter("doc_id < 400").unionByName(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).persist())
    return tables


def same(got, want):
    key = lambda r: str(sorted(r.items(), key=str))
    return sorted(map(key, got)) == sorted(map(key, want))


def test_quality_stage(spark, stages):
    labels = rows_of(spark.read.parquet(f"{SF}/labels.parquet"))
    assert same(rows_of(stages[1]), brute_quality_stage(rows_of(stages[0]), labels))


def test_line_stage(stages):
    before = rows_of(stages[1])
    by_id = {d["doc_id"]: d for d in before}
    want = [
        {**by_id[i], "text": kept if lost else by_id[i]["text"], "n_chars": len(kept) if lost else by_id[i]["n_chars"]}
        for i, _, lost, kept in brute_lines([(d["doc_id"], d["text"]) for d in before])
    ]
    assert same(rows_of(stages[2]), want)


def test_document_stage(stages):
    before = rows_of(stages[2])
    groups = brute_components([(d["doc_id"], brute_fingerprint(d["text"])) for d in before])
    first = {i for i, _, c in groups if i == c}
    assert len(first) < len(before)
    assert same(rows_of(stages[3]), [d for d in before if d["doc_id"] in first])


def test_mix_stage(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    size = lambda d: len(WORDS.findall(d["text"] or ""))
    sizes, taken, copies = {}, {}, {}
    for d in before:
        sizes[d["source"]] = sizes.get(d["source"], 0) + size(d)
    for d in after:
        taken[d["source"]] = taken.get(d["source"], 0) + size(d)
        copies[d["doc_id"]] = copies.get(d["doc_id"], 0) + 1
    assert max(copies.values()) <= 2
    by_id = {d["doc_id"]: d for d in before}
    assert all(d == by_id[d["doc_id"]] for d in after)
    largest = max(map(size, before))
    for source, target in brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 2 * largest


def test_pack_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = [(d["doc_id"], plain.encode(d["text"] or "", add_special_tokens=False).ids + [2]) for d in rows_of(stages[4])]
    assert check_pieces(stages[5].collect(), ids) < 4096


def test_stages_keep_the_columns_and_bear_empty_tables(spark, stages):
    extra = [F.lit(k).alias(c) for k, c in enumerate(("row", "id", "kept", "keep", "size", "copies", "score"))]
    wide = stages[0].select("*", *extra)
    empty = wide.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == wide.columns
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_odd_rows_pass_all_stages(spark):
    """Null ids and repeated rows too, each stage after the other."""
    docs = spark.createDataFrame(ODD + [(None, LONG, "en", None, 1), (None, LONG, "en", None, 1)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        docs.count()
    # document 5 keeps the only line; 6 stands for the others, which have lost it
    assert {r["doc_id"] for r in docs.collect()} == {5, 6}


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """Left out, the rest still imports and registers its own queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    (tmp_path / "answerscope").mkdir()
    for name in os.listdir(os.path.join(root, "answerscope")):
        if name not in ("llm", "__pycache__"):
            (tmp_path / "answerscope" / name).symlink_to(os.path.join(root, "answerscope", name))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pearson' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", code], env=env, cwd=tmp_path).returncode == 0
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()
