import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerscope.functions import overlap as O
from answerscope.functions import text as X
from answerscope.functions.stemming import porter_stem
from answerscope.operators import similarity as D


def apply(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values[0]))] if isinstance(values[0], tuple) else ["c0"]
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"k int, {schema}")
    return [r["o"] for r in df.select("k", fn(*[F.col(n) for n in names]).alias("o")).orderBy("k").collect()]


def python_normal(s):
    s = "".join(ch for ch in s.lower() if ch not in set(string.punctuation))
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def test_normalize_matches_plain_python(spark):
    texts = [
        "The  cat, an owl & a dog!", "Théâtre the été", "a", "", "An-other a.b the\tend\nof THE line",
        "thea éa aé anan the2 2the", "ß the ü an", "non breaking the space", "x\x1cthe\x1fy", "THE_A_AN a_n",
    ]
    assert apply(spark, X.normalize_text, *texts) == [python_normal(t) for t in texts]


def test_exact_match(spark):
    pairs = [("The Answer.", "answer"), ("an answer", "a answer!"), ("yes", "no"), ("", "the")]
    assert apply(spark, X.exact_match, *pairs) == [1, 1, 0, 1]
    # articles count when only case and punctuation are ignored
    assert apply(spark, X.exact_match_ci, ("  The End.", "the end"), ("the end", "end")) == [1, 0]


def test_clean_answer_applies_markers_in_order(spark):
    texts = ["Paris. Q: next", "Paris\nLondon", "x Q: y", "a Answer: b", "no marker", ".lead", "ANSWER: z"]
    assert apply(spark, X.clean_answer, *texts) == ["Paris", "Paris", "x ", "a ", "no marker", "", ""]


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde")), st.lists(st.sampled_from("abcde")))
def test_lcs_bit_rows_equal_table(a, b):
    assert O.lcs_length(a, b) == lcs_table(a, b) == O.lcs_length(b, a)


def test_native_lcs_equals_arrow(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for _ in range(40)]
    df = spark.createDataFrame([(a, b) for a, b in rows], "a array<string>, b array<string>")
    got = [r["n"] for r in df.select(O.lcs_native(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [lcs_table(a, b) for a, b in rows]


def test_rouge_golden(spark):
    pairs = [("the cat sat on the mat", "the cat lay on the mat"), ("", "x"), ("same words", "same words"), ("Running dogs", "run dog")]
    got = apply(spark, lambda p, r: O.rouge_l(p, r, stem=True), *pairs)
    assert got == pytest.approx([2 * 5 / 12, 0.0, 1.0, 1.0])  # running -> run, dogs -> dog; run and dog are too short to be stemmed
    assert apply(spark, lambda p, r: O.rouge_n(p, r, 2), ("a b c", "a b d"))[0] == pytest.approx(0.5)
    assert apply(spark, lambda p, r: O.rouge_n(p, r, 1), ("a a b", "a c c"))[0] == pytest.approx(1 / 3)


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "troubled": "troubl", "sized": "size",
        "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi",
        "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "operator": "oper",
        "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
        "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form", "formalize": "formal",
        "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
        "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac",
        "adoption": "adopt", "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate",
        "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "news": "news", "sky": "sky",
    }
    assert {w: porter_stem(w) for w in known} == known


ANSWERS = [
    (1, 0, "the red fox"), (1, 1, "the red dog"), (1, 2, "the red fox"), (1, 3, "blue"), (2, 0, "only one"),
    (3, 0, "same"), (3, 1, "same"), (4, 0, "..."), (4, 1, "..."),
] + [(5, i, f"w{i % 7} common w{(i * 3) % 11} tail w{i % 5}") for i in range(40)]


def brute_lexical(texts):
    toks = [O.tokens_of(t, False) for t in texts]
    pairs = [O.pair_score(toks[i], toks[j], "rougeL") for i in range(len(texts)) for j in range(i + 1, len(texts))]
    return sum(pairs) / len(pairs) if pairs else None


@pytest.mark.parametrize("limit", [3, 64])
def test_lexical_similarity(spark, limit):
    df = spark.createDataFrame(ANSWERS, "sample_id int, gen_id int, text string")
    got = {r["sample_id"]: r["lexical_similarity"] for r in D.lexical_similarity(df, stem=False, limit=limit).collect()}
    for s in range(1, 6):
        want = brute_lexical([t for i, _, t in ANSWERS if i == s])
        assert got[s] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("limit", [3, 64])
def test_syntactic_similarity(spark, limit):
    df = spark.createDataFrame(ANSWERS, "sample_id int, gen_id int, text string")
    got = {r["sample_id"]: r for r in D.syntactic_similarity(df, limit=limit).collect()}
    for s in range(1, 6):
        texts = [t for i, _, t in ANSWERS if i == s]
        for m in O.MEASURES:
            vals = [O.pair_score(O.tokens_of(a, False), O.tokens_of(b, False), m) for a in texts for b in texts if a != b]
            assert got[s][m] == (pytest.approx(sum(vals) / len(vals)) if vals else None)


@pytest.mark.parametrize("limit", [3, 64])
def test_similarity_matrix(spark, limit):
    df = spark.createDataFrame(ANSWERS, "sample_id int, gen_id int, text string")
    rows = D.lexical_similarity_matrix(df, limit=limit).collect()
    for s in range(1, 6):
        unique = sorted({t for i, _, t in ANSWERS if i == s})
        got = {r["ans_id"]: r["sims"] for r in rows if r["sample_id"] == s}
        assert sorted(got) == list(range(len(unique)))
        for i, a in enumerate(unique):
            want = [1.0 if i == j else O.pair_score(O.tokens_of(a, False), O.tokens_of(b, False), "rougeL") for j, b in enumerate(unique)]
            assert got[i] == pytest.approx(want)


def test_score_generations_brute(spark):
    recs = [
        ("a", "Paris", ["in Paris", " paris "], ["Paris!", "paris!", "London", " Paris!"]),
        ("b", "forty two", None, ["forty two", "42"]),
        ("c", "x y", [], ["y x", "x y z", ""]),
    ]
    df = spark.createDataFrame(recs, "id string, answer string, additional_answers array<string>, generations array<string>")
    got = {(r["id"], r["gen_id"]): r for r in D.score_generations(df).collect()}
    assert len(got) == 9
    drop = str.maketrans("", "", string.punctuation)
    for rid, ans, extra, gens in recs:
        refs = {x.lstrip().lower() for x in [ans, *(extra or [])]}
        for i, g in enumerate(gens):
            p = g.lstrip().lower()
            assert got[rid, i]["exact_match"] == max(float(p.translate(drop) == r.translate(drop)) for r in refs)
            for m in O.MEASURES:
                want = max(O.pair_score(O.tokens_of(p, False), O.tokens_of(r, False), m) for r in refs)
                assert got[rid, i][m] == pytest.approx(want)


def test_stem_vocabulary(spark):
    df = spark.createDataFrame([("Running dogs running",), ("été ran",)], "text string")
    rows = {r["token"]: r["stem"] for r in D.stem_vocabulary(df, "text").collect()}
    assert rows == {"running": "run", "dogs": "dog", "ran": "ran", "t": "t"}
