"""Question sets: nested JSON sources to one normalised table.

Every reader returns (id, story, question, answer struct<text, answer_start>,
additional_answers). Paths may name one file, a folder of documents or JSON lines. A document is
read by one task unless ``split`` cuts it at its elements (see ``elements``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscope.operators.groups import pinned
from answerscope.operators.sampling import dedup_first
from answerscope.session import is_complete, stored
from answerscope.sources.elements import json_elements

# Layouts of the source documents.
TURN = "struct<input_text:string>"
COQA_SCHEMA = (
    "data array<struct<id:string,story:string,"
    f"questions:array<{TURN}>,"
    "answers:array<struct<input_text:string,span_start:bigint>>,"
    f"additional_answers:struct<`0`:array<{TURN}>,`1`:array<{TURN}>,`2`:array<{TURN}>>>>"
)
SQUAD_SCHEMA = (
    "data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,"
    "question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:bigint>>>>>>>>"
)
NQ_SCHEMA = "question string, answer array<string>"
TRIVIA_SCHEMA = (
    "question_id string, question string, answer struct<value:string>, "
    "search_results string, question_source string, entity_pages string"
)
EXTRA_ANSWER_LISTS = ("0", "1", "2")


def _answer(text, start):
    return F.struct(text.alias("text"), start.cast("bigint").alias("answer_start")).alias("answer")


def _elements(spark: SparkSession, path: str, schema: str, multi_line: bool, split: bool) -> DataFrame:
    """(d): the elements of the documents' ``data``."""
    if split:
        return json_elements(spark, path, schema)
    return spark.read.schema(schema).json(path, multiLine=multi_line).select(F.explode("data").alias("d"))


def read_coqa(spark: SparkSession, path: str, multi_line: bool = True, split: bool = False) -> DataFrame:
    """One row per question of a story, with the aligned answer and three extra answers.

    ``split``: many tasks read each document, a multi-line one or a single line.
    """
    stories = _elements(spark, path, COQA_SCHEMA, multi_line, split)
    asked = stories.select("d", F.posexplode("d.questions").alias("pos", "q"))
    given = F.get(F.col("d.answers"), F.col("pos"))
    extra = F.array(
        *[F.get(F.col(f"d.additional_answers.`{k}`"), F.col("pos"))["input_text"] for k in EXTRA_ANSWER_LISTS]
    )
    return asked.select(
        F.concat(F.col("d.id"), F.lit("_"), F.col("pos").cast("string")).alias("id"),
        F.col("d.story").alias("story"),
        F.col("q.input_text").alias("question"),
        _answer(given["input_text"], given["span_start"]),
        extra.alias("additional_answers"),
    )


def read_squad(spark: SparkSession, path: str, multi_line: bool = True, split: bool = False) -> DataFrame:
    """Answerable questions; all answer texts, the first included, are additional answers."""
    paragraphs = _elements(spark, path, SQUAD_SCHEMA, multi_line, split).select(F.explode("d.paragraphs").alias("p"))
    asked = paragraphs.select(F.col("p.context").alias("story"), F.explode("p.qas").alias("q"))
    first = F.get(F.col("q.answers"), F.lit(0))
    return asked.filter(~F.col("q.is_impossible")).select(
        F.col("q.id").alias("id"),
        "story",
        F.col("q.question").alias("question"),
        _answer(first["text"], first["answer_start"]),
        F.transform("q.answers", lambda a: a["text"]).alias("additional_answers"),
    )


def nq_open(rows: DataFrame, index: str = "row_idx") -> DataFrame:
    """Questions with a list of answers; a repeated question takes its last row's index as id.

    ``index`` is the row's place in the source (see ``sampling.row_index``).
    """
    last = rows.groupBy("question").agg(F.max(index).alias("_last"))
    return rows.join(last, "question").select(
        F.col("_last").cast("string").alias("id"),
        F.lit(None).cast("string").alias("story"),
        "question",
        _answer(F.get(F.col("answer"), F.lit(0)), F.lit(None)),
        F.slice("answer", F.lit(2), F.greatest(F.size("answer") - 1, F.lit(0))).alias("additional_answers"),
    )


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines (value, row_idx) numbered by file name and place in the file; blank lines skipped.

    Splits are read in order, so a line's place inside its split is its distance from the
    split's first line. The lines are written once with split and place, and both the splits'
    offsets and the result come from that copy: splits that another read would cut elsewhere
    cannot disagree. Only one row per split is ranked; lines are neither sorted nor shuffled.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.filter(F.trim("value") != "").select(
        "value", "file_path", "file_block_start", F.monotonically_increasing_id().alias("_seen")
    )
    lines = stored(lines, "lines")
    split = ["file_path", "file_block_start"]
    before = Window.partitionBy(F.lit(0)).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*split).agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = splits.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    found = lines.join(pinned(offsets), split, "left")
    place = F.col("_seen") - F.col("_first") + F.col("_offset")
    known = F.when(place.isNotNull(), place).otherwise(F.raise_error(F.lit("a line of an unknown split")))
    return found.select("value", known.cast("bigint").alias("row_idx"))


def read_nq_open(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (question, answer list). A row's index is its place in the files."""
    parsed = number_lines(spark, path).select("row_idx", F.from_json("value", NQ_SCHEMA).alias("r"))
    return nq_open(parsed.select("row_idx", "r.*"))


def triviaqa(rows: DataFrame, order: list[str]) -> DataFrame:
    """First row per question id; evidence columns are dropped before anything moves."""
    slim = rows.drop("search_results", "question_source", "entity_pages")
    first = dedup_first(slim, "question_id", order)
    return first.select(
        F.col("question_id").alias("id"),
        F.lit(None).cast("string").alias("story"),
        "question",
        _answer(F.col("answer.value"), F.lit(None)),
        F.array().cast("array<string>").alias("additional_answers"),
    )


def read_triviaqa(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """JSON lines; duplicates of a question id keep the first by ``order``."""
    rows = spark.read.schema(TRIVIA_SCHEMA).json(path)
    return triviaqa(rows, order or ["question", "answer.value"])


def save_qa(qa: DataFrame, path: str) -> None:
    """Writes the normalised table unless it is already there, completely."""
    if not is_complete(qa.sparkSession, path):
        qa.write.mode("overwrite").parquet(path)


def load_qa(spark: SparkSession, path: str, build=None) -> DataFrame:
    """Reads the normalised table, building and saving it first when it is missing."""
    if build is not None and not is_complete(spark, path):
        save_qa(build(), path)
    return spark.read.parquet(path)


def contexts(qa: DataFrame) -> DataFrame:
    return qa.select("id", "story")

