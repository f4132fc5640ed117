"""One large JSON document read by many tasks.

The document is an object with plain fields and one array of objects, ``{"version": ..., "data":
[{...}, ...]}``. A JSON reader needs it whole; here the text source cuts it after every ``}``, so
byte ranges go to tasks as those of a line file do. Where an element ends depends on all text before:
whether a string is open (the parity of the quotes so far) and how many brackets are (their sum so
far). Both are prefix sums over short rows without text: a window inside each byte range, and one row
for each range carried over to the later ones. A range's brackets are summed for either parity at its
start, so one pass over its rows is enough. The pieces of an element then meet by its number.

Scale: windows hold one byte range each (``spark.sql.files.maxPartitionBytes``), groups one element.

Defined cases: an empty array gives no row; brackets and quotes in strings, escapes and any white
space between elements are kept apart; several files are several documents. A document with further
arrays or objects beside the array, or an element that is no valid JSON, ends in an error; one that
breaks off gives the elements it holds whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerscope.session import stored

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PLAIN_FIELD = rf'\s*{_STRING}\s*:\s*(?:{_STRING}|[^\s",\[\]{{}}]++)\s*,'
INSIDE = 2  # brackets that are open between two elements: the document's and the array's

PLACE = ["file_path", "file_block_start"]


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _depth(parts: Column, quotes: Column, opened: int) -> Column:
    """What a piece adds to the open brackets, its closing one included, if ``opened`` strings are open before it."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == opened), "")
    closes = F.when((quotes + opened) % 2 == 0, 1).otherwise(0)
    return _count(outside, "{") + _count(outside, "[") - _count(outside, "]") - closes


def _numbered(pieces: DataFrame) -> DataFrame:
    """(file_path, seen, element, ends) of every piece: the number of its element in the file, and whether it is its last."""
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    counted = pieces.select(*PLACE, "seen", _count(clean, '"').alias("q"), F.split(clean, '"').alias("parts")).select(
        *PLACE, "seen", "q", *[_depth(F.col("parts"), F.col("q"), k).alias(f"d{k}") for k in (0, 1)]
    )
    own = Window.partitionBy(*PLACE).orderBy("seen")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("q").over(before), F.lit(0)) % 2  # in a range that starts outside a string
    either = lambda k: F.when(F.col("opened") == k, F.col("d0")).otherwise(F.col("d1"))
    inside = counted.withColumn("opened", opened).select(*PLACE, "seen", "q", "opened", either(0).alias("s0"), either(1).alias("s1"))
    ranges = inside.groupBy(*PLACE).agg(F.sum("q").alias("q"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    earlier = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = ranges.withColumn("start", carried("q") % 2).withColumn("depth", carried(F.when(F.col("start") == 0, F.col("s0")).otherwise(F.col("s1"))))
    run = inside.withColumns({k: F.sum(k).over(upto) for k in ("s0", "s1")}).join(starts.select(*PLACE, "start", "depth"), PLACE)
    depth = F.col("depth") + F.when(F.col("start") == 0, F.col("s0")).otherwise(F.col("s1"))
    ends = ((F.col("start") + F.col("opened") + F.col("q")) % 2 == 0) & (depth == INSIDE)
    ended = stored(run.select(*PLACE, "seen", ends.cast("int").alias("ends")), "ends")
    offsets = ended.groupBy(*PLACE).agg(F.sum("ends").alias("n")).select(*PLACE, carried("n").alias("offset"))
    number = F.col("offset") + F.coalesce(F.sum("ends").over(before), F.lit(0))
    return ended.join(offsets, PLACE).select("file_path", "seen", "ends", number.alias("element"))


def json_elements(spark: SparkSession, path: str, schema: str, field: str = "data") -> DataFrame:
    """(d): one row for each element of the array ``field``; ``schema`` is the document's, as DDL."""
    kind = StructType.fromDDL(schema)[field].dataType.elementType
    pieces = spark.read.text(path, lineSep="}").select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("seen")
    )
    pieces = stored(pieces, "pieces")
    placed = pieces.join(_numbered(pieces), ["file_path", "seen"])
    whole = placed.groupBy("file_path", "element").agg(
        F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("file_block_start", "seen", "value"))).alias("pieces")
    )
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), "}"), F.lit("}"))
    head = rf'(?s)^\s*\{{(?:{_PLAIN_FIELD})*+\s*"{field}"\s*:\s*\['
    text = F.regexp_replace(text, F.when(F.col("element") == 0, F.lit(head)).otherwise(F.lit(r"^\s*,")), F.lit(""))
    elements = whole.filter("ends = 1").select(F.ltrim(F.regexp_replace(text, r"^\s+", "")).alias("text"))
    sound = F.when(F.startswith("text", F.lit("{")), F.col("text")).otherwise(
        F.raise_error(F.lit(f"not an object of plain fields and one array {field}: read it with split=False"))
    )
    return elements.select(F.from_json(sound, kind, {"mode": "FAILFAST"}).alias("d"))
