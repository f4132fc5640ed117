"""What the operators of this subpackage share.

Conventions: an operator selects the columns it needs under names of its own as its first
step, so extra input columns, whatever their names, never clash. A null text is an empty one.
A null document id stands for one document after all others (``LAST_ID`` inside the
operators, null again in results). Tables derived on the way are written to the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.session import stored  # noqa: F401 - for the operators

LAST_ID = 2**63 - 1
SPACE = "[^\\x20\\x09-\\x0D]+"

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, with its SQL twin if there is one."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def id_back(name: str = "id") -> Column:
    return F.when(F.col(name) != LAST_ID, F.col(name))


def plain_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def segments(raw: bytes, size: int = 1 << 20):
    """``raw`` in pieces of about ``size`` bytes, cut at spaces only."""
    at = 0
    while len(raw) - at > size:
        cut = raw.rfind(b" ", at, at + size)
        cut = cut if cut >= 0 else raw.find(b" ", at + size)
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut + 1
    yield raw[at:]


def slices(batches, text: str | None = None, size: int = 8 << 20):
    """The rows of Arrow batches in slices of about ``size`` bytes of the column ``text`` (none: of all).

    Spark sends batches of up to 64 MB; what a task makes of one at a time stays a fraction of it.
    """
    for batch in batches:
        column = batch if text is None else batch.column(text)
        if column.nbytes <= size:
            if batch.num_rows:
                yield batch
            continue
        rows, at = max(1, batch.num_rows * size // column.nbytes), 0
        while at < batch.num_rows:
            yield batch.slice(at, rows)
            at += rows


def texts_in(batch, inside: int | None) -> list[str]:
    """The texts of a batch: its column ``text``, or that field of its column ``row``; null is empty."""
    column = batch.column("text") if inside is None else batch.column("row").field(inside)
    return [t or "" for t in column.to_pylist()]
