"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written

#: Fixed by the contracts: ASCII white space, and what separates words of the alphanumeric kind.
WS_RE = r"[\x20\x09-\x0D]+"
SEP_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id where ids are compared: such rows are one document that sorts last.
NO_ID = 2**63 - 1
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cuts lineage with a written table in the shared folder.
checkpointed = written


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    return F.filter(F.split(text, separators), lambda w: w != "")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Tells apart rows that share an id but not a text; identical rows share a key."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__text_key")]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads; whatever else the table holds cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Rows of an Arrow batch at most: texts are large, and a worker holds a batch several times over.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in an Arrow batch to ``BATCH_ROWS``, where it is higher; a lower one stays."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def map_texts(docs: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[list[str | None]], list]], text_col: str = "text") -> DataFrame:
    """Adds columns computed from the text by Python, in Arrow batches.

    ``make()`` runs once a task and returns a function from a list of texts to one list or
    Arrow array for each field. The row itself travels untouched in a struct, so any names may occur in it.
    """
    small_batches(docs.sparkSession)
    # The text goes to Python once, within its row, unless it has to be cast.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    inside = docs.columns.index(text_col) if isinstance(docs.schema[text_col].dataType, T.StringType) else None
    if inside is None:
        row = row.withColumn("text", F.col(f"row.`{text_col}`").cast("string"))
    out = T.StructType([row.schema["row"], *fields])
    kinds = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            work = work or make()
            texts = batch.column("text") if inside is None else batch.column("row").field(inside)
            got = work(texts.to_pylist())
            arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=out.names)

    return row.mapInArrow(run, out)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def unpack_row(df: DataFrame, *more: str) -> DataFrame:
    """The columns of the original row, then the added ones named in ``more``."""
    return df.select("row.*", *more)


#: Rows of a looked-up side that is broadcast, after its rows were counted.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than one in so many of the rows; no more keys than that can.
HOT_KEYS = 10_000


def look_up(rows: DataFrame, found: DataFrame, key: str, value: str, salt: list[str], most: int = BROADCAST_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the ``value`` that ``found`` (key, value, n) has for their key, else null; ``n`` is how many rows have the key. No key is null.

    A ``found`` of few rows is broadcast. Of a larger one only hot keys are; their rows then take no part in the
    shuffle by key: they go wherever their salted key, which nothing equals, sends them.
    """
    found = found.select(key, value, "n")
    size, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size <= most:
        return rows.join(F.broadcast(found.drop("n")), key, "left")
    is_hot = F.col("n") * hot_keys > total
    hot = found.where(is_hot).select(F.col(key).alias("__hot"), F.col(value).alias("__value"))
    cold = found.where(~is_hot).select(F.struct(F.col(key).alias("k"), F.lit(-1).cast("long").alias("salt")).alias("__key"), value)
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    at = F.struct(F.col(key).alias("k"), F.when(F.col("__hot").isNull(), F.lit(-1)).otherwise(F.abs(F.xxhash64(*salt) % 4096)).cast("long").alias("salt"))
    out = marked.withColumn("__key", at).join(cold, "__key", "left")
    return out.select(*rows.columns, F.coalesce("__value", value).alias(value))
