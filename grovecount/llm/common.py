"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecount.plans.lineage import RoundTables
from grovecount.session import ensure_checkpoint_dir

# ASCII white space that separates words, and its complement
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` only: other columns never travel, null text becomes empty."""
    return docs.select(
        docs[id_col].cast("long").alias("id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def bare_words(text: Column) -> Column:
    """Words of a text column: maximal runs of non-blank characters."""
    return F.filter(F.split(text, BLANK + "+", -1), lambda w: w != "")


def same_row(docs: DataFrame, id_col: str, text_col: str, decided: DataFrame) -> Column:
    """Join condition between rows of ``docs`` and decisions keyed by ``id`` and
    ``text_hash``: rows that repeat an id are told apart by their text."""
    return docs[id_col].cast("long").eqNullSafe(decided["id"]) & (text_hash(docs[text_col]) == decided["text_hash"])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sorted_places(df: DataFrame, order: list, rounds: RoundTables, name: str) -> DataFrame:
    """``df`` plus ``part`` and ``at``: the place of each row in a distributed
    sort, stored so that places never change between uses."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of a row counts from 0 in its partition, in order of the sort
    dealt = dealt.withColumn("serial", F.monotonically_increasing_id())
    dealt = dealt.withColumns({
        "part": F.shiftright("serial", 33).cast("int"), "at": F.col("serial").bitwiseAND((1 << 33) - 1)
    }).drop("serial")
    return rounds.write(dealt, name)


FILE_ROWS = 250_000


class Stored:
    """Tables of one run of a loop, as Parquet in the shared checkpoint folder:
    survive lost executors, and a loop that appends to a table and reads it
    again keeps its plan as small as in its first round."""

    def __init__(self, spark, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame, name: str, rows: int) -> DataFrame:
        """Append ``df``, of at most ``rows`` rows, to table ``name``; the whole
        table.  Files hold up to ``FILE_ROWS`` rows, so that a loop of many small
        rounds does not leave thousands of files to read again."""
        path = f"{self.root}/{name}"
        df.coalesce(max(8, -(-rows // FILE_ROWS))).write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
