"""What the operators of this subpackage share: the registry, word counting in SQL, joins behind a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LLM_QUERIES: dict = {}
LLM_ORACLE: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the six ASCII spaces, and a pattern for a run of them
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"

#: a relation of at most this many rows may be broadcast (about 40 bytes a row in memory)
BROADCAST_ROWS = 1_000_000


#: rows in an Arrow batch of texts: a few MB as a rule, so that a worker holds little at a time
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches are held to BATCH_ROWS rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn

    return register


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def stripped(col: Column) -> Column:
    """Without the six ASCII spaces at both ends."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def word_list(text: Column) -> Column:
    """Words between ASCII spaces; null and blank texts have an empty list."""
    core = stripped(F.coalesce(text, F.lit("")))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RUN))


def small_side(table: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` marked for broadcast if its counted rows are within the bound; otherwise the planner shuffles."""
    return F.broadcast(table) if rows <= limit else table


def row_key(key: str, text: str) -> list[Column]:
    """Columns that tell rows apart where the key may be null or repeated: equal pairs are equal rows for every operator here."""
    return [F.xxhash64(F.lit("row"), F.col(key).cast("string"), F.col(key).isNull()).alias("__k"), F.xxhash64(F.lit("text"), F.col(text)).alias("__t")]
