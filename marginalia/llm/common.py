"""What the training-data operators share: row keys, written tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side up to which a broadcast is allowed; each caller counts first.
BROADCAST_ROWS = 50_000
#: Rows and bytes of a batch that goes to Python, at most; a row longer than that goes alone.
BATCH_ROWS, BATCH_BYTES = 2_000, 8_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    It is set here only where it is unset, and only for a session whose tasks
    run in the driver's own process, where a local folder is a shared one.
    """
    sc = spark.sparkContext
    got = sc.getCheckpointDir()
    if got:
        return got
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and is computed once.

    DataFrame.checkpoint() would compute a map-only frame twice (count, then
    write); a Parquet table is written in one pass and is compressed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once what was made of them is written itself."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; counts limit + 1 rows at most."""
    return df.limit(limit + 1).count() <= limit


def text_of(column: str = "text") -> Column:
    """A text column as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that extra ones can't clash with computed names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def slices(texts: list[str], budget: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about budget characters each; one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > budget:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def plain_bytes(setting: str) -> int:
    """A number of rows or bytes as settings spell it: 64m, 67108864b, 10000."""
    digits = setting.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)
    return int(digits.rstrip("kmgt")) << unit


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches bounded by rows and bytes, so that a worker's memory is.

    The bounds are settings of the session, read when the plan is made; smaller ones stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = plain_bytes(conf.get(key))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
