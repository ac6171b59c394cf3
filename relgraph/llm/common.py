"""Helpers shared by the corpus operators: shared scratch space, ASCII case folding, byte tokenisers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.session import checkpoint_dir, reach

#: The white space of the contracts, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Java regular expression of a word between white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null document id; sorts after every real one.
NO_ID = 2**63 - 1

#: bytes -> bytes: A-Z lower-cased, every byte outside `[0-9a-z\x80-\xff]` a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def prepare(spark: SparkSession) -> None:
    """Sets a checkpoint folder where the cluster names none, and lets Python workers find this package."""
    checkpoint_dir(spark)
    reach(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    return checkpoint_dir(spark)


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/relgraph-{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder; lost executors don't lose them."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_with(df: DataFrame, value: Column) -> tuple[DataFrame, int]:
    """`kept`, and the sum of a value over the rows, observed on the way: no further job asks for it."""
    prepare(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.coalesce(F.sum(value.cast("long")), F.lit(0)).alias("sum")).checkpoint(eager=True)
    return out, int(seen.get["sum"])


def spared(docs: DataFrame, added: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` on documents whose own columns named like added ones are set aside; the result has the documents' columns."""
    own = {c: f"__own_{c}" for c in added if c in docs.columns}
    out = work(docs.withColumnsRenamed(own)).drop(*added)
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about `limit` bytes of text each; one long text stands alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty, without decoding them first."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, after the workers' path is set."""
    prepare(df.sparkSession)
    return df.mapInArrow(function, schema)
