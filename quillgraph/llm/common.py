"""What the operators share: the folder for written tables, row keys and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    if not _OWN_FOLDER:
        folder = tempfile.TemporaryDirectory(prefix="quillgraph-")
        atexit.register(folder.cleanup)
        _OWN_FOLDER.append(f"file://{folder.name}")
    return _OWN_FOLDER[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until ``discard`` or the folder's own retention removes it, since results are read from it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillgraph_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quillgraph_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that ``hot_join`` broadcasts, at most.
HOT_KEYS = 5_000


def hot_join(rows: DataFrame, side: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, one row a key, whose column ``size`` counts the key's rows among ``total``.

    Keys with more than a HOT_KEYS-th of all rows, which number HOT_KEYS at most, are broadcast, so that no key that
    fills a task is shuffled; the others are joined by a shuffle.
    """
    is_hot = F.col(size) * HOT_KEYS > total
    hot, cool = side.where(is_hot).drop(size), side.where(~is_hot).drop(size)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key))


def crc_rest(column: str, modulus: int):
    """crc32 of the column as text, modulo ``modulus``; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Rows of a batch that are Python objects at one time.
SLICE_ROWS = 256


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, without copying: only a slice's texts become Python strings at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def text_udf(use: Callable[[list[str | None]], list], sql_type: str, arrow_type: pa.DataType) -> Callable:
    """A column function of texts by Arrow batches, slice by slice."""

    @F.arrow_udf(sql_type)
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array(use(texts.slice(i, SLICE_ROWS).to_pylist()), arrow_type) for i in range(0, len(texts), SLICE_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow_type)

    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )
