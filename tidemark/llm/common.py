"""What the text operators share: folders for written tables, folds, words and stable hashes."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that part words: space and U+0009 to U+000D. ``bytes.split()`` parts at just these.
SEPARATORS = " \t\n\x0b\x0c\r"

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, str] = {}
#: Spark's setting that shuffle files of a query go once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; an own folder only where that is unset and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_DIRS[app]


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files that led to it go as soon as it is there, rather than when the driver next collects its garbage.
    """
    spark, name = df.sparkSession, f"{label}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _WRITTEN[name] = path
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more; other tables are left alone."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in {file.rsplit("/", 2)[-2] for file in df.inputFiles()}:
        if (folder := _WRITTEN.pop(name, None)) is not None:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def sample_below(df: DataFrame, keep: int, total: int, *keys: Column) -> DataFrame:
    """About keep of total rows, the same ones each time: those whose hash is below a fraction of its range."""
    if total <= keep:
        return df
    share = int(2**32 * keep / total)
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(2**32)) < share)


class WordHashes(dict):
    """A word's 64-bit hash, remembered for at most ``most`` words."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def stable_hash(word: str, bits: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def rows_of(batch: pa.RecordBatch, at_once: int = 128) -> Iterator[tuple]:
    """The rows of a batch as Python values, few at a time: a batch may hold many megabytes of text."""
    for start in range(0, batch.num_rows, at_once):
        yield from zip(*(c.to_pylist() for c in batch.slice(start, at_once).columns))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on batches: texts are long, and thousands of them at once cost each task tens of MB.

    Arrow batches, else of up to 64 MB outside the heap, and the Parquet reader's vectors, else of 4,096 rows.
    """
    for key, most in (("execution.arrow.maxBytesPerBatch", 4 << 20), ("execution.arrow.maxRecordsPerBatch", 2000), ("parquet.columnarReaderBatchSize", 256)):
        now = int(str(spark.conf.get(f"spark.sql.{key}")).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.{key}", str(most))


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], tuple]], schema: str, rows_out: int = 512) -> DataFrame:
    """Map each row through a function that ``make`` builds once in each task; results leave in small batches."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held = make(), []
        for batch in batches:
            for row in rows_of(batch):
                held.append(f(row))
                if len(held) >= rows_out:
                    yield _batch(held, arrow)
                    held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def flat_map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], list[tuple]]], schema: str, rows_out: int = 4096) -> DataFrame:
    """As map_rows, for a function that returns any number of rows for each."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held = make(), []
        for batch in batches:
            for row in rows_of(batch):
                held.extend(f(row))
                while len(held) >= rows_out:
                    yield _batch(held[:rows_out], arrow)
                    held = held[rows_out:]
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)
