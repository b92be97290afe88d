"""Change feeds: signals from landed notifications, coalescing, debouncing, late changes as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.shared import saved, shared_folder

NOTICE = "Records array<struct<s3: struct<object: struct<key: string>>>>"


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stream of the Parquet at path, a file or a folder; a pattern, as a stream's own path has to be a folder."""
    kind = spark.read.parquet(path).schema if schema is None else schema
    return spark.readStream.schema(kind).parquet(f"{path}*")


def signals(notices: DataFrame, prefix: str, column: str = "body") -> DataFrame:
    """(key) of each record of each notification whose key has the prefix; what isn't valid JSON is dropped."""
    keys = notices.select(F.explode(F.from_json(column, NOTICE)["Records"]).alias("r")).select(F.col("r.s3.object.key").alias("key"))
    return keys.where(F.col("key").startswith(prefix))


def source(log: DataFrame, prefix: str, wanted: Column | None = None) -> DataFrame:
    """(key): a source of signals from a landed log of changes: those below a prefix, and of the kinds wanted if given.

    The log may be a stream, whose own checkpoint then is the cursor, or a table. Filters reach the scan.
    """
    rows = log.where(F.col("key").startswith(prefix))
    return (rows if wanted is None else rows.where(wanted)).select("key")


def coalesced(keys: DataFrame, label: str) -> DataFrame:
    """(burst, key): each burst, that is each micro-batch, as one signal for a key; a later one wakes it again.

    No state is kept. A batch that runs again after a failure overwrites what it wrote.
    """
    spark = keys.sparkSession
    out = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    drained(keys, label, each=lambda df, n: df.select("key").distinct().write.mode("overwrite").parquet(f"{out}/burst={n}"))
    kind = keys.select("key").schema["key"].dataType.simpleString()
    return spark.read.schema(f"key {kind}, burst long").option("basePath", out).parquet(f"{out}/burst=*")


def debounced(marks: DataFrame, gap: int = 1_000_000) -> DataFrame:
    """(key, sent): when a key's marks (key, at) are passed on: at once, then at most one each ``gap`` microseconds.

    Every mark is followed by a sending at or after it, so the last one is never lost. Streaming; the state of a key is
    the time of its last sending, which may be still to come. A key's marks arrive in the order of at.
    """
    kind = marks.schema["key"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, sent = state.get[0] if state.exists else None, []
        for at in sorted(int(x) for frame in frames for x in frame["at"]):
            if last is None or at > last:
                last = at if last is None else max(at, last + gap)
                sent.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(sent), "sent": sent}).astype({"sent": "int64"})

    return marks.groupBy("key").applyInPandasWithState(step, f"key {kind}, sent long", "last long", "append", "NoTimeout")


def fanned_out(keys: DataFrame, readers: dict[str, int | None], label: str) -> DataFrame:
    """(reader, key): what each reader of a source gets of each burst (key, cursor): all, or the first as many as its buffer holds.

    A buffer is small; what doesn't fit is dropped for that reader alone, and the others never wait for it.
    """
    spark = keys.sparkSession
    out = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def pass_on(df: DataFrame, n: int) -> None:
        for name, most in readers.items():
            got = df if most is None else df.orderBy("cursor").limit(most)
            got.select("key").write.mode("overwrite").parquet(f"{out}/reader={name}/burst={n}")

    drained(keys, label, each=pass_on)
    kind = keys.select("key").schema["key"].dataType.simpleString()
    return spark.read.schema(f"key {kind}, reader string").option("basePath", out).parquet(f"{out}/reader=*/burst=*").select("reader", "key")


class Cursor:
    """The place up to which a change feed has been read, kept in the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{label}-cursor-{uuid.uuid4().hex}"
        self.saves = 0

    def get(self) -> int | None:
        if not self.saves:
            return None
        return self.spark.read.schema("cursor long").parquet(f"{self.path}/{self.saves}").first()[0]

    def put(self, value: int) -> None:
        """A new file for each value: a reader never meets half of one."""
        self.spark.createDataFrame([(value,)], "cursor long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.saves + 1}")
        self.saves += 1


def since(log: DataFrame, cursor: Cursor) -> DataFrame:
    """What a log (key, cursor) has past the stored cursor, which moves on once that is written: replays are possible, gaps aren't."""
    start = cursor.get()
    new = saved(log if start is None else log.where(F.col("cursor") > start), "feed")
    if (last := new.agg(F.max("cursor")).first()[0]) is not None:
        cursor.put(last)
    return new


def drained(stream: DataFrame, label: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over what there is now and read what it wrote; offsets and output lie in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/offsets").outputMode(mode).trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def late_changes(changes: DataFrame) -> DataFrame:
    """(folder, seq, at, until) of each change dated behind its folder's newest state: streaming, one number of state a folder.

    changes: (folder, seq, at), at in microseconds, each folder's in the order of seq over and within micro-batches. The
    newest state stays: a late change is written into the present.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, at in zip(rows["seq"], rows["at"]):
            if newest is not None and at < newest:
                out.append((key[0], seq, at, newest))
            else:
                newest = int(at)
        state.update((newest,))
        yield pd.DataFrame(out, columns=["folder", "seq", "at", "until"])

    return changes.groupBy("folder").applyInPandasWithState(step, "folder long, seq long, at long, until long", "newest long", "append", "NoTimeout")


def refused(changes: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) where late changes aren't taken."""
    return changes.join(late.select("seq"), "seq", "left_anti"), changes.join(late.select("seq"), "seq", "left_semi")


def dated(rows: DataFrame, carried: Column) -> DataFrame:
    """Undated versions take the time that they carry; undatable ones are marked."""
    return rows.withColumn("at", F.coalesce("at", carried)).withColumn("undatable", F.col("at").isNull())


def unfinished(rows: DataFrame, complete: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Versions in no complete record that are older than some minutes, unless they are their key's only version."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    old = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_modified").cast("timestamp")) > minutes * 60_000_000
    return rows.where(old).join(complete, ["key", "seq"], "left_anti").join(counts.where("n > 1"), "key", "left_semi")
