"""A folder as entries. Spark's own file sources leave out empty files and directories."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

ENTRY = "path string, dir boolean, size long, mtime timestamp_ntz"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, dir, size, mtime) of all below root, paths relative to it, times cut to the second; names that begin with a dot or an underscore are left out.

    Any file system that Spark reads. The listing itself is the driver's work, as it is for every file source; no file is opened.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    files, out, todo = top.getFileSystem(conf), [], [("", top)]
    while todo:
        above, folder = todo.pop()
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name[:1] in "._":
                continue
            second = datetime.datetime.fromtimestamp(status.getModificationTime() // 1000, datetime.UTC).replace(tzinfo=None)
            out.append((above + name, bool(status.isDirectory()), 0 if status.isDirectory() else int(status.getLen()), second))
            if status.isDirectory():
                todo.append((above + name + "/", status.getPath()))
    return spark.createDataFrame(out, ENTRY)
