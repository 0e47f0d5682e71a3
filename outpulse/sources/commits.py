"""What is live: one small file per batch, written last, that names the folders a reader may read.

A run writes folders of its own first. Nothing points to them until its commit is renamed into place, which a file system
does wholly or not at all. A run that dies before leaves folders that nobody reads; one that is repeated writes new folders
and puts its commit in the place of the old one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

FOLDER = "_commits"
BATCH_FOLDER = "batch="


def _path(root: str, log: str, batch: int) -> str:
    return f"{root}/{FOLDER}/{log}/{batch:010d}.json"


def read(spark: SparkSession, root: str, log: str, batch: int) -> dict:
    """The commit of a batch. Batches count from zero; before that nothing is live.

    A batch that is missing is an error: going on from nothing would lose what was known.
    """
    if batch < 0:
        return {}
    return json.loads(spark.read.text(_path(root, log, batch), wholetext=True).first()[0])


def last_batch(spark: SparkSession, root: str, log: str) -> int:
    """The number of the last committed batch, -1 before any."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/{FOLDER}/{log}/*.json").select("path").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    # One file a batch.
    return max((int(row[0].rsplit("/", 1)[1].split(".")[0]) for row in files), default=-1)


def latest(spark: SparkSession, root: str, log: str) -> dict:
    return read(spark, root, log, last_batch(spark, root, log))


def commit(spark: SparkSession, root: str, log: str, batch: int, content: dict) -> None:
    """Make ``content`` what is live after ``batch``, at once."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs
    final = hadoop.Path(_path(root, log, batch))
    draft = hadoop.Path(f"{root}/{FOLDER}/{log}/.draft-{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    stream = final.getFileSystem(conf).create(draft)
    stream.write(json.dumps(content, sort_keys=True).encode())
    stream.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    # Unlike the file system's own rename, this one is told to replace, and fails instead of answering false.
    hadoop.FileContext.getFileContext(jvm.java.net.URI(final.toString()), conf).rename(draft, final, options)


def write_folder(df: DataFrame, root: str, name: str, batch: int, *partition_by: str) -> str:
    """``df`` in a folder of its own below the batch; returns its path relative to ``root``. Not live until committed."""
    folder = f"{name}/{BATCH_FOLDER}{batch}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{root}/{folder}")
    return folder


def _named(content: object) -> set[str]:
    """All folders that a commit names, wherever in it they stand."""
    if isinstance(content, str):
        return {content} if f"/{BATCH_FOLDER}" in content else set()
    values = content.values() if isinstance(content, dict) else content if isinstance(content, list) else ()
    return set().union(*map(_named, values))


def expire(spark: SparkSession, root: str, log: str, names: Sequence[str], keep: int) -> list[str]:
    """Delete what no reader of the last ``keep`` batches of a log can reach, and the commits before these.

    ``names`` are the tables that the log tells of. Folders of the last batch and later are left alone, as a run may be
    writing them. Returns the deleted folders, relative to ``root``.
    """
    last = last_batch(spark, root, log)
    first = max(0, last - keep + 1)
    live = set().union(*(_named(read(spark, root, log, batch)) for batch in range(first, last + 1)))
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files = hadoop.Path(root).getFileSystem(conf)
    deleted = []
    for name in names:
        for found in files.globStatus(hadoop.Path(f"{root}/{name}/{BATCH_FOLDER}*/*")) or ():
            folder, batch = found.getPath().getName(), found.getPath().getParent().getName()
            place = f"{name}/{batch}/{folder}"
            if place not in live and int(batch.removeprefix(BATCH_FOLDER)) < last:
                files.delete(found.getPath(), True)
                deleted.append(place)
    for batch in range(first):
        files.delete(hadoop.Path(_path(root, log, batch)), False)
    return sorted(deleted)
