"""What the operators of this subpackage share: row numbers, written intermediate tables, Arrow columns."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outpulse.session import work_dir

ROW = "row_no"
#: Bits of a row number for the place in the file; those above are for the file.
FILE_BITS = 40

#: A table of at most this many numbers or short strings may be broadcast.
BROADCAST_ROWS = 1_000_000


_shipped: set[str] = set()


#: Rows and bytes that a Python worker gets at a time. Whole documents are long rows; one longer than this comes alone.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that their Python workers can import it, and bounds their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="outpulse-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as code:
        for file in sorted(package.rglob("*.py")):
            code.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a number per row, so that rows with the same or no id stay apart.

    The number is made of the file's place among the sorted paths and the row's place in the file. No job that scans
    the files anew changes it, however it splits them. ``df`` must be a scan of Parquet files, or narrow steps on one.
    """
    where = df.metadataColumn("_metadata")
    placed = df.select("*", where["file_path"].alias("scanned_file"), where["row_index"].alias("row_in_file"))
    # Asked of the scan, as other lists of files write paths with special characters otherwise. It reads no column.
    paths = sorted(r[0] for r in df.select(where["file_path"]).distinct().collect())
    listed = pa.table({"scanned_file": pa.array(paths, pa.string()), "file_no": pa.array(range(len(paths)), pa.int64())})
    placed = placed.join(F.broadcast(df.sparkSession.createDataFrame(listed)), "scanned_file", "left")
    # A path that is not listed would leave rows without a number.
    file_no = F.coalesce("file_no", F.raise_error(F.lit("a scanned file is not listed")).cast("bigint"))
    number = F.shiftleft(file_no, FILE_BITS).bitwiseOR(F.col("row_in_file"))
    return placed.withColumn(ROW, number).drop("scanned_file", "row_in_file", "file_no")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="outpulse-")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors reach. A temporary one only where none is set and executors
    run on this machine; elsewhere the setting is asked for."""
    return work_dir(spark, _own_folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, which computes it once and cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def light(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast while it is small. Otherwise it is shuffled by itself, so that Spark
    can split the frequent keys of what it is joined with."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without_rows(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """``df`` without the row numbers of ``dropped`` (a written table): broadcast while it is small, else a shuffled join."""
    return df.join(light(dropped), ROW, "left_anti")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]
