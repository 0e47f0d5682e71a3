"""Tables with a natural key as a base and deltas, merged when they are read.

Both lie in buckets by the hash of the key. A batch adds one delta of what it brings, and writes no more than that. The
last entry of a key counts, column by column, as a batch may bring only some columns. Buckets whose deltas have grown
beyond a share of their base are merged into a new base; the other buckets stay as they are.

What belongs to a table is a plain dictionary, which a commit keeps:

* ``buckets``: their number, fixed by the first batch;
* ``added``: the columns that batches added to those declared;
* ``base``: for each bucket its folder, the last batch it includes and its rows;
* ``deltas``: folder, batch, columns, rows by bucket. A delta counts in the buckets whose base does not include it.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from outpulse.sources import commits

BATCH, BUCKET = "_batch", "_bucket"
BUCKETS = 16
#: A bucket is merged when its deltas have this share of the rows of its base, or are this many.
MERGE_SHARE, MAX_DELTAS = 0.5, 8


def new(buckets: int = BUCKETS) -> dict:
    return {"buckets": buckets, "added": [], "base": {}, "deltas": []}


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _counts_in(meta: dict, delta: dict, bucket: str) -> bool:
    return bucket in delta["rows"] and delta["batch"] > meta["base"].get(bucket, {"batch": -1})["batch"]


def _columns(declared: StructType, meta: dict) -> list[StructField]:
    """The declared columns, then those that batches added."""
    added = [StructField.fromJson(field) for field in meta["added"]]
    return [*declared.fields, *[field for field in added if field.name not in declared.names]]


def _scan(spark: SparkSession, root: str, fields: list[StructField], places: list[str], only: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    found = spark.read.schema(StructType([*fields, StructField(BATCH, IntegerType())])).parquet(*[f"{root}/{p}" for p in places])
    # A few keys are looked for in each scan, before anything is merged.
    return found if only is None else found.join(only, list(keys), "left_semi")


def read(
    spark: SparkSession,
    root: str,
    meta: dict,
    declared: StructType,
    keys: Sequence[str],
    only: DataFrame | None = None,
    buckets: Iterable[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The table's rows; with ``only`` those of its keys, with ``buckets`` those in them, with ``columns`` no others.

    Buckets without deltas are read as they are. The entries of the other buckets are grouped by key.
    """
    fields = [f for f in _columns(declared, meta) if columns is None or f.name in columns]
    names = [f.name for f in fields]
    wanted = set(map(str, buckets)) if buckets is not None else {str(b) for b in range(meta["buckets"])}
    fresh = {b for d in meta["deltas"] for b in d["rows"] if b in wanted and _counts_in(meta, d, b)}
    still = [f"{v['folder']}/{BUCKET}={b}" for b, v in sorted(meta["base"].items()) if b in wanted - fresh]
    result = spark.createDataFrame([], StructType(fields))
    if still:
        result = _scan(spark, root, fields, still, only, keys).select(*names)
    if not fresh:
        return result
    # Entries by the columns that they bring: a base brings all.
    parts: dict[tuple[str, ...], list[str]] = {}
    for bucket in sorted(fresh & set(meta["base"])):
        parts.setdefault(tuple(names), []).append(f"{meta['base'][bucket]['folder']}/{BUCKET}={bucket}")
    for delta in meta["deltas"]:
        places = [f"{delta['folder']}/{BUCKET}={b}" for b in sorted(delta["rows"]) if b in fresh and _counts_in(meta, delta, b)]
        if places:
            parts.setdefault(tuple(n for n in names if n in delta["columns"]), []).extend(places)
    entries = None
    for number, (brought, places) in enumerate(parts.items()):
        scan = _scan(spark, root, [f for f in fields if f.name in brought], places, only, keys).withColumn("_part", F.lit(number))
        entries = scan if entries is None else entries.unionByName(scan, allowMissingColumns=True)
    # Columns that the same parts bring are taken together.
    taken: dict[tuple[int, ...], list[str]] = {}
    for name in names:
        if name not in keys:
            taken.setdefault(tuple(i for i, brought in enumerate(parts) if name in brought), []).append(name)
    last = []
    for number, (bringing, group) in enumerate(taken.items()):
        order = F.col(BATCH) if len(bringing) == len(parts) else F.when(F.col("_part").isin(*bringing), F.col(BATCH))
        last.append(F.max_by(F.struct(*group), order).alias(f"_last{number}"))
    grouped = entries.groupBy(*keys).agg(*last) if last else entries.select(*keys).distinct()
    merged = grouped.select(*keys, *[F.col(f"_last{i}").getField(n).alias(n) for i, group in enumerate(taken.values()) for n in group])
    return result.unionByName(merged.select(*names))


def _written(df: DataFrame, root: str, name: str, batch: int, keys: Sequence[str], buckets: int) -> tuple[str, dict[str, int]]:
    """The folder that ``df`` was written to, in buckets, and its rows by bucket. Large buckets become several files."""
    dealt = df.withColumn(BUCKET, _bucket(keys, buckets)).hint("rebalance", BUCKET)
    folder = commits.write_folder(dealt, root, name, batch, BUCKET)
    # One row a bucket.
    rows = df.sparkSession.read.schema(dealt.schema).parquet(f"{root}/{folder}").groupBy(BUCKET).count().collect()
    return folder, {str(r[0]): r[1] for r in rows}


def append(
    root: str, name: str, meta: dict, declared: StructType, rows: DataFrame, keys: Sequence[str], batch: int
) -> tuple[dict, dict[str, int]]:
    """The table with ``rows`` (a key at most once) as the delta of ``batch``, and how many keys are new and known.

    Only the keys of the touched buckets are read. A batch that is run again starts from what was before it.
    """
    spark = rows.sparkSession
    meta = copy.deepcopy(meta)
    folder, counts = _written(rows.withColumn(BATCH, F.lit(batch)), root, name, batch, keys, meta["buckets"])
    if not counts:
        return meta, {"inserted": 0, "updated": 0}
    written = spark.read.schema(rows.schema).parquet(f"{root}/{folder}").select(*keys)
    known = read(spark, root, meta, declared, keys, buckets=counts, columns=keys)
    inserted = written.join(known, list(keys), "left_anti").count()
    meta["added"] += [f.jsonValue() for f in rows.schema.fields if f.name not in {c.name for c in _columns(declared, meta)}]
    meta["deltas"].append({"folder": folder, "batch": batch, "columns": rows.columns, "rows": counts})
    # The first entries of a bucket are its base where they lie.
    for bucket in counts:
        if bucket not in meta["base"] and sum(_counts_in(meta, d, bucket) for d in meta["deltas"]) == 1:
            meta["base"][bucket] = {"folder": folder, "batch": batch, "rows": counts[bucket]}
    return _without_merged(meta), {"inserted": inserted, "updated": sum(counts.values()) - inserted}


def _without_merged(meta: dict) -> dict:
    """Deltas that no bucket needs are no longer named."""
    meta["deltas"] = [d for d in meta["deltas"] if any(_counts_in(meta, d, b) for b in d["rows"])]
    return meta


def due(meta: dict, share: float = MERGE_SHARE, max_deltas: int = MAX_DELTAS) -> list[str]:
    """The buckets whose deltas have grown too many."""
    found = []
    for bucket in map(str, range(meta["buckets"])):
        live = [d["rows"][bucket] for d in meta["deltas"] if _counts_in(meta, d, bucket)]
        base = meta["base"].get(bucket, {"rows": 0})["rows"]
        if live and (len(live) >= max_deltas or sum(live) >= share * base):
            found.append(bucket)
    return found


def compact(
    spark: SparkSession, root: str, name: str, meta: dict, declared: StructType, keys: Sequence[str], batch: int, buckets: Sequence[str]
) -> dict:
    """The table with ``buckets`` merged into a new base. No other bucket is read or written."""
    if not buckets:
        return meta
    meta = copy.deepcopy(meta)
    merged = read(spark, root, meta, declared, keys, buckets=buckets)
    folder, counts = _written(merged.withColumn(BATCH, F.lit(batch)), root, name, batch, keys, meta["buckets"])
    for bucket, rows in counts.items():
        meta["base"][bucket] = {"folder": folder, "batch": batch, "rows": rows}
    return _without_merged(meta)
