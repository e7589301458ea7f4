"""Parquet tables whose writes show all at once: new folders first, then a manifest that names the folders of the version.

A reader takes the newest manifest and reads the folders it lists, which no later write touches, so it sees one version however
long it runs. A writer that fails before its manifest leaves the version before it. Of two writers that start from one version the
second finds its number taken, throws its folders away and merges again on top of the first. The claim is a rename that must not
replace a file, which HDFS-like stores decide atomically; on a plain local folder two processes could still meet within one call.

Only the manifest (a few bytes per partition) passes through the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.readers import upsert_by_key

TRIES = 8  # merges of one write before it gives up to other writers
PLAIN = re.compile(r"[A-Za-z0-9_-]+")


@dataclass(frozen=True)
class Version:
    number: int
    schema: dict
    folders: dict[str, list[str]]  # by value of the partition column
    epochs: dict[str, int] = field(default_factory=dict)  # last batch of each named writer
    notes: dict[str, int] = field(default_factory=dict)  # what a writer keeps with its rows, such as a watermark


def _path(spark: SparkSession, *parts: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str) -> list[str]:
    path, fs = _path(spark, root, "_versions")
    names = [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(name for name in names if re.fullmatch(r"\d+\.json", name))


def _load(spark: SparkSession, root: str, name: str) -> Version:
    path, fs = _path(spark, root, "_versions", name)
    stream = fs.open(path)
    try:
        return Version(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest version, or None before the first write."""
    names = _manifests(spark, root)
    return _load(spark, root, names[-1]) if names else None


def _publish(spark: SparkSession, root: str, version: Version) -> bool:
    """Make `version` the newest one; False if its number is taken."""
    draft, fs = _path(spark, root, "_versions", f"draft-{uuid.uuid4().hex}")
    final, _ = _path(spark, root, "_versions", f"{version.number:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    if not fs.exists(final) and fs.rename(draft, final):
        return True
    fs.delete(draft, False)
    return False


def _rows(spark: SparkSession, root: str, version: Version, folders: Sequence[str]) -> DataFrame:
    return spark.read.schema(StructType.fromJson(version.schema)).parquet(*[f"{root}/{f}" for f in folders])


def read(spark: SparkSession, root: str, number: int | None = None, partitions: Sequence[str] | None = None) -> DataFrame:
    """Rows of the newest version or of version `number`, optionally of some partitions only (their folders alone are opened)."""
    version = current(spark, root) if number is None else _load(spark, root, f"{number:012d}.json")
    if version is None:
        raise ValueError(f"{root} has no version yet")
    folders = [f for value, some in sorted(version.folders.items()) if partitions is None or value in partitions for f in some]
    return _rows(spark, root, version, folders) if folders else spark.createDataFrame([], StructType.fromJson(version.schema))


def merge(
    spark: SparkSession, root: str, batch: DataFrame, partition: str, combine: Callable[[DataFrame, DataFrame], DataFrame] | None,
    writer: str = "", epoch: int = -1, notes: dict[str, int] | None = None,
) -> int | None:
    """Write a batch as the next version and return its number.

    `combine(old, batch)` gives the new rows of the partitions that the batch touches, from their old rows; None appends. The other
    partitions keep their folders. `partition` must be a function of the key that `combine` merges by; its values must be plain
    (letters, digits, `_`, `-`). Columns are matched by name, and must be those of the table. An empty batch is no version. A batch
    that a named writer has already committed (`epoch` not after its last) is passed over, so a replayed batch counts once.
    """
    batch = batch.persist()
    try:
        values = sorted((r[0] for r in batch.select(F.col(partition).cast("string")).distinct().collect()), key=str)
        if bad := [x for x in values if x is None or not PLAIN.fullmatch(x)]:
            raise ValueError(f"values of {partition} that cannot name a folder: {bad[:5]}")
        for _ in range(TRIES):
            base = current(spark, root)
            if not values or (base and writer and epoch <= base.epochs.get(writer, -1)):
                return base.number if base else None
            if base and set(batch.columns) != {f["name"] for f in base.schema["fields"]}:
                raise ValueError(f"columns of the batch are not those of {root}")
            old = [f for x in values for f in base.folders.get(x, [])] if base else []
            rows = combine(_rows(spark, root, base, old), batch) if combine and old else batch
            names = [f["name"] for f in base.schema["fields"]] if base else batch.columns
            data = f"data/{uuid.uuid4().hex}"
            folder, fs = _path(spark, root, data)
            done = False
            try:
                rows.select(*names, F.col(partition).cast("string").alias("_part")).write.partitionBy("_part").parquet(f"{root}/{data}")
                before = base.folders if base else {}
                fresh = {x: ([] if combine else before.get(x, [])) + [f"{data}/_part={x}"] for x in values}
                done = _publish(spark, root, Version(
                    (base.number if base else 0) + 1, base.schema if base else batch.schema.jsonValue(), {**before, **fresh},
                    {**(base.epochs if base else {}), **({writer: epoch} if writer else {})}, {**(base.notes if base else {}), **(notes or {})},
                ))
            finally:
                if not done:
                    fs.delete(folder, True)
            if done:
                return (base.number if base else 0) + 1
        raise RuntimeError(f"{root} was changed by other writers {TRIES} times in a row")
    finally:
        batch.unpersist()


def upsert(spark: SparkSession, root: str, batch: DataFrame, keys: Sequence[str], partition: str, writer: str = "", epoch: int = -1) -> int | None:
    """Replace the rows whose key is in `batch` (one row per key) and add the others, as one version."""
    return merge(spark, root, batch, partition, lambda old, new: upsert_by_key(old, new, keys), writer, epoch)


def expire(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Remove all versions but the newest `keep`, and the folders that only they name; how many went. Readers of those must be done."""
    if keep < 1:
        raise ValueError("at least one version must stay")
    names = _manifests(spark, root)
    gone, stay = names[:-keep], names[-keep:]
    folders = lambda some: {f for n in some for x in _load(spark, root, n).folders.values() for f in x}
    dead = folders(gone) - folders(stay)
    for parts in [("_versions", n) for n in gone] + [(f,) for f in sorted(dead)]:
        path, fs = _path(spark, root, *parts)
        fs.delete(path, True)
    return len(gone)
