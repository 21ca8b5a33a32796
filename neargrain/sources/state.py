"""What tells whether saved tables are whole and belong together: fingerprints and manifests."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"


class StaleState(ValueError):
    """Saved tables that are incomplete, or were made from other inputs or with other settings."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fingerprint(rows: DataFrame) -> str:
    """Tells tables apart: by names, sizes and times of the files that they are read from, or by a sum
    over all rows where they come from no file."""
    spark, parts = rows.sparkSession, [rows.schema.simpleString()]
    for path in sorted(rows.inputFiles()):
        fs, place = _place(spark, path)
        status = fs.getFileStatus(place)
        parts.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    if len(parts) == 1:
        r = rows.select(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
        parts.append(str(tuple(r)))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def drop_manifest(spark: SparkSession, folder: str) -> None:
    """From here on the folder is incomplete."""
    fs, place = _place(spark, f"{folder}/{MANIFEST}")
    fs.delete(place, False)


def write_manifest(spark: SparkSession, folder: str, content: dict) -> None:
    """Says that a folder is complete. The file appears whole: it is written under another name and moved."""
    fs, place = _place(spark, f"{folder}/{MANIFEST}")
    _, new = _place(spark, f"{folder}/_manifest-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(new, place):
        raise OSError(f"the manifest of {folder} couldn't be moved into place")


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """None for a folder that isn't complete."""
    fs, place = _place(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
