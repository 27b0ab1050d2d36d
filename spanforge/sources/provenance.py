"""Small JSON side files in any store that Spark writes, and the headers of tensor files."""

from __future__ import annotations

import json
import math
import struct
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def read_provenance(spark: SparkSession, path: str) -> dict | None:
    """The record, or None where there is none."""
    fs, p, jvm = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_provenance(spark: SparkSession, path: str, record: dict) -> None:
    """Written beside and moved into place, so a reader sees the old record or the new one."""
    fs, p, jvm = _at(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(json.dumps(record, indent=2, sort_keys=True).encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} was not written")


#: What must be equal for a sparse index to be used with a knowledge base.
FIELDS = ("settings", "icd_snapshot", "rxnorm_snapshot", "document_checksum", "row_order_checksum", "rows")


def assert_compatible(recorded: dict, present: dict) -> None:
    problems = [f for f in FIELDS if recorded.get(f) != present.get(f)]
    if problems:
        raise ValueError(f"the recorded sparse index is of another knowledge base: {', '.join(problems)}")


def model_manifest(spark: SparkSession, path: str) -> list[dict]:
    """The models of a manifest: a JSON object with a list `models`, or the list alone."""
    found = read_provenance(spark, path)
    return [] if found is None else found.get("models", []) if isinstance(found, dict) else found


def tensor_parameters(spark: SparkSession, folder: str) -> int:
    """The number of parameters in all *.safetensors files below a folder; only their headers are read."""
    fs, p, jvm = _at(spark, folder)
    files, total = fs.listFiles(p, True), 0
    while files.hasNext():
        file = files.next().getPath()
        if not file.getName().endswith(".safetensors"):
            continue
        stream = fs.open(file)
        try:
            take = lambda n: bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))  # noqa: B023, E731
            header = json.loads(take(struct.unpack("<Q", take(8))[0]))
        finally:
            stream.close()
        total += sum(math.prod(t["shape"]) for name, t in header.items() if name != "__metadata__")
    return total
