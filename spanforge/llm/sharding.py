"""Sharding by a Hilbert curve: quantise several metadata dimensions, sort by curve index, cut equal runs.

Law `rows`: shard sizes differ by one row at most. Rows that are near in every dimension (place in the id range, text
size, source, language) get near curve indexes, so each shard, and each file of it, covers a small box of metadata and
a reader can skip it by its minima and maxima.

First only ids and numbers are sorted along the curve and counted, which gives the bounds of as many ranges as there
are partitions and the rank at which each begins. Then whole rows go to their range in one shuffle, are sorted there,
and are written as files of their shard: a row's rank is that of its range and its place in it.

Defined results: a null text has size 1 and crc 0; null source or language count as one value of their own; a null
doc_id sorts first; repeated rows each get their own slot (rows with equal keys are in one range); an empty table gives
no rows and no files; extra columns of any name stay in the files, beside the columns that write_shards() returns the
names of.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, partitions, table

#: Bits for each dimension; the index has BITS * dimensions bits.
BITS = 10
#: Bytes of text in one range, about.
RANGE_BYTES = 64 << 20


def hilbert_index(dims: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points whose coordinates are below 2**bits (transpose form, then interleaved)."""
    x = [np.array(d, np.int64) for d in dims]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


@F.pandas_udf(T.LongType())
def _index(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([v.to_numpy() for v in (a, b, c, d)]))


def _fresh(df: DataFrame, name: str) -> str:
    """name, or the first variant of it that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _key(docs: DataFrame) -> Column:
    """What rows are sorted by: the curve, then doc_id (nulls first), size and crc of the text."""
    side = 1 << BITS
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    least, span = least or 0, (most or 0) - (least or 0) + 1
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = (F.length(text) + F.lit(1)).cast("long")
    place = F.coalesce(F.floor((F.col("doc_id") - F.lit(least)).cast("double") * (side - 1) / F.lit(float(span))), F.lit(0)).cast("long")
    wide = F.least(F.lit(side - 1), F.floor(F.log2(size) * F.lit(side / 40))).cast("long")
    curve = _index(place, wide, F.pmod(F.xxhash64("source"), F.lit(side)), F.pmod(F.xxhash64("lang"), F.lit(side)))
    return F.struct(curve.alias("curve"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), size.alias("size"), F.crc32(text).alias("crc"))


_KEYS = ("curve", "known", "id", "size", "crc")


def _ranges(spark: SparkSession, keys: DataFrame) -> list[tuple[tuple, int, int]]:
    """(least key, number of rows before it, number of rows) of each range; keys: a column k.

    There are so many ranges that one holds about RANGE_BYTES of text; what the driver and the tasks hold is one key each.
    """
    scratch = Scratch(spark, "hilbert")
    rows = keys.select(*[F.col(f"k.{c}").alias(c) for c in _KEYS])
    n = max(partitions(spark), -(-(rows.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES))
    rows = scratch.table(rows.repartitionByRange(n, *_KEYS).withColumn("p", F.spark_partition_id()), "keys")
    found = sorted((tuple(r["least"]), r["n"]) for r in rows.groupBy("p").agg(F.min(F.struct(*_KEYS)).alias("least"), F.count("*").alias("n")).collect())
    scratch.drop()
    out, total = [], 0
    for least, n in found:
        out.append((least, total, n))
        total += n
    return out


def write_shards(spark: SparkSession, docs: DataFrame, path: str, n_shards: int = 8) -> tuple[str, str]:
    """Write docs(doc_id, text, source, lang, ...) to path, a folder a shard, sorted along the curve; names of the columns
    of the shard (which the folders are named by) and of the slot."""
    shard_name, slot_name = _fresh(docs, "shard"), _fresh(docs, "slot")
    rows = docs.select(F.struct(*docs.columns).alias("row"), _key(docs).alias("k"))
    ranges = _ranges(spark, rows.select("k"))
    if not ranges:
        return shard_name, slot_name
    total = ranges[-1][1] + ranges[-1][2]
    least = spark.sparkContext.broadcast([r[0] for r in ranges])
    before = spark.sparkContext.broadcast(np.array([r[1] for r in ranges], np.int64))

    @F.pandas_udf(T.IntegerType())
    def part_of(curve: pd.Series, known: pd.Series, id: pd.Series, size: pd.Series, crc: pd.Series) -> pd.Series:
        keys = zip(curve.tolist(), known.tolist(), id.tolist(), size.tolist(), crc.tolist(), strict=True)
        return pd.Series([max(0, bisect.bisect_right(least.value, k) - 1) for k in keys], dtype="int32")

    @F.pandas_udf(T.LongType())
    def rows_before(part: pd.Series) -> pd.Series:
        return pd.Series(before.value[part.to_numpy()])

    rows = rows.withColumn("part", part_of(*[F.col(f"k.{c}") for c in _KEYS]))
    rows = rows.repartitionById(len(ranges), F.col("part")).sortWithinPartitions("part", "k")
    rows = rows.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    few, extra = divmod(total, n_shards)
    cut = extra * (few + 1)
    rank = F.col("rank")
    shard = F.when(rank < cut, F.floor(rank / F.lit(few + 1))).otherwise(F.lit(extra) + F.floor((rank - F.lit(cut)) / F.lit(max(few, 1)))).cast("int")
    rows = rows.withColumn("rank", rows_before("part") + F.col("at")).withColumn("n", shard)
    first = F.when(F.col("n") < extra, F.col("n") * F.lit(few + 1)).otherwise(F.lit(cut) + (F.col("n") - extra) * F.lit(few))
    # the rows of a range are in order, so writing them by shard needs no more sorting
    rows = rows.select("row.*", (F.col("rank") - first).cast("long").alias(slot_name), F.col("n").alias(shard_name))
    rows.write.mode("overwrite").partitionBy(shard_name).parquet(path)
    return shard_name, slot_name


def boxes(files: DataFrame) -> DataFrame:
    """Of each file of a data set (doc_id, text, source, lang) what its statistics say: rows, minima and maxima."""
    rows = files.select(F.input_file_name().alias("file"), "doc_id", F.length("text").alias("size"), "source", "lang")
    sides = [f(c).alias(f"{name}_{c}") for c in ("doc_id", "size", "source", "lang") for name, f in (("least", F.min), ("most", F.max))]
    return rows.groupBy("file").agg(F.count("*").alias("n"), *sides)


def read_files(box: DataFrame, **wanted) -> tuple[int, int]:
    """(files whose boxes can hold a row of the wanted values, all files). wanted: column=(least, most)."""
    inside = [(F.col(f"most_{c}") >= F.lit(lo)) & (F.col(f"least_{c}") <= F.lit(hi)) for c, (lo, hi) in wanted.items()]
    return tuple(box.agg(F.coalesce(F.sum(reduce(Column.__and__, inside).cast("long")), F.lit(0)), F.count("*")).first())


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the files that write_shards() wrote."""
    docs, path = table(spark, sf_dir, "documents"), Scratch(spark, "shards").base
    shard, slot = write_shards(spark, docs, path)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = spark.read.schema(schema).parquet(path) if not docs.isEmpty() else spark.createDataFrame([], schema)
    return files.select("doc_id", (F.length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
