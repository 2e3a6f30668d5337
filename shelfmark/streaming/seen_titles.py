"""Index of the titles that an ingest has stored, so that a batch reads little of the past.

A title is a key of 128 bits. Every batch leaves a segment: its keys, dealt into buckets of bounded size by
their first bits, and a Bloom filter for each bucket. Eight neighbouring segments are merged into one of the
next level when they are complete, so some eight segments a level are in use. A batch probes the
filters with its own keys and reads only the buckets that may hold one of them.

A segment is written whole under a name that follows from its batch, so a batch that runs again
writes the same segment, and none reads a segment of its own or of a later batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.session import cut

#: Segments of one level that are merged into one of the next.
MERGED = 8
#: Keys of a bucket on average at most; a filter takes BITS bits a key and tests HASHES of them.
BUCKET_KEYS = 100_000
BITS, HASHES = 12, 6

KEY = "hi bigint, lo bigint"


def title_key(title: str | Column) -> list[Column]:
    """(hi, lo): 128 bits of a title; null is a title of its own."""
    col = F.col(title) if isinstance(title, str) else title
    digest = F.md5(F.coalesce(F.concat(F.lit("t"), col), F.lit("null")))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint")
    return [half(1).alias("hi"), half(17).alias("lo")]


def _places(hi: np.ndarray, lo: np.ndarray, size: int) -> np.ndarray:
    """The bits that each key sets in a filter of ``size`` bits, a row per hash."""
    step = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (hi.astype(np.uint64) + step * (lo.astype(np.uint64) | np.uint64(1))) % np.uint64(size)


def filter_bits(hi: np.ndarray, lo: np.ndarray) -> bytes:
    size = max(64, -(-len(hi) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    bits[_places(hi, lo, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For each key whether the filter may have seen it; never false for one that it has seen."""
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return held[_places(hi, lo, len(held))].all(axis=0)


def _bucket(depth: Column) -> Column:
    """The first ``depth`` bits of a key as a number."""
    return F.when(depth == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.col("hi"), (64 - depth).cast("int"))).cast("int")


class SeenTitles:
    """The segments below ``path``; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, pattern: str) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = where.getFileSystem(conf).globStatus(where)
        return sorted(f.getPath().toString() for f in found or [])

    def segments(self) -> list[tuple[int, int]]:
        """(level, number) of all segments written to the end; number n of level v covers the batches from n * 8^v."""
        parts = (name.split("/")[-4:-2] for name in self._files("level=*/segment=*/filters/_SUCCESS"))
        return sorted((int(level[6:]), int(number[8:])) for level, number in parts)

    def in_use(self, batch_id: int) -> list[tuple[int, int]]:
        """The largest segments that together cover all batches before ``batch_id``."""
        used: list[tuple[int, int]] = []
        for level, number in sorted(self.segments(), reverse=True):
            begin, end = number * MERGED**level, (number + 1) * MERGED**level
            inside = any(n * MERGED**v <= begin and end <= (n + 1) * MERGED**v for v, n in used)
            if end <= batch_id and not inside:
                used.append((level, number))
        return sorted(used)

    def _at(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/level={segment[0]}/segment={segment[1]}"

    def write(self, keys: DataFrame, segment: tuple[int, int]) -> None:
        """Write the keys (hi, lo) as one segment, its filters last."""
        n = keys.count()
        depth = max(0, math.ceil(math.log2(max(n, 1) / BUCKET_KEYS)))
        level, number = segment
        placed = keys.select("hi", "lo", _bucket(F.lit(depth)).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "hi", "lo")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._at(segment)}/keys")

        def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                hi, lo, bucket = (batch.column(i).to_numpy() for i in range(3))
                for b in np.unique(bucket).tolist():
                    own = bucket == b
                    held.setdefault(b, []).append((hi[own], lo[own]))
                    for done in [x for x in held if x != b and x < b]:  # buckets come in order
                        yield row(done, held.pop(done))
            for b, parts in held.items():
                yield row(b, parts)

        def row(b: int, parts: list) -> pa.RecordBatch:
            hi, lo = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_pydict(
                {"level": pa.array([level], pa.int32()), "number": pa.array([number], pa.int64()), "depth": pa.array([depth], pa.int32()),
                 "bucket": pa.array([b], pa.int32()), "n": pa.array([len(hi)], pa.int64()), "bits": pa.array([filter_bits(hi, lo)], pa.binary())}
            )

        filters = placed.mapInArrow(built, "level int, number bigint, depth int, bucket int, n bigint, bits binary")
        filters.write.mode("overwrite").parquet(f"{self._at(segment)}/filters")

    def merge(self, batch_id: int) -> None:
        """Merge what has become complete before ``batch_id``, level by level."""
        level = 1
        while batch_id > 0 and batch_id % MERGED**level == 0:
            number = batch_id // MERGED**level - 1
            below = [s for s in self.segments() if s[0] == level - 1 and number * MERGED <= s[1] < (number + 1) * MERGED]
            if below and (level, number) not in self.segments():
                self.write(self._keys([f"{self._at(s)}/keys" for s in below]), (level, number))
            level += 1

    def _keys(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(KEY).option("recursiveFileLookup", "true")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], KEY)

    def candidates(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """(level, number, bucket, hi, lo): the keys that a bucket of an earlier batch may hold."""
        used = self.in_use(batch_id)
        out = "level int, number bigint, bucket int, hi bigint, lo bigint"
        if not used:
            return self.spark.createDataFrame([], out)
        filters = self.spark.read.parquet(*[f"{self._at(s)}/filters" for s in used])
        shapes = filters.select("level", "number", "depth").distinct().collect()
        if not shapes:
            return self.spark.createDataFrame([], out)
        each = F.array(*[
            F.struct(F.lit(r["level"]).alias("level"), F.lit(r["number"]).cast("bigint").alias("number"), F.lit(r["depth"]).alias("depth"))
            for r in shapes
        ])
        pieces = max(1, math.ceil(keys.count() / BUCKET_KEYS))
        asked = keys.select("hi", "lo", F.explode(each).alias("s")).select(
            "hi", "lo", "s.level", "s.number", _bucket(F.col("s.depth")).alias("bucket"), F.pmod("lo", F.lit(pieces)).alias("piece")
        ).groupBy("level", "number", "bucket", "piece").agg(F.collect_list("hi").alias("his"), F.collect_list("lo").alias("los"))

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    hi, lo = np.array(r["his"], np.int64), np.array(r["los"], np.int64)
                    held = may_hold(r["bits"], hi, lo)
                    k = int(held.sum())
                    fixed = [pa.array([r[c]] * k, t) for c, t in (("level", pa.int32()), ("number", pa.int64()), ("bucket", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(hi[held]), pa.array(lo[held])], names=["level", "number", "bucket", "hi", "lo"])

        joined = asked.join(filters.select("level", "number", "bucket", "bits"), ["level", "number", "bucket"])
        return joined.mapInArrow(probed, out)

    def seen(self, keys: DataFrame, batch_id: int) -> tuple[DataFrame, list[str]]:
        """The keys (hi, lo) that batches before ``batch_id`` hold, and the folders that were read for it.

        The driver lists the buckets that may be hit, of some 100,000 titles each.
        """
        maybe = cut(self.candidates(keys, batch_id))
        hit = maybe.select("level", "number", "bucket").distinct().collect()
        folders = sorted(f"{self._at((r['level'], r['number']))}/keys/bucket={r['bucket']}" for r in hit)
        return maybe.select("hi", "lo").distinct().join(self._keys(folders), ["hi", "lo"], "left_semi"), folders
