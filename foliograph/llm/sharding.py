"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows of equal text are one group, which no shard boundary divides.  Each group
starts as a partial partition of its bytes and zeros; the two partial partitions
of greatest spread are combined again and again, the largest part of one with
the smallest of the other, until one is left.

The groups are spread over buckets by a hash and differenced within each bucket
in parallel; what a bucket leaves is a partial partition like any other, so the
same rule combines the buckets' results.  The bucket count follows the number of
groups, and the combining is repeated in levels of ``fan`` partitions, so no
worker holds more than ``bucket_groups`` groups or ``fan`` partitions at once.

Defined results: NULL and empty texts are groups of no bytes (NULL is not the
empty text); ties of spread go to the lesser group key; an empty table has no
rows; repeated rows are each assigned, to one shard; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._run import arrays, runs, table


@dataclass(frozen=True)
class Params:
    shards: int = 16
    bucket_groups: int = 20_000
    fan: int = 256


def difference(parts: list[tuple[int, np.ndarray]], shards: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Combine partial partitions (key, sums in descending order) into one.

    Returns the final sums (descending) and for each key the place among them of
    each of its parts.
    """
    heap = [(-(int(s[0]) - int(s[-1])), k, i) for i, (k, s) in enumerate(parts)]
    sums = [np.asarray(s, np.int64) for _, s in parts]
    heapq.heapify(heap)
    children: list[tuple | None] = [None] * len(parts)
    while len(heap) > 1:
        _, ka, a = heapq.heappop(heap)
        _, kb, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        children.append((a, b, order))
        sums.append(total[order])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-(int(sums[-1][0]) - int(sums[-1][-1])), min(ka, kb), len(sums) - 1))
    if not heap:
        return np.zeros(shards, np.int64), {}
    root = heap[0][2]
    place = {root: np.arange(shards)}
    for i in range(len(children) - 1, -1, -1):
        if children[i] is not None:
            a, b, order = children[i]
            mine = np.empty(shards, np.int64)
            mine[order] = place.pop(i)  # where the part at each place before sorting went
            place[a] = mine
            place[b] = mine[::-1]
    return sums[root], {parts[i][0]: p for i, p in place.items()}


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row for each document: doc_id, shard, bytes."""
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.xxhash64(text).alias("g1"), F.xxhash64(F.reverse(text), F.lit(1)).alias("g2"))
    rows = table(keyed.withColumn("g", F.struct("g1", "g2")).drop("g1", "g2"), "rows")
    groups = rows.groupBy("g").agg(F.sum("bytes").alias("bytes"))
    groups = table(groups, "groups")
    n = groups.count()
    buckets = max(1, -(-n // p.bucket_groups))
    S = p.shards
    inner = pa.schema([("bucket", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("place", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def solve(batches):
        for bucket, g1, g2, size in runs(batches, 4):
            first = np.zeros(S, np.int64)
            parts = []
            for i, v in enumerate(size.tolist()):
                s = first.copy()
                s[0] = v
                parts.append((i, s))
            sums, place = difference(parts, S)
            k = len(size)
            yield arrays(inner, bucket, g1, g2, np.array([place[i][0] for i in range(k)], np.int32), [sums if i == 0 else None for i in range(k)])

    spread = groups.select(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"), "g.g1", "g.g2", "bytes").repartition("bucket").sortWithinPartitions("bucket", F.desc("bytes"), "g1", "g2")
    local = table(spread.mapInArrow(solve, "bucket long, g1 long, g2 long, place int, sums array<long>"), "places")

    # the buckets' partial partitions, in levels of at most ``fan``
    level = local.filter("sums is not null").select(F.col("bucket").alias("part"), "sums")
    route = local.select(F.col("bucket").alias("part"), "g1", "g2", "place")
    up = pa.schema([("above", pa.int64()), ("part", pa.int64()), ("to", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])

    def combine(batches):
        held: dict[int, list] = {}
        for b in batches:
            for above, part, sums in zip(*(b.column(i).to_pylist() for i in range(3))):
                held.setdefault(above, []).append((part, np.array(sums)))
        for above, parts in held.items():
            sums, place = difference(sorted(parts, key=lambda x: x[0]), S)
            yield arrays(up, [above] * len(parts), [k for k, _ in parts], [place[k].astype(np.int32) for k, _ in parts], [sums if i == 0 else None for i in range(len(parts))])

    count = buckets
    while True:
        above = -(-count // p.fan)
        done = table(level.select((F.col("part") % above).alias("above"), "part", "sums").repartition("above").mapInArrow(combine, "above long, part long, to array<int>, sums array<long>"), "level")
        moved = done.select("part", "above", "to")
        route = route.join(moved, "part").select(F.col("above").alias("part"), "g1", "g2", F.expr("to[place]").alias("place"))
        if above == 1:
            break
        level = done.filter("sums is not null").select(F.col("above").alias("part"), "sums")
        count = above
    final = route.select(F.struct("g1", "g2").alias("g"), F.col("place").alias("shard"))
    return rows.join(final, "g").select("doc_id", "shard", "bytes")
