"""Near-duplicate removal by min-max hashing.

Every permutation of the hashed token shingles gives two signature values, the
shingle of least and the one of greatest rank; each agrees between two texts
with the probability of their Jaccard similarity, so ``perms`` evaluations give
an unbiased signature of ``2 * perms`` values.  A permutation is an odd
multiplication modulo 2**64, cut to 32 bits.  Bands are made of whole values;
for the estimate a byte of each is kept, and the one in 256 of differing values
that agree by chance is taken off.

Texts of equal signature are joined first; the representatives are banded, and
within a bucket of equal band single linkage is exact: every pair whose
estimated similarity reaches ``threshold`` is connected, through a search that
compares each text found with all not yet reached.  Large buckets are cut into
chunks, and what the chunks leave apart is compared across them.  Groups are the
connected components over all buckets, by alternating large-star and small-star
steps.  No bucket, group or candidate list is capped.

Rows are told apart by doc_id and a hash of the text.  The row of the least
doc_id of each group stays (NULL counts as greatest, the text's hash breaks
ties, and of rows of equal doc_id and text the one whose columns hash lowest).  A null, empty or wordless text
has no shingles: such rows are near-duplicates of nothing and all stay.  Other
columns are ignored (``groups``) or kept (``distinct``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._graph import components
from ._run import arrays, runs, table
from ._tok import U64, WORDY, equal_bytes, keys_of, minmax, slices, tokenize


@dataclass(frozen=True)
class Params:
    shingle: int = 3
    perms: int = 64
    bands: int = 32  #: of ``2 * perms / bands`` values each
    threshold: float = 0.5
    chunk: int = 4096  #: rows of a bucket compared in one task
    seed: int = 1


def signatures(col: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest rank under each permutation (rows x 2*perms, uint32), and the number of shingles."""
    return minmax(tokenize(col), len(col), p.shingle, p.perms, p.seed)


def share(threshold: float) -> float:
    """The share of equal bytes that stands for a similarity: of values that differ, one in 256 has the same byte."""
    return threshold + (1 - threshold) / 256


def linkage(sig: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of single linkage over all pairs of rows of which at least ``need`` bytes agree."""
    words = np.ascontiguousarray(sig).view(U64)
    left = np.arange(len(sig))
    us, vs = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = equal_bytes(words[left], words[i]) >= need
            us.append(np.full(near.sum(), i))
            vs.append(left[near])
            front += left[near].tolist()
            left = left[~near]
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def across(sig: np.ndarray, group: np.ndarray, side: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
    """One edge for each two groups with rows on different sides of which at least ``need`` bytes agree."""
    words = np.ascontiguousarray(sig).view(U64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    us, vs = [], []
    for i in left.tolist():
        near = right[(equal_bytes(words[right], words[i]) >= need) & (group[right] != group[i])]
        _, first = np.unique(group[near], return_index=True)
        us.append(np.full(len(first), i))
        vs.append(near[first])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()).alias("h")]


def _signature_table(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """Written table of doc_id, h, rid (the row's own number), sig (one byte a value) and keys (one a band)."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("whole", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for s in slices(b, 2, 1 << 21):
                sig, n = signatures(s.column(2), p)
                ok = pa.array(n > 0)
                byte, whole = sig.astype(np.uint8), keys_of(sig, 1)[:, 0]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.bands, pa.int32()), pa.array(keys_of(sig, p.bands).ravel()))
                yield arrays(schema, s.column(0), s.column(1), pa.array(whole), pa.array([r.tobytes() for r in byte], pa.binary()), bands).filter(ok)

    out = docs.select(*_keys(docs, id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, h long, whole long, sig binary, bands array<long>")
    return table(out, "signatures")


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _grouped(members: DataFrame, keys: list[str], columns: list[str], solve) -> DataFrame:
    """Edges (u, v) of ``solve(columns...)`` for the rows of each value of ``keys``, which ``members`` is shuffled by."""

    def run(batches):
        us, vs, held = [], [], 0
        for _, rid, *more in runs(batches, len(columns) + 1):
            if len(rid) > 1:
                u, v = solve(rid, *more)
                us.append(rid[u])
                vs.append(rid[v])
                held += len(u)
            if held > 50_000:
                yield arrays(_EDGE, np.concatenate(us), np.concatenate(vs))
                us, vs, held = [], [], 0
        if us:
            yield arrays(_EDGE, np.concatenate(us), np.concatenate(vs))

    one = members.select(F.xxhash64(*keys).alias("key"), *columns)
    return one.repartition("key").sortWithinPartitions("key", columns[0]).mapInArrow(run, "u long, v long")


def _bytes(sig: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)


def bucket_edges(members: DataFrame, p: Params) -> DataFrame:
    """Written edges (u, v) that connect what single linkage within each bucket connects; ``members`` is (bucket, n, rid, sig), n the bucket's size.

    A bucket of more than ``chunk`` rows is linked in chunks, drawn anew for
    each bucket, so that texts that share buckets are mostly joined by then.
    What is still apart within such a bucket is compared chunk by chunk with
    all the others: no pair of the bucket is left out, and no task holds more
    than two chunks.
    """
    need = share(p.threshold) * 2 * p.perms - 1e-9
    chunk = F.pmod(F.xxhash64("rid", "bucket"), F.ceil(F.col("n") / p.chunk))
    chunked = members.withColumn("chunk", chunk)
    edges = table(_grouped(chunked, ["bucket", "chunk"], ["rid", "sig"], lambda rid, sig: linkage(_bytes(sig), need)), "edges")
    large = chunked.filter(F.col("n") > p.chunk)
    if not large.head(1):
        return edges
    rooted = large.join(components(edges), F.col("rid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rid"))
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    m = F.ceil(F.col("n") / p.chunk)
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))).alias("t")
    tiles = rooted.join(apart, "bucket").select("bucket", "rid", "sig", "root", "chunk", pairs).filter("t.i <> t.j")
    tiles = tiles.select("bucket", "t.i", "t.j", "rid", "sig", "root", (F.col("chunk") == F.col("t.j")).cast("int").alias("side"))
    rest = _grouped(tiles, ["bucket", "i", "j"], ["rid", "sig", "root", "side"], lambda rid, sig, root, side: across(_bytes(sig), root, side, need))
    return table(edges.union(rest), "edges")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row for each distinct (doc_id, h) of a text with words: doc_id, h, and those of the row of its group that stays: keep_id, keep_h."""
    sig = _signature_table(docs, id_col, text_col, p)
    # rows of equal signature: one representative, which carries the group's best row
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h"))
    reps = table(sig.groupBy("whole").agg(best.alias("best"), F.min("sig").alias("sig"), F.min("bands").alias("bands")), "representatives")
    banded = reps.select("whole", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = banded.join(shared, "bucket").join(reps.select("whole", "sig"), "whole").select("bucket", "n", F.col("whole").alias("rid"), "sig")
    root = components(bucket_edges(members, p))
    rooted = reps.select("whole", "best").join(root, F.col("whole") == F.col("node"), "left").select("whole", "best", F.coalesce("root", "whole").alias("root"))
    top = rooted.join(rooted.groupBy("root").agg(F.min("best").alias("top")), "root").select("whole", "top")
    return sig.select("whole", "doc_id", "h").distinct().join(top, "whole").select("doc_id", "h", F.col("top.id").alias("keep_id"), F.col("top.h").alias("keep_h"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """Each distinct document (doc_id, text) with words: doc_id, group_id (the doc_id of the one that stays), kept."""
    d = decisions(docs, id_col, text_col, p)
    return d.select("doc_id", F.col("keep_id").alias("group_id"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))).alias("kept"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row of each group, and all rows without words; all columns as they are."""
    drop = decisions(docs, id_col, text_col, p).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")))
    names = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    # rows without words are near-duplicates of nothing: they stay where they are
    wordy = F.coalesce(F.col(text).cast("string").rlike(WORDY), F.lit(False))
    keyed = named.filter(wordy).select(F.struct(*names).alias("row"), F.struct(*[k.alias(a) for k, a in zip(_keys(named, names[docs.columns.index(id_col)], text), ("id", "h"))]).alias("key"))
    once = keyed.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    d = drop.filter("stays").select(F.struct(F.col("doc_id").alias("id"), "h").alias("key")).distinct()
    return once.join(d, "key", "left_semi").select("row.*").union(named.filter(~wordy)).toDF(*docs.columns)
