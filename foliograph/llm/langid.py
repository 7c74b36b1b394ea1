"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors.

A text is folded and its words joined by single spaces; hashed byte n-grams of
it are weighted by ln(1 + tf) * idf and normalised.  Every language has several
centroids from spherical k-means over a bounded labelled sample; a text takes
the language of the centroid of greatest cosine.  A text is rejected when its
cosine lies below a floor that depends on its length (short texts lie further
from any centroid), calibrated on the same sample.

Document frequencies cover all rows.  Defined results: a null, empty or
wordless text has language NULL and is rejected; with no labelled row at all
every text is; ties between centroids go to the alphabetically first language;
repeated rows are judged one by one; columns other than those named are ignored
(``identify``) or passed through unchanged (``accepted``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._run import arrays, keep_rows, sample_below
from ._tok import buffers, fold, slices

BITS = 12
SIZES = (2, 3)
WIDTH = len(SIZES) << BITS
#: Texts cut to these many bytes calibrate the rejection of short ones.
LENGTHS = (12, 24, 48, 96, 192, 384, 1536)


@dataclass(frozen=True)
class Params:
    train_per_lang: int = 300  #: bound of the labelled sample, rows per language
    clusters: int = 3
    iterations: int = 12
    quantile: float = 0.005
    slack: float = 0.7  #: the floor is this share of the sample's quantile


def counts(col: pa.Array, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (rows x WIDTH) and the number of folded bytes of each text."""
    raw, off = buffers(col)
    n = len(off) - 1
    f = fold(raw)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    keep = np.empty(len(f), bool)
    if len(f):
        keep[0] = f[0] != 0
        keep[1:] = (f[1:] != 0) | ((f[:-1] != 0) & (doc[1:] == doc[:-1]))
    f, doc = f[keep], doc[keep]
    size = np.bincount(doc, minlength=n)
    if cut is not None:
        local = np.arange(len(f)) - (np.cumsum(size) - size)[doc]
        f, doc = f[local < cut], doc[local < cut]
        size = np.minimum(size, cut)
    out = np.zeros((n, WIDTH), np.float32)
    code = f.astype(np.uint32)
    for j, k in enumerate(SIZES):
        if len(f) < k:
            continue
        m = len(f) - k + 1
        gram = code[:m].copy()
        for i in range(1, k):
            gram = gram * np.uint32(257) + code[i : i + m]
        gram = (gram * np.uint32(2654435769)) >> np.uint32(32 - BITS)
        same = doc[:m] == doc[k - 1 :]
        cell = doc[:m].astype(np.int64) << BITS | gram
        out[:, j << BITS : (j + 1) << BITS] = np.bincount(cell[same], minlength=n << BITS).reshape(n, 1 << BITS)
    return out, size


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of rows, and of rows that hold each n-gram, over all of ``docs``."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(WIDTH + 1, np.int64)
        for b in batches:
            for s in slices(b, 0, 1 << 19, 512):
                c, _ = counts(s.column(0))
                total[:-1] += np.count_nonzero(c, axis=0)
                total[-1] += s.num_rows
        yield arrays(schema, np.arange(WIDTH + 1), total)

    got = docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(WIDTH + 1, np.int64)
    for r in got:
        df[r.gram] = r.n
    return int(df[-1]), df[:-1]


def kmeans(x: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Unit centroids by spherical k-means, seeded with the farthest points."""
    mean = x.mean(0)
    seeds = [int(np.argmax(x @ mean))]
    best = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(iterations):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor_at: np.ndarray
    floor: np.ndarray

    def predict(self, col: pa.Array, cut: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1 for none), cosine, and whether it is rejected."""
        c, size = counts(col, cut)
        if not self.langs:
            none = np.full(len(col), -1)
            return none, np.zeros(len(col), np.float32), np.ones(len(col), bool)
        sim = vectors(c, self.idf) @ self.centroids.T
        best = np.argmax(sim, axis=1)
        cos = sim[np.arange(len(best)), best]
        empty = ~c.any(axis=1)
        low = np.interp(np.log(np.maximum(size, 1)), self.floor_at, self.floor)
        return np.where(empty, -1, self.owner[best]), np.where(empty, 0, cos), empty | (cos < low)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", p: Params = Params()) -> Model:
    """Centroids of each label of ``lang_col``; idf from all rows, the rest from the bounded sample."""
    n, df = document_frequencies(docs, text_col)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32)
    sizes = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect() if r[0] is not None}
    langs = sorted(sizes)
    if not langs:
        return Model([], idf, np.zeros((0, WIDTH), np.float32), np.zeros(0, int), np.zeros(1), np.zeros(1))
    h = F.xxhash64(F.col(text_col), F.col(lang_col))
    part = F.lit(False)
    for lang in langs:
        part = part | ((F.col(lang_col) == lang) & (F.pmod(h, F.lit(1 << 30)) < sample_below(1.5 * p.train_per_lang / sizes[lang])))
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("cut", pa.int32()), ("size", pa.int32()), ("grams", pa.binary()), ("v", pa.binary())])

    def features(batches):
        for b in batches:
            for s in slices(b, 0, 1 << 19, 512):
                for k in (None, *LENGTHS):
                    c, size = counts(s.column(0), k)
                    at = [np.flatnonzero(r).astype(np.uint16) for r in c]
                    yield arrays(schema, s.column(1), s.column(2), np.full(len(size), k or 0), size, [a.tobytes() for a in at], [r[a].astype(np.uint32).tobytes() for r, a in zip(c, at)])

    sample = docs.select(text_col, lang_col, h.alias("key")).filter(part).dropDuplicates(["key"])
    rows = sorted(sample.mapInArrow(features, "lang string, key long, cut int, size int, grams binary, v binary").collect(), key=lambda r: (r.lang, r.key, r.cut))
    keep, seen = [], {}
    for r in rows:
        if r.cut == 0:
            seen[r.lang] = seen.get(r.lang, 0) + 1
        if seen[r.lang] <= p.train_per_lang:
            keep.append(r)
    rows = None
    lang = np.array([langs.index(r.lang) for r in keep], int)
    cut, size = np.array([r.cut for r in keep], int), np.array([r.size for r in keep], int)

    def some(which: np.ndarray) -> np.ndarray:
        if not len(which):
            return np.zeros((0, WIDTH), np.float32)
        c = np.zeros((len(which), WIDTH), np.float32)
        for row, i in zip(c, which):
            row[np.frombuffer(keep[i].grams, np.uint16)] = np.frombuffer(keep[i].v, np.uint32)
        return vectors(c, idf)

    cents, owner = [], []
    for i in range(len(langs)):
        own = some(np.flatnonzero((lang == i) & (cut == 0) & (size > 0)))
        if len(own):
            cents.append(kmeans(own, p.clusters, p.iterations))
            owner += [i] * len(cents[-1])
    if not cents:
        return Model([], idf, np.zeros((0, WIDTH), np.float32), np.zeros(0, int), np.zeros(1), np.zeros(1))
    centroids, owner = np.concatenate(cents).astype(np.float32), np.array(owner)
    # a few rows at a time: the driver never holds the sample's vectors at once
    cos = np.concatenate([(some(np.arange(a, min(a + 200, len(keep)))) @ centroids.T).max(1) for a in range(0, len(keep), 200)])
    at, floor = [], []
    for k in LENGTHS:
        own = cos[(cut == k) & (size == k)]
        if len(own) >= 20:
            at.append(np.log(k))
            floor.append(np.quantile(own, p.quantile) * p.slack)
    if not at:
        at, floor = [0.0], [0.0]
    return Model(langs, idf, centroids, owner, np.array(at), np.array(floor))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", p: Params = Params()) -> DataFrame:
    """One row for each document: doc_id, language (NULL if wordless), cosine, rejected."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, lang_col, p))
    schema = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("cosine", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        m = model.value
        for b in batches:
            for s in slices(b, 1, 1 << 19, 512):
                best, cos, rejected = m.predict(s.column(1))
                yield arrays(schema, s.column(0), [m.langs[i] if i >= 0 else None for i in best], cos.astype(np.float64), rejected)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, language string, cosine double, rejected boolean")


def accepted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, lang_col, p))

    def mask(b: pa.RecordBatch, at: int) -> np.ndarray:
        return np.concatenate([~model.value.predict(s.column(at))[2] for s in slices(b, at, 1 << 19, 512)])

    return keep_rows(docs, text_col, mask)
