"""Toxicity by subword-bag embeddings averaged into a linear softmax.

The features of a token are hashed n-grams (3 to 6 bytes) of ``<token>`` and the
token itself.  A token's vector is the mean of its features' vectors, a text's
the mean of its tokens', and a two-class softmax reads it; embeddings and
softmax are trained jointly (AdaGrad, NumPy) on a bounded sample of labelled
rows.  A misspelling never seen shares most n-gram vectors with the word.
After training each feature's vector reduces exactly to one number, its share
of the logit, so scoring is one table look-up a feature.

Only the first occurrence of a token in its text counts, so that repetition
adds nothing.  A text is scored by its most toxic window of ``window`` such
tokens (windows overlap by half; a shorter text is one window), so that a long
text does not dilute; one of fewer than ``least`` tokens is averaged as though
zero vectors filled it up.
Training sees windows as well: all of a clean text's, and after a first half of
the epochs only the worst of a toxic text's.  Features in fewer than
``min_docs`` texts of the sample keep a zero vector.

Defined results: a null, empty or wordless text scores 0 and is not toxic; when
the labels lack one of the classes nothing is toxic; NULL labels are ignored;
of contradicting labels of a doc_id the toxic one holds; repeated rows are
scored one by one; other columns are ignored (``score``) or kept (``clean``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._run import arrays, keep_rows, sample_below
from ._tok import U64, Tokens, fold, mix, slices, tokenize


@dataclass(frozen=True)
class Params:
    train_per_class: int = 1200  #: bound of the labelled sample, rows per class
    bits: int = 17
    dim: int = 4
    epochs: int = 8
    steps: int = 800  #: at least; a small sample is gone through more often
    batch: int = 128
    rate: float = 1.0
    window: int = 64
    least: int = 24
    min_docs: int = 4
    seed: int = 7


NGRAMS = (3, 4, 5, 6)


def features(t: Tokens, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens: index of each token among them; feature buckets; first feature of each distinct token."""
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, at, inv = np.unique(t.hash, return_index=True, return_inverse=True)
    size = t.end[at] - t.start[at] + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(at)), size)
    local = np.arange(len(word)) - first[word]
    src = np.clip(t.start[at][word] + local - 1, 0, len(t.raw) - 1)
    c = fold(t.raw[src]).astype(np.uint32)
    c[first], c[first + size - 1] = 1, 2
    owner, bucket = [np.arange(len(at))], [(mix(t.hash[at] + U64(1)) >> U64(64 - bits)).astype(np.int64)]
    h = np.zeros(len(c), np.uint32)
    for k in range(1, max(NGRAMS) + 1):
        if k > len(c):
            break
        m = len(c) - k + 1
        h = (h[:m] * np.uint32(0x01000193)) ^ (c[k - 1 :] * np.uint32(0x85EBCA6B))
        if k in NGRAMS:
            ok = local[:m] + k <= size[word[:m]]
            g = h[ok] * np.uint32(0x9E3779B1)
            g ^= g >> np.uint32(15)
            bucket.append(((g * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)).astype(np.int64))
            owner.append(word[:m][ok])
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    return inv, bucket[order], np.searchsorted(owner[order], np.arange(len(at) + 1))


def once(t: Tokens) -> Tokens:
    """The tokens without those that their text has had before."""
    if not len(t):
        return t
    order = np.lexsort((np.arange(len(t)), t.hash, t.doc))
    h, d = t.hash[order], t.doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.sort(order[new])
    return replace(t, start=t.start[at], end=t.end[at], hash=t.hash[at], doc=t.doc[at], first=np.searchsorted(at, t.first))


def windows(t: Tokens, width: int) -> tuple[Tokens, np.ndarray]:
    """The tokens with windows (side by side, the last one shorter) as rows, and the row each window comes from."""
    many = -(-np.diff(t.first) // width)
    row = np.repeat(np.arange(len(many)), many)
    first = t.first[row] + (np.arange(len(row)) - (np.cumsum(many) - many)[row]) * width
    first = np.append(first, len(t))
    return replace(t, first=first, doc=np.repeat(np.arange(len(row)), np.diff(first))), row


@dataclass
class Sample:
    """Windows of texts as numbers of words, and the features of each word; small, as words share their features."""

    bucket: np.ndarray  #: features of all words, one word after the other
    first: np.ndarray  #: first feature of each word, and the end
    size: np.ndarray  #: how many features a word has, those dropped as well
    word: np.ndarray  #: words of all windows, one window after the other
    start: np.ndarray  #: first word of each window, and the end
    doc: np.ndarray  #: the text of each window

    def words(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of some windows, and each one's place among the windows."""
        return expand(self.start, windows, self.word)

    def features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of some words, and each one's place among the words."""
        return expand(self.first, words, self.bucket)


def expand(first: np.ndarray, which: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = first[which + 1] - first[which]
    own = np.repeat(np.arange(len(which)), n)
    return values[first[which][own] + np.arange(len(own)) - (np.cumsum(n) - n)[own]], own


def gather(texts: list[str], p: Params) -> Sample:
    """The windows of all texts, without features that fewer than ``min_docs`` texts have."""
    bucket, size, word, length, doc = [], [], [], [], []
    base = words = 0
    for s in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), 0, 1 << 20):
        t, row = windows(once(tokenize(s.column(0))), p.window)
        inv, b, first = features(t, p.bits)
        bucket.append(b.astype(np.int32))
        size.append(np.diff(first))
        word.append((inv + words).astype(np.int32))
        length.append(np.diff(t.first))
        doc.append(row + base)
        words += len(first) - 1
        base += s.num_rows
    join = lambda x, kind=np.int64: np.concatenate(x) if x else np.zeros(0, kind)
    size = join(size)
    m = Sample(join(bucket), np.concatenate([[0], np.cumsum(size)]), size, join(word), np.concatenate([[0], np.cumsum(join(length))]), join(doc))
    seen = np.zeros(1 << p.bits, np.int32)
    cut = np.append(np.flatnonzero(np.diff(m.doc)) + 1, len(m.doc))
    for a, z in zip(np.append(0, cut[:-1]), cut):
        if z > a:
            seen[np.unique(m.features(m.words(np.arange(a, z))[0])[0])] += 1
    keep = seen[m.bucket] >= p.min_docs
    m.first = np.concatenate([[0], np.cumsum(keep)])[m.first]
    m.bucket = m.bucket[keep]
    return m


def train(m: Sample, y: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings E and softmax (W, b), learnt together; ``y`` is the class of each window's text."""
    rng = np.random.default_rng(p.seed)
    e = np.zeros((1 << p.bits, p.dim), np.float32)
    w = rng.normal(0, 0.5, (p.dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    ge, gw, gb = np.full(e.shape, 1e-6, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    windows = np.arange(len(m.doc))
    epochs = max(p.epochs, -(-p.steps // max(1, -(-len(windows) // p.batch))))
    for epoch in range(epochs):
        use = windows
        if epoch >= epochs // 2:
            z = word_scores(m, e @ (w[:, 1] - w[:, 0]))
            total = np.concatenate([[0.0], np.cumsum(z[m.word])])
            z = (total[m.start[1:]] - total[m.start[:-1]]) / np.maximum(np.diff(m.start), p.least)
            best = np.full(m.doc.max(initial=0) + 1, -np.inf)
            np.maximum.at(best, m.doc, z)
            use = np.flatnonzero((y == 0) | (z == best[m.doc]))
        weight = np.where(y == 1, 0.5 / max((y[use] == 1).mean(), 1e-9), 0.5 / max((y[use] == 0).mean(), 1e-9)).astype(np.float32)
        order = use[rng.permutation(len(use))]
        rate = p.rate * (1 - epoch / epochs)
        for a in range(0, len(order), p.batch):
            own = order[a : a + p.batch]
            words, at = m.words(own)
            bucket, owner = m.features(words)
            member = at[owner]
            share = (1 / (m.size[words] * np.maximum(np.diff(m.start)[own], p.least)[at])).astype(np.float32)[owner]
            v = np.zeros((len(own), p.dim), np.float32)
            if len(bucket):
                head = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
                v[member[head]] = np.add.reduceat(e[bucket] * share[:, None], head, axis=0)
            z = v @ w + b
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(own)), y[own]] -= 1
            q *= weight[own][:, None] / len(own)
            dv, dw, db = q @ w.T, v.T @ q, q.sum(0)
            if len(bucket):
                s = np.argsort(bucket, kind="stable")
                u, cut = np.unique(bucket[s], return_index=True)
                de = np.add.reduceat((dv[member] * share[:, None])[s], cut, axis=0)
                ge[u] += de * de
                e[u] -= rate * de / np.sqrt(ge[u])
            gw += dw * dw
            w -= rate * dw / np.sqrt(gw)
            gb += db * db
            b -= rate * db / np.sqrt(gb)
    return e, w, b


def word_scores(m: Sample, share: np.ndarray) -> np.ndarray:
    """The share of the logit of each word."""
    bucket, own = m.features(np.arange(len(m.size)))
    return np.bincount(own, share[bucket], len(m.size)) / np.maximum(m.size, 1)


@dataclass
class Model:
    share: np.ndarray | None
    bias: float
    threshold: float
    p: Params

    def logits(self, t: Tokens, rows: int) -> np.ndarray:
        """The logit of each row's most toxic window; -inf for a wordless one."""
        out = np.full(rows, -np.inf)
        if self.share is None or not len(t):
            return out
        inv, bucket, first = features(t, self.p.bits)
        word = np.add.reduceat(self.share[bucket].astype(np.float64), first[:-1]) / np.diff(first)
        total = np.concatenate([[0.0], np.cumsum(word[inv])])
        n, half = np.diff(t.first), self.p.window // 2
        many = np.maximum(1, -(-(n - half) // half))
        row = np.repeat(np.arange(rows), many)
        k = np.arange(len(row)) - (np.cumsum(many) - many)[row]
        a = t.first[row] + k * half
        z = np.minimum(a + self.p.window, t.first[row + 1])
        # the last window reaches back, so that it is as long as the others
        a = np.maximum(t.first[row], np.minimum(a, z - self.p.window))
        size = z - a
        value = np.where(size > 0, (total[z] - total[a]) / np.maximum(size, self.p.least) + self.bias, -np.inf)
        np.maximum.at(out, row, value)
        return out

    def predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the most toxic window, and the decision."""
        z = self.logits(once(tokenize(col)), len(col))
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(z), 1 / (1 + np.exp(-z)), 0.0), z > self.threshold


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", p: Params = Params()) -> Model:
    """Train on a hash sample of both classes; a third of it sets the threshold."""
    lab = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(None, 0.0, np.inf, p)
    h = F.xxhash64(F.col("k"), F.lit(p.seed))
    part = F.lit(False)
    for y, n in sizes.items():
        part = part | ((F.col("y") == y) & (F.pmod(h, F.lit(1 << 30)) < sample_below(p.train_per_class / n)))
    chosen = F.broadcast(lab.filter(part))  # about 2 * train_per_class rows by its own bound
    sample = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).join(chosen, "k").groupBy("k").agg(F.max("y").alias("y"), F.min("t").alias("t"))
    rows = sorted((r for r in sample.collect() if r.t), key=lambda r: r.k)
    return fit_local([r.t for r in rows], np.array([r.y for r in rows], int), p)


def fit_local(texts: list[str], y: np.ndarray, p: Params = Params()) -> Model:
    """Train on texts and classes in memory."""
    held = np.zeros(len(texts), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::3]] = True
    if len(set(y[~held])) < 2:
        held[:] = False
    if len(set(y)) < 2:
        return Model(None, 0.0, np.inf, p)
    fitted = np.flatnonzero(~held)
    sample = gather([texts[i] for i in fitted], p)
    own = y[fitted][sample.doc]
    if len(set(own)) < 2:
        return Model(None, 0.0, np.inf, p)
    e, w, b = train(sample, own, p)
    m = Model(e @ (w[:, 1] - w[:, 0]), float(b[1] - b[0]), 0.0, p)
    z = np.concatenate([m.logits(once(tokenize(s.column(0))), s.num_rows) for s in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), 0, 1 << 20)])
    judged = (held if held.any() else ~held) & np.isfinite(z)
    if len(set(y[judged])) == 2:
        m.threshold = cut_between(z[judged & (y == 0)], z[judged & (y == 1)])
    return m


def cut_between(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of fewest errors (one class's share plus the other's); a third of the way up where several are as good, as unseen misspellings lie lower than the words they stand for."""
    z = np.unique(np.concatenate([clean, toxic]))
    cuts = (z[:-1] + z[1:]) / 2 if len(z) > 1 else z
    cost = np.array([(clean > c).mean() * 2 + (toxic <= c).mean() for c in cuts])
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float((2 * cuts[best[0]] + cuts[best[-1]]) / 3)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row for each document: doc_id, toxicity (probability of the worst window), is_toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, p=p))
    schema = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("is_toxic", pa.bool_())])

    def run(batches):
        for b in batches:
            for s in slices(b, 1, 1 << 20):
                yield arrays(schema, s.column(0), *model.value.predict(s.column(1)))

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, toxicity double, is_toxic boolean")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, p=p))

    def mask(b: pa.RecordBatch, at: int) -> np.ndarray:
        return np.concatenate([~model.value.predict(s.column(at))[1] for s in slices(b, at, 1 << 20)])

    return keep_rows(docs, text_col, mask)
