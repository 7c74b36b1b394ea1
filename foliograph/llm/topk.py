"""Exact BM25 top-k by block-at-a-time pruning.

Every row of the query table is a query.  A first pass over all documents
counts documents, their length and the document frequencies of the queries'
terms.  In the second, the documents of each task are cut into blocks of
``block`` neighbouring ones; each block has a forward index of the query terms
in it, with their impacts, and the greatest impact of each term.  For each query
the blocks are ordered by their bound, the sum of their terms' maxima, and
scored through their forward indexes until the bound falls below the query's
k-th score so far.  Each task keeps its k best; a window over those of all tasks
gives the result, which is exact.

An impact is the term's BM25 weight in the document, scaled and rounded to a
whole number, so that sums are the same in any order and ties are ties.

Queries are handled in groups of ``query_group``; their terms are what is
broadcast, so that it does not grow with the number of queries.

Defined results: a query or document that is NULL, empty or wordless has no
result, nor has a query without id; queries of one id share a ranking; only documents with a score above 0 are ranked; ties go to the lesser
doc_id (NULL last), and repeated rows are ranked one by one, so fewer than k
rows mean fewer than k matching documents; repeated query terms count each
time; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._run import arrays
from ._tok import Tokens, slices, tokenize

NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Params:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    scale: int = 1000
    block: int = 64
    query_group: int = 1000


@dataclass
class Queries:
    ids: list
    vocab: np.ndarray  #: sorted hashes of the queries' terms
    terms: list[np.ndarray]  #: numbers of each query's distinct terms
    weights: list[np.ndarray]  #: and how often it has each


def parse(rows: list[tuple]) -> Queries:
    t = tokenize(pa.array([r[1] for r in rows], pa.string()))
    vocab = np.unique(t.hash)
    number = np.searchsorted(vocab, t.hash)
    terms, weights = [], []
    for i in range(len(rows)):
        u, n = np.unique(number[t.first[i] : t.first[i + 1]], return_counts=True)
        terms.append(u)
        weights.append(n)
    return Queries([r[0] for r in rows], vocab, terms, weights)


def forward(t: Tokens, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, frequency) of the vocabulary's terms in each text, by row and term."""
    if not len(vocab) or not len(t):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.minimum(np.searchsorted(vocab, t.hash), len(vocab) - 1)
    ok = vocab[at] == t.hash
    key, n = np.unique(t.doc[ok] * len(vocab) + at[ok], return_counts=True)
    return key // len(vocab), key % len(vocab), n


def statistics(docs: DataFrame, text_col: str, vocab) -> tuple[int, float, np.ndarray]:
    """Documents with words, their mean length, and in how many each term is; over all rows."""
    size = len(vocab.value)
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches):
        df = np.zeros(size + 2, np.int64)
        for b in batches:
            for s in slices(b, 0):
                t = tokenize(s.column(0))
                _, term, _ = forward(t, vocab.value)
                df[:size] += np.bincount(term, minlength=size)
                df[size] += np.count_nonzero(np.diff(t.first))
                df[size + 1] += len(t)
        yield arrays(schema, np.arange(size + 2), df)

    got = docs.select(text_col).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 2, np.int64)
    for r in got:
        df[r.term] = r.n
    return int(df[size]), df[size + 1] / max(1, df[size]), df[:size]


def impacts(tf: np.ndarray, length: np.ndarray, df: np.ndarray, n: int, mean: float, p: Params) -> np.ndarray:
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    return np.floor(p.scale * idf * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length / mean)) + 0.5).astype(np.int64)


class Best:
    """The k best (score, doc) of each query so far; ties go to the lesser doc."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * queries
        self.doc = [np.zeros(0, np.int64)] * queries

    def bar(self, q: int) -> int:
        """No block whose bound lies below this can change the result."""
        return int(self.score[q][-1]) if len(self.score[q]) == self.k else 1

    def add(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        ok = score >= self.bar(q)
        if ok.any():
            s, d = np.concatenate([self.score[q], score[ok]]), np.concatenate([self.doc[q], doc[ok]])
            order = np.lexsort((d, -s))[: self.k]
            self.score[q], self.doc[q] = s[order], d[order]


def search_slice(best: Best, qs: Queries, doc: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, p: Params) -> int:
    """Offer one slice's documents to all queries; returns how many blocks were scored."""
    rows = len(doc)
    blocks = -(-rows // p.block)
    block = row // p.block
    # greatest impact of each term in each block
    key = term * blocks + block
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, int)
    top_key = key[order][first]
    top = np.maximum.reduceat(impact[order], first) if len(first) else impact[:0]
    span = np.searchsorted(top_key, np.arange(len(qs.vocab) + 1) * blocks)
    # forward index: entries by block, then term
    by = np.lexsort((row, term, block))
    f_key, f_row, f_imp = (block * len(qs.vocab) + term)[by], row[by], impact[by]
    scored = 0
    for q, (terms, weights) in enumerate(zip(qs.terms, qs.weights)):
        if not len(terms):
            continue
        bound = np.zeros(blocks, np.int64)
        for x, w in zip(terms.tolist(), weights.tolist()):
            a, z = span[x], span[x + 1]
            bound[top_key[a:z] - x * blocks] += w * top[a:z]
        live = np.flatnonzero(bound >= best.bar(q))
        for c in live[np.argsort(-bound[live], kind="stable")].tolist():
            if bound[c] < best.bar(q):
                break
            base = c * len(qs.vocab)
            lo, hi = np.searchsorted(f_key, base + terms), np.searchsorted(f_key, base + terms, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            size = min(p.block, rows - c * p.block)
            s = np.bincount(f_row[at] - c * p.block, f_imp[at] * np.repeat(weights, n), size).astype(np.int64)
            hit = np.flatnonzero(s > 0)
            best.add(q, s[hit], doc[c * p.block + hit])
            scored += 1
    return scored


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_col: str = "text", p: Params = Params()) -> DataFrame:
    """Rows query_id, rank (from 1), doc_id, score (scaled) of the k best documents of each query."""
    spark = docs.sparkSession
    wanted = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_col).cast("string").alias("t")).filter("q is not null")
    out, held = None, []

    def group(rows: list[tuple]) -> DataFrame:
        qs = spark.sparkContext.broadcast(parse(rows))
        vocab = spark.sparkContext.broadcast(qs.value.vocab)
        n, mean, df = statistics(docs, text_col, vocab)
        known = spark.sparkContext.broadcast(df)
        schema = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

        def run(batches):
            q = qs.value
            best = Best(len(q.ids), p.k)
            for b in batches:
                for s in slices(b, 1):
                    t = tokenize(s.column(1))
                    row, term, tf = forward(t, q.vocab)
                    length = np.diff(t.first)
                    ids = s.column(0).fill_null(NONE).to_numpy()
                    search_slice(best, q, ids, row, term, impacts(tf, length[row], known.value[term], n, mean, p), p)
            got = [(q.ids[i], d, s) for i in range(len(q.ids)) for d, s in zip(best.doc[i].tolist(), best.score[i].tolist())]
            yield arrays(schema, [g[0] for g in got], pa.array([None if g[1] == NONE else g[1] for g in got], pa.int64()), [g[2] for g in got])

        return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "q long, doc_id long, score long")

    for r in wanted.distinct().orderBy("q", "t").toLocalIterator():
        held.append((r.q, r.t))
        if len(held) == p.query_group:
            part = group(held)
            out, held = part if out is None else out.unionByName(part), []
    if held or out is None:
        part = group(held)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", rank).filter(F.col("rank") <= p.k).select(F.col("q").alias("query_id"), "rank", "doc_id", "score")


def sql(p: Params = Params()) -> str:
    """DuckDB SQL of :func:`search` over documents and benchmark, by brute force."""
    fold = "lower(regexp_replace(text, '[\\x{80}-\\x{BF}\\x{D7}\\x{F7}\\x{2000}-\\x{207F}\\x{3000}-\\x{303F}]', ' ', 'g'))"
    words = f"regexp_extract_all({fold}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT doc_id, unnest({words}) AS w FROM documents),
len AS (SELECT doc_id, count(*) AS dl FROM d GROUP BY doc_id),
st AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS mean FROM len),
q AS (SELECT item_id AS query_id, w, count(*) AS qn FROM (SELECT item_id, unnest({words}) AS w FROM benchmark) GROUP BY item_id, w),
tf AS (SELECT d.doc_id, d.w, count(*) AS tf FROM d WHERE d.w IN (SELECT w FROM q) GROUP BY d.doc_id, d.w),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
imp AS (
  SELECT tf.doc_id, tf.w, CAST(floor({p.scale} * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * ({p.k1} + 1) / (tf.tf + {p.k1} * (1 - {p.b} + {p.b} * len.dl / st.mean)) + 0.5) AS BIGINT) AS impact
  FROM tf JOIN df USING (w) JOIN len USING (doc_id) CROSS JOIN st),
s AS (SELECT q.query_id, imp.doc_id, CAST(sum(q.qn * imp.impact) AS BIGINT) AS score FROM q JOIN imp USING (w) GROUP BY q.query_id, imp.doc_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= {p.k}"""
