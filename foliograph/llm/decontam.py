"""Benchmark decontamination by a generalised suffix automaton.

One suffix automaton over token numbers holds all test items.  The tokens of a
text are streamed through it and the longest match ending at each token is
tracked; a maximal match is contaminated when it has at least ``min_tokens``
tokens, or covers at least ``coverage`` of the shortest item that contains it
(and has at least ``floor`` tokens).  The bytes from a contaminated match's
first token to its last are removed; what stays on either side is joined by one
space.

Before streaming, runs of tokens whose neighbours all follow one another
somewhere in the items are found with NumPy; no match of two or more tokens can
leave such a run, so the automaton sees only those, without any change of result.

The items are gathered in shards of at most ``shard_tokens`` tokens (a longer
item is one by itself): each shard is one automaton, as flat arrays.  A pass
over the texts holds ``together`` of them, some 400 MB; a longer benchmark takes
several passes, and the spans that they find are cut out by the last.

Defined results: a null text stays null and an empty one empty; NULL or
wordless items match nothing; repeated items count once; without items no text
changes; texts with nothing removed are unchanged byte for byte; repeated rows
are treated one by one; other columns are ignored (``spans``) or kept
(``clean``; n_chars, where it exists and is named, follows the new text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._run import table
from ._tok import Tokens, U64, mix, slices, tokenize


@dataclass(frozen=True)
class Params:
    min_tokens: int = 10
    coverage: float = 0.8
    floor: int = 6
    shard_tokens: int = 100_000
    together: int = 64  #: shards that a pass over the texts holds


class Automaton:
    """Suffix automaton of several token sequences; ``short[state]`` is the length of the shortest item that holds the state's strings."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.short = [-1], [0], [0]
        for seq in items:
            last = 0
            for c in seq:
                last = self._extend(last, c)
            at = 0
            for c in seq:  # every prefix, and through the links every suffix of it
                at = self.next[at][c]
                s = at
                while s > 0 and (self.short[s] == 0 or self.short[s] > len(seq)):
                    self.short[s] = len(seq)
                    s = self.link[s]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.len[q] == self.len[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(self.next)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        self.short.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.short.append(self.short[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def flat(self) -> Flat:
        """The finished automaton as arrays."""
        edges = sorted((s << 32 | c, t) for s, own in enumerate(self.next) for c, t in own.items())
        return Flat(np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int32), *(np.array(x, np.int32) for x in (self.link, self.len, self.short)))


@dataclass
class Flat:
    """An automaton as arrays: sorted edges (state << 32 | token) and where they lead; about 60 bytes a token of the items."""

    edge: np.ndarray
    to: np.ndarray
    link: np.ndarray
    len: np.ndarray
    short: np.ndarray

    def step(self, state: int, token: int) -> int:
        """The state after a token; -1 if there is none."""
        if token < 0 or not len(self.edge):
            return -1
        key = state << 32 | token
        i = int(np.searchsorted(self.edge, key))
        return int(self.to[i]) if i < len(self.edge) and self.edge[i] == key else -1

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """Maximal matches: first token, one past the last, and the state."""
        s = n = 0
        for i, c in enumerate(tokens):
            after = self.step(s, c)
            if after < 0:
                if n:
                    yield i - n, i, s
                while s > 0 and after < 0:
                    s = int(self.link[s])
                    n = int(self.len[s])
                    after = self.step(s, c)
            if after >= 0:
                s, n = after, n + 1
            else:
                n = 0
        if n:
            yield len(tokens) - n, len(tokens), s


@dataclass
class Shard:
    vocab: np.ndarray  #: sorted token hashes; a token's number is its place
    pairs: np.ndarray  #: sorted hashes of neighbouring tokens
    automaton: Flat
    singles: bool  #: some item is so short that a match of one token may count


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


def build(items: list[str], p: Params) -> Shard:
    t = tokenize(pa.array(items, pa.string()))
    vocab = np.unique(t.hash)
    number = np.searchsorted(vocab, t.hash)
    seqs = sorted({tuple(number[t.first[i] : t.first[i + 1]].tolist()) for i in range(len(items))} - {()})
    inner = t.doc[1:] == t.doc[:-1]
    pairs = np.unique(pair_hash(t.hash[:-1], t.hash[1:])[inner]) if len(t) > 1 else np.zeros(0, U64)
    return Shard(vocab, pairs, Automaton([list(s) for s in seqs]).flat(), min(p.floor, p.min_tokens) <= 1)


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def contaminated(t: Tokens, shard: Shard, p: Params) -> list[tuple[int, int, int]]:
    """(row, first token, one past the last token) of each contaminated match; token numbers are the batch's."""
    if not len(t) or not len(shard.vocab):
        return []
    least = max(1, min(p.floor, p.min_tokens))
    out = []
    if least == 1:
        cuts = t.first
        runs = [(a, z) for a, z in zip(cuts[:-1], cuts[1:]) if z > a]
    else:
        known = (t.doc[1:] == t.doc[:-1]) & member(shard.pairs, pair_hash(t.hash[:-1], t.hash[1:]))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
        a, z = edge[::2], edge[1::2] + 1
        ok = z - a >= least
        runs = zip(a[ok].tolist(), z[ok].tolist())
    short = shard.automaton.short
    for a, z in runs:
        h = t.hash[a:z]
        number = np.where(member(shard.vocab, h), np.searchsorted(shard.vocab, h), -1).tolist()
        for i, j, s in shard.automaton.matches(number):
            if j - i >= p.min_tokens or j - i >= p.floor and j - i >= p.coverage * short[s]:
                out.append((int(t.doc[a]), a + i, a + j))
    return out


def merged(found: list[tuple[int, int, int]], t: Tokens) -> dict[int, list[tuple[int, int]]]:
    """Byte spans (from the row's start) by row; overlapping ones are one."""
    by: dict[int, list[list[int]]] = {}
    for row, i, j in sorted(found):
        a, z = int(t.start[i] - t.offsets[row]), int(t.end[j - 1] - t.offsets[row])
        own = by.setdefault(row, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], z)
        else:
            own.append([a, z])
    return {r: [(a, z) for a, z in s] for r, s in by.items()}


def cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    parts, at = [], 0
    for a, z in spans:
        parts.append(raw[at:a].strip())
        at = z
    parts.append(raw[at:].strip())
    return b" ".join(x for x in parts if x).decode("utf-8", "replace")


def shards(benchmark: DataFrame, item_col: str, p: Params):
    """Broadcast automata, each of at most about ``shard_tokens`` tokens; the driver holds one shard's items at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item")).filter("item is not null").distinct()
    held, size = [], 0
    for r in items.orderBy("item").toLocalIterator():
        n = len(tokenize(pa.array([r.item])))
        if held and size + n > p.shard_tokens:
            yield spark.sparkContext.broadcast(build(held, p))
            held, size = [], 0
        if n:
            held.append(r.item)
            size += n
    if held:
        yield spark.sparkContext.broadcast(build(held, p))


def cut_out(docs: DataFrame, at: int, models: list, p: Params, finish, schema) -> DataFrame:
    """``docs`` streamed through all models, ``together`` at a time; ``finish(batch, spans by row)`` makes the rows of the result.

    Between passes the spans found so far stand in a column of their own behind
    the others, in a written table.
    """
    groups = [models[i : i + p.together] for i in range(0, len(models), p.together)] or [[]]
    width = len(docs.columns)

    def spans_of(batch: pa.RecordBatch, group: list) -> dict[int, list[tuple[int, int]]]:
        t = tokenize(batch.column(at))
        found = merged([x for m in group for x in contaminated(t, m.value, p)], t)
        if batch.num_columns > width:
            for row, old in enumerate(batch.column(width).to_pylist()):
                if old:
                    found[row] = joined([*found.get(row, ()), *zip(old[::2], old[1::2])])
        return found

    for group in groups[:-1]:
        def mark(batches, group=group):
            for b in batches:
                for s in slices(b, at, 1 << 21):
                    found = spans_of(s, group)
                    flat = pa.array([[x for span in found.get(i, ()) for x in span] for i in range(s.num_rows)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*s.columns[:width], flat], [f"c{i}" for i in range(width + 1)])

        named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(named.schema.fields[:width])] + [T.StructField(f"c{width}", T.ArrayType(T.LongType()))]
        docs = table(named.mapInArrow(mark, T.StructType(fields)), "spans")

    def run(batches):
        for b in batches:
            for s in slices(b, at, 1 << 21):
                yield finish(s, spans_of(s, groups[-1]))

    return docs.mapInArrow(run, schema)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], z)
        else:
            out.append((a, z))
    return out


def without(texts: pa.Array, found: dict[int, list[tuple[int, int]]]) -> list[str | None]:
    """The texts, the spans cut out."""
    new = texts.to_pylist()
    for row, own in found.items():
        new[row] = cut(new[row].encode(), own)
    return new


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row for each document: doc_id, text (without the spans), contaminated, removed_bytes."""

    def finish(s: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        gone = [sum(z - a for a, z in found.get(i, ())) for i in range(s.num_rows)]
        text = pa.array(without(s.column(1), found), pa.string()) if found else s.column(1)
        return pa.RecordBatch.from_arrays([s.column(0), text, pa.array([g > 0 for g in gone]), pa.array(gone, pa.int64())], ["doc_id", "text", "contaminated", "removed_bytes"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return cut_out(rows, 1, list(shards(benchmark, item_col, p)), p, finish, "doc_id long, text string, contaminated boolean, removed_bytes long")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "text", chars_col: str | None = "n_chars", p: Params = Params()) -> DataFrame:
    """All rows and columns of ``docs``, the spans cut out of ``text_col``; ``chars_col`` is the new number of characters of the rows that changed."""
    at, width, names = docs.columns.index(text_col), len(docs.columns), docs.columns
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def finish(s: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        cols = list(s.columns[:width])
        if found:
            new = without(cols[at], found)
            if chars is not None:
                old = cols[chars].to_pylist()
                cols[chars] = pa.array([len(new[i] or "") if i in found else o for i, o in enumerate(old)], cols[chars].type)
            cols[at] = pa.array(new, cols[at].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return cut_out(docs, at, list(shards(benchmark, item_col, p)), p, finish, docs.schema)
