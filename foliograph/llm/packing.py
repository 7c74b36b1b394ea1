"""Related-document packing: a nearest-neighbour graph, greedy paths through it, and windows filled along the paths.

Rows of equal min-max signature (of their neighbouring token pairs) are one
node, whose rows follow one another.  Candidates come from ``trees`` orders of
all nodes by some values of their signatures: in each order a node meets the
``near`` nodes on either side, so similar nodes, which share first values, meet,
whatever the number of nodes and however many share a value.  Of the candidates
that agree in ``least`` of the signature's bytes, the ``shortlist`` best of each
node (those below ``sure`` only among its ``neighbours`` best) are scored by the Jaccard similarity of their ``features`` least-hashed
token pairs (exact for texts of fewer), and the ``neighbours`` best of those
are its edges.  Recall is measured against brute force, see the README.

Linked nodes form cells: each goes with its best link (by similarity, then a
hash of the link).  In a cell, a walk starts at the unvisited node of least
degree (of all edges, also to other cells; ties: the lesser node) and goes on to
the most similar unvisited neighbour, in either direction of an edge, until
none is left.  Then cells are nodes, linked by the best of the edges between
them, and the same is done again until no link is left.  Levels of more than
``local_links`` links are worked out by Spark, smaller ones in one task, with
the same result.

Paths follow one another and fill windows of ``window`` tokens; a row that does
not fit goes on in the next window.  The whole walk is cut into buckets of about
``bucket_tokens`` tokens; the rows of a node of more are spread over several.
Only the last window of a bucket may be partly filled.

Defined results: a null, empty or wordless text has no token and is in no
window; a row without similar ones is a node alone; repeated rows are packed
each; a NULL doc_id is carried as NULL; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._run import arrays, forget, runs, table
from ._tok import U64, equal_bytes, keys_of, minmax, shingles, slices, tokenize


@dataclass(frozen=True)
class Params:
    window: int = 2048
    perms: int = 32  #: each gives two values of a signature
    trees: int = 24
    near: int = 96
    least: int = 6
    sure: int = 7
    features: int = 96
    shortlist: int = 32
    neighbours: int = 8
    seed: int = 3
    bucket_tokens: int = 4_000_000
    local_links: int = 400_000


def bottom(h: np.ndarray, doc: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least distinct hashes of each row, and their rows (in order)."""
    n = np.bincount(doc, minlength=rows)
    bound = np.where(n > 4 * k, (4.0 * k / np.maximum(n, 1)) * 2.0**64, 2.0**64)
    some = h.astype(np.float64) < bound[doc]

    def least(h, doc):
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        local = np.arange(len(doc)) - np.searchsorted(doc, np.arange(rows))[doc]
        return h[local < k], doc[local < k]

    a, d = least(h[some], doc[some])
    # too many repetitions: look at all of such a row
    few = (np.bincount(d, minlength=rows) < k) & (n > 4 * k)
    if few.any():
        again = few[doc]
        b, e = least(h[again], doc[again])
        a, d = np.concatenate([a[~few[d]], b]), np.concatenate([d[~few[d]], e])
        order = np.argsort(d, kind="stable")
        a, d = a[order], d[order]
    return a, d


def sketches(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """Written table of the rows with tokens: doc_id, n, node, sig (16 bits a value) and features (32 bits each)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.binary()), ("features", pa.binary())])

    def run(batches):
        for b in batches:
            for s in slices(b, 1, 1 << 20):
                rows = s.num_rows
                t = tokenize(s.column(1))
                sig, n = minmax(t, rows, 2, p.perms, p.seed)
                pair, own, _ = shingles(t, 2)
                f, of = bottom(pair, own, rows, p.features)
                ends = np.append(0, np.cumsum(np.bincount(of, minlength=rows))).astype(np.int32) * 4
                features = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer((f >> U64(32)).astype(np.uint32).tobytes())])
                yield arrays(schema, s.column(0), np.diff(t.first), keys_of(sig, 1)[:, 0], fixed(sig.astype(np.uint16)), features).filter(pa.array(n > 0))

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n long, node long, sig binary, features binary")
    return table(out, "sketches")


def fixed(rows: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    width = rows.shape[1] * rows.itemsize
    ends = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def flat(column: pa.Array, dtype) -> np.ndarray:
    """All bytes of a binary column as numbers."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype) if len(column) and data is not None else np.zeros(0, dtype)


def meetings(nodes: DataFrame, p: Params) -> DataFrame:
    """(a, b, m): the best ``shortlist`` candidates of each node by the number of equal bytes of the signatures; ``nodes`` is (node, sig)."""
    values = 2 * p.perms
    tree_schema = pa.schema([("tree", pa.int32()), ("k", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])
    edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("m", pa.int32())])

    def orders(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                s = b.slice(at, 2000)
                sig = flat(s.column(1), np.uint16).reshape(-1, values)
                for t in range(p.trees):
                    k = np.zeros(len(sig), U64)
                    for j in range(4):
                        k = (k << U64(16)) | sig[:, (t + j * (values // 4 + 1)) % values]
                    yield arrays(tree_schema, np.full(len(sig), t), k.view(np.int64), s.column(0), fixed(sig.astype(np.uint8)))

    def meet(batches):
        held = None
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                s = b.slice(at, 4000)
                now = [s.column(0).to_numpy(), s.column(2).to_numpy(), flat(s.column(3), np.uint8).reshape(s.num_rows, -1).view(U64)]
                if held is not None:
                    now = [np.concatenate(x) for x in zip(held, now)]
                fresh = len(now[0]) - s.num_rows
                tree, node, sig = now
                found = []
                for d in range(1, p.near + 1):
                    first = max(0, fresh - d)
                    if first + d >= len(node):
                        break
                    m = equal_bytes(sig[first + d :], sig[first : len(sig) - d])
                    i = np.flatnonzero((m >= p.least) & (tree[first + d :] == tree[first : len(tree) - d]))
                    a, z = node[first + i], node[first + i + d]
                    found += [(a, z, m[i]), (z, a, m[i])]
                a, z, m = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                if len(a):
                    best = np.lexsort((a ^ z, -m, a))
                    a, z, m = a[best], z[best], m[best]
                    top = np.arange(len(a)) - np.searchsorted(a, a) < np.where(m < p.sure, p.neighbours, p.shortlist)
                    yield arrays(edge_schema, a[top], z[top], m[top].astype(np.int32))
                held = [x[-p.near :] for x in now]

    tree = nodes.mapInArrow(orders, "tree int, k long, node long, sig binary")
    met = tree.repartitionByRange("tree", "k", "node").sortWithinPartitions("tree", "k", "node").mapInArrow(meet, "a long, b long, m int")
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("m"), mark("a", "b")))
    return met.repartition("a").groupBy("a", "b").agg(F.max("m").alias("m")).withColumn("nth", nth).filter(F.col("nth") <= F.when(F.col("m") < p.sure, p.neighbours).otherwise(p.shortlist)).select("a", "b", "m")


def overlaps(own: np.ndarray, many: np.ndarray, other: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """Jaccard similarity of each pair of feature lists (all lists of one side joined, and their lengths), from the ``k`` least of both together."""
    rows = len(many)
    key = np.concatenate([own, other]).astype(U64) | np.concatenate([np.repeat(np.arange(rows), many), np.repeat(np.arange(rows), others)]).astype(U64) << U64(32)
    key.sort()
    new = np.append(True, key[1:] != key[:-1])
    twice = np.flatnonzero(~new) - 1
    both = np.zeros(len(key), bool)
    both[twice] = True
    key, both = key[new], both[new]
    row = (key >> U64(32)).astype(np.int64)
    use = np.arange(len(row)) - np.searchsorted(row, row) < k
    return np.bincount(row[use], both[use], rows) / np.maximum(np.bincount(row[use], minlength=rows), 1)


def neighbours(nodes: DataFrame, p: Params) -> DataFrame:
    """Directed edges (a, b, s) to the most similar nodes; ``nodes`` is (node, sig, features)."""
    pairs = meetings(nodes.select("node", "sig"), p).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    fa, fb = (nodes.select(F.col("node").alias(c), F.col("features").alias("f" + c)) for c in "ab")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64())])

    def score(batches):
        for x in batches:
            for at in range(0, x.num_rows, 4000):
                s = x.slice(at, 4000)
                lists = []
                for c in (2, 3):
                    ends = np.frombuffer(s.column(c).buffers()[1], np.int32)[s.column(c).offset : s.column(c).offset + s.num_rows + 1]
                    lists += [flat(s.column(c), np.uint32), np.diff(ends) // 4]
                j = np.round(overlaps(*lists, p.features), 6)
                ok = j > 0
                a, b, j = s.column(0).to_numpy()[ok], s.column(1).to_numpy()[ok], j[ok]
                yield arrays(schema, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([j, j]))

    scored = pairs.join(fa, "a").join(fb, "b").select("a", "b", "fa", "fb").mapInArrow(score, "a long, b long, s double")
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), mark("a", "b")))
    return scored.withColumn("nth", nth).filter(F.col("nth") <= p.neighbours).select("a", "b", "s")


def mark(a: str, b: str) -> Column:
    """A number of the link, the same in both directions."""
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def walk(node: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray, outside: np.ndarray | None = None) -> list[int]:
    """Nodes of a cell in the order of its greedy low-degree-first paths; (a, b, s) are edges with both ends in ``node``, ``outside`` counts each node's others."""
    near: dict[int, dict[int, float]] = {int(v): {} for v in node}
    for x, y, w in zip(a.tolist(), b.tolist(), s.tolist()):
        near[x][y] = near[y][x] = w
    sorted_near = {v: sorted(e, key=lambda u: (-e[u], u)) for v, e in near.items()}
    at = dict.fromkeys(near, 0)
    seen: set[int] = set()
    out: list[int] = []
    more = dict(zip(node.tolist(), outside.tolist())) if outside is not None else dict.fromkeys(near, 0)
    for start in sorted(near, key=lambda v: (len(near[v]) + more[v], v)):
        v = start
        while v is not None and v not in seen:
            seen.add(v)
            out.append(v)
            own, i = sorted_near[v], at[v]
            while i < len(own) and own[i] in seen:
                i += 1
            at[v] = i
            v = own[i] if i < len(own) else None
    return out


def walks(rows: DataFrame) -> DataFrame:
    """(node, cell, place) of (cell, node, b, s): edges, and for each node a row of NULL b and the number of its edges to other cells."""
    schema = pa.schema([("node", pa.int64()), ("cell", pa.int64()), ("place", pa.int64())])

    def run(batches):
        node, cell, place = [], [], []
        for c, v, b, s, edge in runs(batches, 5):
            edge = edge.astype(bool)
            order = walk(v[~edge], v[edge], b[edge], s[edge], s[~edge])
            node += order
            cell += [c[0]] * len(order)
            place += range(len(order))
            if len(node) > 50_000:
                yield arrays(schema, node, cell, place)
                node, cell, place = [], [], []
        yield arrays(schema, node, cell, place)

    rows = rows.select("cell", "node", F.coalesce("b", F.lit(0)).alias("b"), "s", F.col("b").isNotNull().alias("edge"))
    return rows.repartition("cell").sortWithinPartitions("cell", "node", "b").mapInArrow(run, "node long, cell long, place long")


def roots(links: DataFrame) -> DataFrame:
    """(node, root): nodes joined by their best links of (u, v, s, h); written."""
    best = links.groupBy(F.col("u").alias("node")).agg(F.max(F.struct("s", "h", "v")).alias("m")).select("node", F.col("m.v").alias("p"))
    best = table(best, "best")
    back = best.select(F.col("node").alias("p"), F.col("p").alias("back"))
    # the best of all links of a cell is the best one of both its ends: the lesser end is the root
    now = table(best.join(back, "p").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("p")), F.col("node")).otherwise(F.col("p")).alias("p")), "roots")
    forget(best)
    while True:
        up = now.select(F.col("node").alias("p"), F.col("p").alias("above"))
        after = table(now.join(up, "p").select("node", F.col("above").alias("p"), (F.col("above") != F.col("p")).alias("moved")), "roots")
        forget(now)
        now = after
        if not now.filter("moved").head(1):
            return now.select("node", F.col("p").alias("root"))


def level(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walks (node, cell, place) of the cells, and the links (u, v, s, h) of the cells; both written. ``links`` has both directions."""
    root = roots(links)
    ends = links.join(root.select(F.col("node").alias("u"), F.col("root").alias("cu")), "u").join(root.select(F.col("node").alias("v"), F.col("root").alias("cv")), "v")
    ends = table(ends, "ends")
    own = ends.groupBy(F.col("cu").alias("cell"), F.col("u").alias("node")).agg(F.count_if(F.col("cu") != F.col("cv")).cast("double").alias("s")).select("cell", "node", F.lit(None).cast("long").alias("b"), "s")
    inner = ends.filter("cu = cv").select(F.col("cu").alias("cell"), F.col("u").alias("node"), F.col("v").alias("b"), "s")
    best = ends.filter("cu <> cv").groupBy("cu", "cv").agg(F.max(F.struct("s", "h")).alias("m"))
    out = table(walks(own.unionByName(inner)), "walks"), table(best.select(F.col("cu").alias("u"), F.col("cv").alias("v"), "m.s", "m.h"), "links")
    forget(ends)
    return out


def line(u: np.ndarray, v: np.ndarray, s: np.ndarray, h: np.ndarray) -> list[tuple[int, list[int]]]:
    """Components of the links and the walk of each: what ``level`` does, on arrays and until no link is left."""
    paths = {x: [x] for x in np.unique(u).tolist()}
    done: list[list[int]] = []
    while len(u):
        ids, at = np.unique(u, return_inverse=True)
        to = np.searchsorted(ids, v)
        order = np.lexsort((h, s, at))
        p = to[order[np.append(np.flatnonzero(np.diff(at[order])), len(order) - 1)]]
        own = np.arange(len(ids))
        p = np.where((p[p] == own) & (own < p), own, p)
        while (p[p] != p).any():
            p = p[p]
        cu, cv = p[at], p[to]
        outside = np.bincount(at, cu != cv, len(ids))
        edge = np.flatnonzero(cu == cv)
        edge = edge[np.argsort(cu[edge], kind="stable")]
        member = np.argsort(p, kind="stable")
        cells = np.unique(p)
        a, z = np.searchsorted(p[member], cells), np.searchsorted(p[member], cells, side="right")
        ea, ez = np.searchsorted(cu[edge], cells), np.searchsorted(cu[edge], cells, side="right")
        linked = np.zeros(len(ids), bool)
        linked[cu[cu != cv]] = True
        after = {}
        for c, i, j, k, m in zip(cells.tolist(), a, z, ea, ez):
            e = edge[k:m]
            own = member[i:j]
            path = [x for n in walk(ids[own], u[e], v[e], s[e], outside[own]) for x in paths[n]]
            if linked[c]:
                after[int(ids[c])] = path
            else:
                done.append((int(ids[c]), path))
        paths = after
        keep = np.flatnonzero(cu != cv)
        cu, cv, s, h = ids[cu[keep]], ids[cv[keep]], s[keep], h[keep]
        order = np.lexsort((h, s, cv, cu))
        last = np.append((np.diff(cu[order]) != 0) | (np.diff(cv[order]) != 0), True) if len(order) else np.zeros(0, bool)
        u, v, s, h = (x[order[last]] for x in (cu, cv, s, h))
    return sorted(done)


def paths(edges: DataFrame, p: Params = Params()) -> DataFrame:
    """(node, component, place, unit, tail) of each linked node, written: a component's nodes in the order of (place, tail) are its walk; ``edges`` are (a, b, s)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "s").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "s"))
    links = table(both.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("h", mark("u", "v")), "links")
    found = links.select(F.col("u").alias("node"), F.col("u").alias("unit"), F.array().cast("array<long>").alias("tail")).distinct()
    written = [links]
    while links.count() > p.local_links:
        step, links = level(links)
        above = step.select(F.col("node").alias("unit"), F.col("cell").alias("above"), "place")
        found = found.join(above, "unit", "left").select("node", F.coalesce("above", "unit").alias("unit"), F.when(F.col("above").isNull(), F.col("tail")).otherwise(F.concat(F.array("place"), "tail")).alias("tail"))
        found = table(found, "found")
        forget(step, *written)
        written = [links, found]
    schema = pa.schema([("unit", pa.int64()), ("component", pa.int64()), ("place", pa.int64())])

    def run(batches):
        got = [[b.column(i).to_numpy() for i in range(4)] for b in batches if b.num_rows]
        for c, path in line(*(np.concatenate(x) for x in zip(*got))) if got else ():
            yield arrays(schema, path, np.full(len(path), c), np.arange(len(path)))

    last = links.coalesce(1).mapInArrow(run, "unit long, component long, place long")
    out = table(found.join(last, "unit", "left").select("node", F.coalesce("component", "unit").alias("component"), F.coalesce("place", F.lit(0)).alias("place"), "unit", "tail"), "paths")
    forget(*written)
    return out


def fill(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of rows laid end to end and cut every ``window`` tokens: row, window, first token, one past the last."""
    end = np.cumsum(sizes)
    start = end - sizes
    many = (end - 1) // window - start // window + 1
    row = np.repeat(np.arange(len(sizes)), many)
    w = (start // window)[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
    a = np.maximum(start[row], w * window)
    z = np.minimum(end[row], (w + 1) * window)
    return row, w, a - start[row], z - start[row]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row for each piece of a document in a window: window_id, slot, doc_id, start_token, end_token (one past the last), node."""
    sketched = sketches(docs, id_col, text_col, p)
    rows = table(sketched.select("doc_id", "n", "node"), "rows")
    nodes = table(sketched.groupBy("node").agg(F.min("sig").alias("sig"), F.min("features").alias("features"), F.sum("n").alias("tokens")), "nodes")
    forget(sketched)
    tokens = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    edges = table(neighbours(nodes, p), "edges")
    placed = paths(edges, p)
    forget(edges)
    buckets = max(1, -(-int(tokens) // p.bucket_tokens))
    spot = nodes.select("node", "tokens").join(placed, "node", "left").select("node", "tokens", F.coalesce("component", "node").alias("component"), F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("unit", "node").alias("unit"), F.coalesce("tail", F.array().cast("array<long>")).alias("tail"))
    # tokens before each node on its component's walk: those of the units before it, and those before it in its unit
    whole = Window.partitionBy("unit")
    spot = table(spot.withColumn("inside", F.sum("tokens").over(whole.orderBy("tail", "node")) - F.col("tokens")).withColumn("n", F.sum("tokens").over(whole)), "spots")
    units = spot.select("component", "place", "unit", "n").distinct()
    before = units.select("unit", (F.sum("n").over(Window.partitionBy("component").orderBy("place")) - F.col("n")).alias("before"))
    spot = spot.join(before, "unit").withColumn("at", F.col("before") + F.col("inside")).withColumn("parts", F.ceil(F.col("tokens") / p.bucket_tokens))
    bucket = F.pmod(F.pmod(F.xxhash64("component"), F.lit(buckets)) + F.floor(F.col("at") / p.bucket_tokens) + F.pmod(F.xxhash64("doc_id", "n"), F.col("parts")), F.lit(buckets)).cast("long")
    line = rows.select("doc_id", "n", "node").join(spot.select("node", "component", "at", "parts"), "node")
    line = line.select(bucket.alias("bucket"), "n", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "node", "component", "at")
    schema = pa.schema([("window_id", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for bucket, n, doc, none, node in runs(batches, 5):
            row, w, a, z = fill(n, p.window)
            slot = np.arange(len(w)) - np.searchsorted(w, w)
            yield arrays(schema, w | int(bucket[0]) << 32, slot, pa.array(doc[row], pa.int64(), mask=none[row].astype(bool)), a, z, node[row])

    return line.repartition("bucket").sortWithinPartitions("bucket", "component", "at", "node", "none", "id", "n").mapInArrow(run, "window_id long, slot int, doc_id long, start_token long, end_token long, node long")
