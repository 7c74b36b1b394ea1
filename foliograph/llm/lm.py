"""Bits per byte by online logistic context mixing.

A byte is coded as the binary decisions of its Huffman code (from the byte
counts of the whole corpus).  For every decision, predictors of the last
``orders`` bytes (2, 3 and 4) give the log-odds found in corpus counts.  A
mixer adds them with weights gated by how many of them know the context, and a
refinement (a table over the mixed log-odds, interpolated) corrects what it
says; both adapt online from the first byte of a text to its last, a step every
``block`` bytes, and of a 64th of the text so far when that is more.  The bits
of a text are the summed code lengths of its decisions.

Counts are gathered over all bytes of all rows, and no two contexts share one:
the table grows with the corpus and lies spread over hash ranges of contexts.
Rows are taken in blocks of about ``block_bytes`` bytes (a sixteenth of the
corpus, when that is less), as they are read.  A block sends the distinct
(context, byte) pairs of its texts with their counts, and gets back, for each,
the log-odds along the byte's code from the counts of all other blocks.  So
neither a text nor its block has helped to predict it; a copy of it in another
block has.

Defined results: a null or empty text has 0 bytes, 0 bits and NULL bits per
byte; repeated rows are scored one by one; any bytes can be scored; where all
rows are one block every prediction is even; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._run import arrays, runs, table
from ._tok import U64, mix


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (2, 3, 4)
    prior: float = 0.4
    block: int = 32
    rate: float = 0.02
    weight: float = 0.3
    cells: int = 24
    block_bytes: int = 4 << 20
    blocks: int = 16  #: at least
    part_bytes: int = 1 << 24  #: of the corpus, for each hash range of an order's contexts
    slice_bytes: int = 1 << 19


BITS = 9  #: of a symbol: the rank of a byte, or 0


@dataclass
class Code:
    """Huffman code: for each byte its length, and the bit at each depth.

    ``rank`` is a byte's place among the leaves, from 1 on (0 stands for what is
    before a text); a node at depth d is the ranks from ``low`` to ``high``,
    and a 1 leads to those from ``mid`` on.
    """

    length: np.ndarray
    bit: np.ndarray
    rank: np.ndarray
    low: np.ndarray
    mid: np.ndarray
    high: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """The code of the bytes that occur (ties by order of making); a byte alone has the empty code."""
    heap = [(int(c), b, b) for b, c in enumerate(counts) if c > 0]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    new = 256
    while len(heap) > 1:
        ca, _, a = heapq.heappop(heap)
        cb, _, b = heapq.heappop(heap)
        kids[new] = (a, b)
        heapq.heappush(heap, (ca + cb, new, new))
        new += 1
    length, rank = np.zeros(256, np.int32), np.zeros(256, np.int32)
    path: dict[int, list[tuple[int, int, int, int]]] = {}

    def leaves(v: int) -> int:
        return 1 if v < 256 else sum(map(leaves, kids[v]))

    stack = [(heap[0][2], 1, [])] if heap else []
    while stack:
        v, low, p = stack.pop()
        if v < 256:
            rank[v], length[v], path[v] = low, len(p), p
        else:
            mid, high = low + leaves(kids[v][0]), low + leaves(v)
            stack.append((kids[v][0], low, [*p, (0, low, mid, high)]))
            stack.append((kids[v][1], mid, [*p, (1, low, mid, high)]))
    depth = max([1, *map(len, path.values())])
    table = np.zeros((4, 256, depth), np.int32)
    for b, p in path.items():
        table[:, b, : len(p)] = np.array(p, np.int32).reshape(-1, 4).T
    return Code(length, table[0].astype(np.int8), rank, *table[1:])


def histogram(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each byte occurs in all rows."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    total += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    counts = np.zeros(256, np.int64)
    for r in docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r.byte] = r.n
    return counts


def blocked(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Written table of block, doc_id and the bytes of the text: rows as they are read, cut where ``size`` bytes are reached."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.binary())])

    def run(batches):
        block, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            own = []
            for n in (len(x or b"") for x in b.column(1).to_pylist()):
                if held and held + n > size:
                    block, held = block + 1, 0
                held += n
                own.append(block)
            yield arrays(schema, own, b.column(0), b.column(1))

    return table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(run, "block long, doc_id long, raw binary"), "blocks")


@dataclass
class Pairs:
    """The (context, byte) pairs of a block's texts at one order: sorted keys, the rank of each one's byte, counts, and the pair of each symbol."""

    key: np.ndarray
    rank: np.ndarray
    count: np.ndarray | None
    at: np.ndarray


def pairs(texts: list[bytes], code: Code, orders: tuple[int, ...], counted: bool = True, room: int = 4) -> tuple[np.ndarray, list[Pairs]]:
    """Places of the texts' bytes among the symbols, and the pairs of each order (those with no byte, before a text, have rank 0 and no counts).

    The context of order k at a symbol is the pair of order k-1 at the one before.  Pairs are numbered
    through a table of all that contexts and ranks could form, or by sorting where that has more than ``room`` places a symbol.
    """
    gap = max(orders)
    size = np.array([len(t) for t in texts], np.int64)
    sym = np.zeros(int(size.sum()) + gap * (len(texts) + 1), np.uint16)
    where = np.arange(size.sum()) + gap * (np.repeat(np.arange(len(texts)), size) + 1)
    sym[where] = code.rank[np.frombuffer(b"".join(texts), np.uint8)]
    low = U64(len(sym).bit_length())
    ranks = int(code.rank.max()) + 1
    pair, ids, out = np.zeros(len(sym), np.int64), np.zeros(1, U64), []
    for k in range(gap + 1):
        pair *= ranks
        pair += sym
        if len(ids) * ranks <= room * len(sym):
            seen = np.zeros(len(ids) * ranks, bool)
            seen[pair] = True
            found = np.flatnonzero(seen)
            number = np.empty(len(seen), np.int32)
            number[found] = np.arange(len(found), dtype=np.int32)
            at = number.take(pair)
            seen = number = None
        else:
            both = pair.view(U64)
            both <<= low
            both |= np.arange(len(sym), dtype=U64)
            both.sort()
            place = (both & ((U64(1) << low) - U64(1))).view(np.int64)
            both >>= low
            new = np.append(True, both[1:] != both[:-1])
            found = both[new].view(np.int64)
            at = np.empty(len(sym), np.int32)
            at[place] = np.cumsum(new, dtype=np.int32) - 1
        context = found // ranks
        rank = found - context * ranks
        ids = (ids[context] << U64(BITS)) | rank.astype(U64)
        if k in orders:
            many = np.bincount(at, minlength=len(found)) * (rank > 0) if counted else None
            out.append(Pairs(ids, rank, many, at))
        pair[0] = 0
        pair[1:] = at[:-1]
    return where, out


def parts_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of the context of each pair."""
    return (mix(key >> U64(BITS)) % U64(parts)).astype(np.int64)


def pack(key: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, byte planes apart, so that they compress."""
    step = np.diff(key, prepend=U64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(key), -1).T) for x in (step, count.astype(np.uint32))]
    return b"".join(p.tobytes() for p in planes)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    planes = np.frombuffer(data, np.uint8).reshape(12, n)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view(U64).ravel(), dtype=U64), np.ascontiguousarray(planes[8:].T).view(np.uint32).ravel().astype(np.int64)


def whole(messages: list[bytes]) -> bytes:
    """One message of several of one block: its rows may have been read by two tasks."""
    if len(messages) == 1:
        return messages[0]
    key, count = (np.concatenate(x) for x in zip(*map(unpack, messages)))
    key, at = np.unique(key, return_inverse=True)
    return pack(key, np.bincount(at, count).astype(np.int64))


def answers(messages: list[bytes], code: Code, prior: float) -> list[bytes]:
    """For each block's pairs of one hash range, the log-odds (in sixteenths, a byte each) along the code of the pair's byte, from the other blocks' counts."""
    got = [unpack(m) for m in messages]
    size = [len(k) for k, _ in got]
    key, count = (np.concatenate(x) for x in zip(*got))
    context, at = np.unique(key >> U64(BITS), return_inverse=True)
    rank = (key & U64((1 << BITS) - 1)).astype(np.int64)
    key = (at.astype(np.int64) << BITS) | rank
    # counts before each place: of all blocks, and of each block, whose number stands above the key
    every, of = np.unique(key, return_inverse=True)
    sums = np.append(0, np.cumsum(np.bincount(of, count, len(every)).astype(np.int64)))
    high = np.int64(int(len(context) << BITS).bit_length())
    block = np.repeat(np.arange(len(messages)), size) << high
    mine, own = np.append(0, np.cumsum(count)), block | key
    byte = np.zeros(257, np.int64)
    byte[code.rank] = np.arange(256)

    def walk(keys: np.ndarray, base: np.ndarray, total: np.ndarray):
        """Counts on the 0 and the 1 side of every node on the way to each key's byte, by depth; ``base`` is its context's first key."""
        b = byte[keys & ((1 << BITS) - 1)]
        first, last = (total[np.searchsorted(keys, base | e)] for e in (0, (1 << BITS) - 1))
        for d in range(code.bit.shape[1]):
            live = np.flatnonzero(code.length[b] > d)
            mid = total[np.searchsorted(keys, base[live] | code.mid[b[live], d])]
            yield live, mid - first[live], last[live] - mid
            one = code.bit[b[live], d] == 1
            first[live[one]], last[live[~one]] = mid[one], mid[~one]

    length = code.length[byte[rank]]
    out = np.zeros((len(key), code.bit.shape[1]), np.int8)
    whole_walk, own_walk = walk(every, every >> BITS << BITS, sums), walk(own, own >> BITS << BITS, mine)
    for d, ((u, zero, one), (live, less_zero, less_one)) in enumerate(zip(whole_walk, own_walk)):
        at = np.zeros(len(every), np.int32)
        at[u] = np.arange(len(u))
        at = at[of[live]]
        odds = np.log((one[at] - less_one + prior) / (zero[at] - less_zero + prior))
        out[live, d] = np.clip(np.rint(odds * 16), -127, 127)
    flat = out[np.arange(out.shape[1]) < length[:, None]]
    ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(size))]
    return [flat[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])]


def steps(longest: int, block: int) -> np.ndarray:
    """Where the steps of a text begin: every ``block`` bytes, or after a 64th of the text when that is more."""
    out, t = [], 0
    while t < longest:
        out.append(t)
        t += max(block, t // 64 // block * block)
    return np.array(out, np.int64)


@dataclass
class Decisions:
    """What is decided for each pair of the highest order, which fixes those of the lower ones.

    ``row`` has, for each decision of each pair, the log-odds of all orders and 1, all negated where the bit is 0; a pair's rows are
    ``length`` from ``start`` on.  ``gate`` counts the orders that have something to say at its first decision.
    """

    start: np.ndarray
    length: np.ndarray
    gate: np.ndarray
    row: np.ndarray


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places from each start on, ``length`` of them, one range after the other."""
    ends = np.cumsum(length)
    out = np.repeat(start - ends + length, length)
    out += np.arange(len(out))
    return out


def decisions(found: list[Pairs], got: dict[tuple[int, int], bytes], parts: list[int], code: Code, some: int = 1 << 18) -> Decisions:
    """The decisions of a block's pairs, with the answers to it by order and hash range; ``some`` pairs are laid out at a time."""
    byte = np.zeros(257, np.int64)
    byte[code.rank] = np.arange(256)
    lengths = np.append(0, code.length[byte[1:]]).astype(np.int64)
    lengths[1 + code.rank.max() :] = 0
    top = found[-1]
    length = lengths[top.rank]
    symbol = np.empty(len(top.key), np.int64)
    symbol[top.at] = np.arange(len(top.at))
    start = np.cumsum(length) - length
    row = np.empty((int(length.sum()), len(found) + 1), np.int8)
    gate = np.zeros(len(length), np.int64)
    slices = [slice(i, i + some) for i in range(0, len(length), some)]
    for k, f in enumerate(found):
        own = lengths[f.rank]
        begin = np.cumsum(own) - own
        odds = np.zeros(int(own.sum()), np.int8)
        part = np.where(f.rank > 0, parts_of(f.key, parts[k]), -1)
        for i in range(parts[k]):
            if (k, i) in got:
                asked = np.flatnonzero(part == i)
                odds[ranges(begin[asked], own[asked])] = np.frombuffer(got[k, i], np.int8)
        begin = begin[f.at[symbol]]
        has = np.flatnonzero(length)
        gate[has] += odds[begin[has]] != 0
        for c in slices:
            if length[c].any():
                row[start[c][0] : start[c][-1] + length[c][-1], k] = odds[ranges(begin[c], length[c])]
    sign, width = (code.bit * np.int8(2) - np.int8(1)).ravel(), code.bit.shape[1]
    for c in slices:
        if length[c].any():
            own = row[start[c][0] : start[c][-1] + length[c][-1]]
            own[:, -1] = sign[ranges(byte[top.rank[c]] * width, length[c])]
            own[:, :-1] *= own[:, -1:]
    return Decisions(start, length, gate, row)


def mixed(size: np.ndarray, pair: np.ndarray, d: Decisions, p: Params) -> np.ndarray:
    """Bits of some texts: their sizes, and the pairs of their bytes, one text after the other."""
    lanes, orders = len(size), d.row.shape[1] - 1
    if not len(pair) or not d.length[pair[0]]:  # no bytes, or only one kind of byte in the corpus
        return np.zeros(lanes)
    order = np.argsort(-size, kind="stable")
    long = size[order]
    lane = np.repeat(np.arange(lanes, dtype=np.int32), long)
    local = ranges(np.zeros(lanes, np.int64), long)
    begin = steps(int(long[0]), p.block)
    width = np.diff(begin, append=long[0])
    gates = orders + 1
    turn = np.repeat(np.arange(0, len(begin) * gates, gates, dtype=np.uint16 if len(begin) * gates < 1 << 16 else np.int64), width)[local]
    pair = pair[ranges((np.cumsum(size) - size)[order], long)]
    local = None
    # bytes by step, gate and text
    turn += d.gate.astype(turn.dtype)[pair]
    by = np.argsort(turn, kind="stable")
    pair, lane, turn = pair[by], lane[by], turn[by]
    by = None
    edge = np.flatnonzero(np.append(True, (lane[1:] != lane[:-1]) | (turn[1:] != turn[:-1])))
    many = d.length[pair]
    ends = np.cumsum(many)
    base = d.start[pair] - ends + many
    head = (ends - many)[edge]
    size_of = np.diff(head, append=ends[-1])
    step, gate = np.divmod(turn[edge].astype(np.int64), gates)
    who, row = lane[edge].astype(np.int64), gate * lanes + lane[edge]
    cut = np.searchsorted(step, np.arange(len(begin) + 1))
    edge, head = np.append(edge, len(pair)), np.append(head, ends[-1])
    pair = lane = turn = ends = None
    # texts are ordered by size, so those that a step has are the first ones
    live = np.searchsorted(-long, -begin)
    rates = (p.rate / 16 * p.block / np.maximum(p.block, np.append(width[:-1], p.block))).astype(np.float32) / 16
    table = d.row.view(f"V{gates}").ravel()
    line = np.arange(int(np.diff(head[cut]).max()))
    w = np.full((orders, gates * lanes), p.weight / 16, np.float32)
    refined = np.tile(np.linspace(-8, 8, p.cells).astype(np.float32), lanes)  # refined[lane * cells + cell]
    slope = np.append(np.diff(refined), np.float32(0))
    scale = np.float32((p.cells - 1) / 16)
    bits = np.zeros(lanes)
    for i, (c, e) in enumerate(zip(cut[:-1], cut[1:])):
        a, z = head[c], head[e]
        at, rows, counts, own = head[c:e] - a, row[c:e], size_of[c:e], slice(edge[c], edge[e])
        # the rows of the decisions of a byte stand together; they are signed, as is y but for the refinement's cell
        from_ = np.repeat(base[own] + a, many[own])
        from_ += line[: z - a]
        x = np.empty((gates, z - a), np.float32)
        x[:] = np.ascontiguousarray(table.take(from_).view(np.int8).reshape(-1, gates).T)
        x, s = x[:-1], x[-1]
        weights = w.take(rows, 1)
        y = np.repeat(weights, counts, 1)
        y *= x
        y = np.add.reduce(y, 0)
        np.clip(y, np.float32(-7.99), np.float32(7.99), out=y)
        part = y * s
        part += np.float32(8)
        part *= scale
        floor = np.floor(part)
        part -= floor
        cell = np.repeat(who[c:e] * p.cells, counts)
        cell += floor.astype(np.int32)
        r = slope.take(cell)
        r *= part
        r += refined.take(cell)
        r *= s
        np.exp(y, out=y)
        np.exp(r, out=r)
        # the two are averaged as log-odds
        cost = y * r
        np.sqrt(cost, out=cost)
        np.reciprocal(cost, out=cost)
        cost += np.float32(1)
        np.log(cost, out=cost)
        bits[: live[i]] += np.bincount(who[c:e], np.add.reduceat(cost, at), live[i])
        y += np.float32(1)
        x /= y
        w[:, rows] = weights + rates[i] * np.add.reduceat(x, at, 1)
        cell += part >= np.float32(0.5)
        r += np.float32(1)
        s /= r
        n = int(live[i]) * p.cells
        fix = np.bincount(cell, s, n)
        fix /= np.bincount(cell, minlength=n) + 6
        refined[:n] += fix
        np.subtract(refined[1:n], refined[: n - 1], out=slope[: n - 1])
    out = np.zeros(lanes)
    out[order] = bits * 1.4426950408889634
    return out


def block_bits(texts: list[bytes], got: dict[tuple[int, int], bytes], parts: list[int], code: Code, p: Params) -> np.ndarray:
    """Bits of each text of a block, with the answers to it by order and hash range."""
    where, found = pairs(texts, code, p.orders, counted=False)
    told = decisions(found, got, parts, code)
    pair = found[-1].at[where]
    where = found = None
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    bits = np.zeros(len(texts))
    group = first // p.slice_bytes
    for a, z in zip(*(np.searchsorted(group, np.unique(group), side=s) for s in ("left", "right"))):
        bits[a:z] = mixed(size[a:z], pair[first[a] : first[z - 1] + size[z - 1]], told, p)
    return bits


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row for each document: doc_id, bytes, bits, bits_per_byte."""
    counts = histogram(docs, text_col)
    code, total = huffman(counts), int(counts.sum())
    rows = blocked(docs, id_col, text_col, max(1, min(p.block_bytes, -(-total // p.blocks))))
    parts = [max(1, -(-total // p.part_bytes)) for _ in p.orders]
    asked = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
    told = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])

    def ask(batches):
        for block, raw in runs(batches, 2):
            for k, f in enumerate(pairs([x or b"" for x in raw], code, p.orders)[1]):
                use = f.count > 0
                key, count = f.key[use], f.count[use]
                part = parts_of(key, parts[k])
                for i in np.unique(part):
                    own = part == i
                    yield arrays(asked, [int(i) * len(p.orders) + k], block[:1], [pack(key[own], count[own])])

    def tell(batches):
        for part, block, data in runs(batches, 3):
            cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            own = [whole(list(x)) for x in np.split(data, cut[1:])]
            yield arrays(told, block[cut], part[cut], answers(own, code, p.prior))

    requests = rows.filter("length(raw) > 0").select("block", "raw").mapInArrow(ask, "part long, block long, data binary")
    replies = requests.repartition("part").sortWithinPartitions("part", "block").mapInArrow(tell, "block long, part long, data binary")
    both = replies.select("block", "part", F.lit(None).cast("long").alias("doc_id"), "data").unionByName(rows.select("block", F.lit(-1).cast("long").alias("part"), "doc_id", F.col("raw").alias("data")))
    out = pa.schema([("doc_id", pa.int64()), ("bytes", pa.int64()), ("bits", pa.float64()), ("bits_per_byte", pa.float64())])

    def solve(batches):
        for _, part, doc, none, data in runs(batches, 5):
            text = part < 0
            texts = [x or b"" for x in data[text]]
            got = {(int(i) % len(p.orders), int(i) // len(p.orders)): x for i, x in zip(part[~text], data[~text])}
            bits, n = block_bits(texts, got, parts, code, p), np.array([len(t) for t in texts], np.int64)
            yield arrays(out, pa.array(doc[text], mask=none[text].astype(bool)), n, bits, pa.array(np.where(n > 0, bits / np.maximum(n, 1), 0.0), mask=n == 0))

    line = both.select("block", "part", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "data")
    return line.repartition("block").sortWithinPartitions("block", "part").mapInArrow(solve, "doc_id long, bytes long, bits double, bits_per_byte double")
