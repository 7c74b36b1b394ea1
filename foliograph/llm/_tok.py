"""Vectorised tokenising of Arrow string columns, shared by the corpus operators.

A token is a maximal run of word characters.  Text is folded first: letters up
to U+07FF (Latin, Greek, Cyrillic, Armenian) lose their case where the lower one
is there as well.  Separators are every ASCII character that is not a letter or
digit, the Latin-1 signs U+0080-U+00BF, the multiplication and division signs,
the Arabic comma, semicolon, question mark and full stop, general punctuation
(U+2000-U+207F), CJK punctuation (U+3000-U+303F) and full-width punctuation
(U+FF01-U+FF0F); every other character belongs to a word.  ``py_tokens`` is the
same rule written per character, for brute-force checks.

Everything works on the UTF-8 buffer; folding in segments of bounded size.  The
tokens of a slice are held at once, so memory follows the longest single text
(about 40 bytes a token), not the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEG = 1 << 18
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)

_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[128:] = np.arange(128, 256)

#: Lower case of the characters of two bytes beyond Latin-1; 0 for a separator.
_LOWER = np.arange(0x800)
for _c in range(0x100, 0x800):
    if len(chr(_c).lower()) == 1 and 0x100 <= ord(chr(_c).lower()) < 0x800:
        _LOWER[_c] = ord(chr(_c).lower())
_LOWER[[0x60C, 0x61B, 0x61F, 0x6D4]] = 0

#: What a text with any token has, for the JVM.
WORDY = "[0-9A-Za-z]|[^\\x00-\\xbf\u00d7\u00f7\u2000-\u207f\u3000-\u303f\uff01-\uff0f\u060c\u061b\u061f\u06d4]"

_powers: dict[str, np.ndarray] = {}


def _power(which: int, n: int) -> np.ndarray:
    key = str(which)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, _SEG * 2)
        a = np.full(size, which, U64)
        a[0] = 1
        _powers[key] = have = np.multiply.accumulate(a)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all others."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def fold(raw: np.ndarray) -> np.ndarray:
    """Folded bytes; 0 marks a separator."""
    f = _FOLD[raw]
    if len(raw) and raw.max() >= 0x80:
        nxt = np.empty_like(raw)
        nxt[:-1], nxt[-1] = raw[1:], 0
        i = np.flatnonzero(raw == 0xC3)
        b = nxt[i]
        up = i[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        f[up + 1] = raw[up + 1] + 0x20
        sign = i[(b == 0x97) | (b == 0xB7)]
        f[sign] = 0
        f[sign + 1] = 0
        i = np.flatnonzero(raw == 0xC2)
        f[i] = 0
        f[np.minimum(i + 1, len(f) - 1)] = 0
        i = np.flatnonzero((raw >= 0xC4) & (raw <= 0xDF) & (nxt >= 0x80))
        if len(i):
            c = (raw[i].astype(np.int32) & 0x1F) << 6 | nxt[i] & 0x3F
            low = _LOWER[c]
            f[i] = np.where(low > 0, 0xC0 | low >> 6, 0)
            f[i + 1] = np.where(low > 0, 0x80 | low & 0x3F, 0)
        i = np.flatnonzero((raw == 0xEF) & (nxt == 0xBC))
        last = raw[np.minimum(i + 2, len(raw) - 1)]
        i = i[(last >= 0x81) & (last <= 0x8F)]
        for k in range(3):
            f[np.minimum(i + k, len(f) - 1)] = 0
        i = np.flatnonzero((raw == 0xE2) & ((nxt == 0x80) | (nxt == 0x81)) | (raw == 0xE3) & (nxt == 0x80))
        for k in range(3):
            f[np.minimum(i + k, len(f) - 1)] = 0
    return f


@dataclass
class Tokens:
    """Tokens of a batch: byte spans, hash and row of each, and ``first[row]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    raw: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def _segments(raw: np.ndarray, offsets: np.ndarray):
    """Cut points at which no token is divided."""
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + _SEG)
        while b < n:
            k = np.searchsorted(offsets, b)
            stop = int(offsets[k]) if k < len(offsets) else n
            piece = raw[b : min(n, b + 4096)]
            hit = np.flatnonzero((piece < 0x80) & (_FOLD[piece] == 0))
            here = b + int(hit[0]) if len(hit) else n + 1
            if min(here, stop) <= b + 4096 and min(here, stop) <= n:
                b = min(here, stop)
                break
            b = min(n, b + 4096)
        yield a, b
        a = b


def tokenize(col: pa.Array) -> Tokens:
    raw, offsets = buffers(col)
    starts, ends, hashes = [], [], []
    inner = np.unique(offsets[1:-1]) if len(offsets) > 2 else np.zeros(0, np.int64)
    for a, b in _segments(raw, offsets):
        f = fold(raw[a:b])
        word = f != 0
        prev = np.empty_like(word)
        prev[0], prev[1:] = False, word[:-1]
        cuts = inner[np.searchsorted(inner, a) : np.searchsorted(inner, b)] - a
        prev[cuts] = False
        s = np.flatnonzero(word & ~prev)
        if not len(s):
            continue
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        cuts = cuts[cuts > 0]
        after[cuts - 1] = False
        e = np.flatnonzero(word & ~after) + 1
        h = np.add.reduceat(f * _power(_R, b - a)[: b - a], s)
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(h * _power(_R_INV, b - a)[s] + (e - s).astype(U64)))
    z = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else z
    end = np.concatenate(ends) if ends else z
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Tokens(start, end, h, doc, first, offsets, raw)


def slices(batch: pa.RecordBatch, text_col: int | str, limit: int = 1 << 23, rows: int = 1 << 30):
    """Row slices of a batch of about ``limit`` text bytes and at most ``rows`` rows, one row at least."""
    col = batch.column(text_col)
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        base = total[a - 1] if a else 0
        b = max(a + 1, min(a + rows, int(np.searchsorted(total, base + limit, "right"))))
        yield batch.slice(a, b - a)
        a = b


def shingles(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first token of each k-shingle; a row of fewer tokens has one shingle of all of them."""
    n = len(t)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.diff(t.first)
    h = np.zeros(n, U64)
    mult = 1
    for j in range(k):
        part = t.hash[j:] * U64(mult)
        if j:
            part = np.where(t.doc[j:] == t.doc[: n - j], part, U64(0)) if n > j else part
        h[: max(0, n - j)] += part
        mult = mult * 0xD6E8FEB86659FD93 % (1 << 64)
    local = np.arange(n) - t.first[t.doc]
    keep = np.flatnonzero(local <= np.maximum(count[t.doc] - k, 0))
    return mix(h[keep]), t.doc[keep], keep


def permutations(perms: int, seed: int) -> np.ndarray:
    """Odd multipliers: permutations of the 64-bit numbers."""
    return np.random.default_rng(seed).integers(1, 1 << 63, perms, dtype=np.uint64) * U64(2) + U64(1)


def minmax(t: Tokens, rows: int, k: int, perms: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest rank of each row's k-shingles under each permutation (rows x 2*perms, uint32), and the number of shingles."""
    h, doc, _ = shingles(t, k)
    n = np.bincount(doc, minlength=rows)
    out = np.zeros((rows, 2 * perms), np.uint32)
    own = np.flatnonzero(n)
    if len(own):
        first = (np.cumsum(n) - n)[own]
        for i, a in enumerate(permutations(perms, seed)):
            rank = ((h * a) >> U64(32)).astype(np.uint32)
            out[own, 2 * i] = np.minimum.reduceat(rank, first)
            out[own, 2 * i + 1] = np.maximum.reduceat(rank, first)
    return out, n


def keys_of(values: np.ndarray, groups: int) -> np.ndarray:
    """One 64-bit key for each of ``groups`` equal parts of each row of values."""
    part = values.reshape(len(values), groups, -1).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, groups + 1, dtype=np.uint64) * U64(_R), part.shape[:2]).copy()
    for j in range(part.shape[2]):
        h = mix(h ^ part[:, :, j]) + U64(j)
    return h.view(np.int64)


def equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of each row of two arrays of 64-bit words agree."""
    low = U64(0x7F7F7F7F7F7F7F7F)
    x = a ^ b
    return np.bitwise_count(~(((x & low) + low) | x | low)).sum(1, dtype=np.int32)


def py_fold(c: str) -> str:
    """One character by the rule above; '' for a separator."""
    o = ord(c)
    if o < 0x80:
        return c.lower() if c.isalnum() else ""
    if 0x80 <= o <= 0xBF or o in (0xD7, 0xF7) or 0x2000 <= o <= 0x207F or 0x3000 <= o <= 0x303F or 0xFF01 <= o <= 0xFF0F or o in (0x60C, 0x61B, 0x61F, 0x6D4):
        return ""
    if 0x100 <= o < 0x800:
        return c.lower() if len(c.lower()) == 1 and 0x100 <= ord(c.lower()) < 0x800 else c
    return chr(o + 32) if 0xC0 <= o <= 0xDE else c


def py_tokens(text: str | None) -> list[str]:
    """Tokens by a plain loop over the characters, for checks of :func:`tokenize`."""
    out, word = [], []
    for c in [*(text or ""), " "]:
        if f := py_fold(c):
            word.append(f)
        elif word:
            out.append("".join(word))
            word = []
    return out
