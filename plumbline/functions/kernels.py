"""Dynamic programs, bit kernels and small-graph algorithms that have no
relational form.  Each works on one value, one pair or one bounded network; the
``udfs`` and ``operators`` modules apply them to columns and groups."""

from __future__ import annotations

import heapq
import struct
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
# Fixed values of the MinHash definition: seed, increment, FNV-1a and the two
# multipliers of the 64-bit finaliser.
MINHASH_SEED = 0x4D595DF4D0F33173
GAMMA = 0x9E3779B97F4A7C15
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SIGNATURE = 128
NO_VALUE = (1 << 63) - 1


# ------------------------------------------------------------------ MinHash
def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(MIX_A)
    x = (x ^ (x >> _U(27))) * _U(MIX_B)
    return x ^ (x >> _U(31))


def minhash_salts(size: int = SIGNATURE, seed: int = MINHASH_SEED) -> np.ndarray:
    steps = np.arange(1, size + 1, dtype=_U) * _U(GAMMA) + _U(seed)
    return _finish(steps)


def shingle_hashes(shingles: Sequence[str]) -> np.ndarray:
    """FNV-1a over the UTF-16 code units (low byte, then high byte), length
    mixed in; all shingles advance together, longest first."""
    units = [np.frombuffer(s.encode("utf-16-le", "surrogatepass"), np.uint8) for s in shingles]
    lengths = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([units[i] for i in order]) if len(units) else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
    h = np.full(len(units), FNV_OFFSET, _U)
    alive = len(units) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    for t, n in enumerate(alive):
        h[:n] = (h[:n] ^ flat[starts[:n] + t]) * _U(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = _finish(h ^ (lengths[order] // 2).astype(_U))
    return out


def minhash(shingles: Sequence[str], salts: np.ndarray) -> np.ndarray:
    """Signature as non-negative int64; all NO_VALUE for no shingles."""
    if not len(shingles):
        return np.full(len(salts), NO_VALUE, np.int64)
    base = shingle_hashes(sorted(set(shingles)))
    out = np.full(len(salts), NO_VALUE, np.int64)
    for lo in range(0, len(base), 2048):
        mixed = _finish(base[lo : lo + 2048, None] ^ salts[None, :]) & _U(NO_VALUE)
        out = np.minimum(out, mixed.min(axis=0).astype(np.int64))
    return out


def minhash_rows(rows: Sequence[Sequence[str]], salts: np.ndarray, at_once: int = 8192) -> np.ndarray:
    """Signatures of many lists of shingles, a row each: the lists of some
    ``at_once`` shingles are hashed as one."""
    out = np.full((len(rows), len(salts)), NO_VALUE, np.int64)
    lengths = np.array([len(r) for r in rows], np.int64)
    group = np.cumsum(lengths) // at_once
    for g in np.unique(group[lengths > 0]):
        here = np.flatnonzero((group == g) & (lengths > 0))
        if len(here) == 1:
            out[here[0]] = minhash(rows[here[0]], salts)
            continue
        base = shingle_hashes([s for i in here for s in rows[i]])
        starts = np.cumsum(lengths[here]) - lengths[here]
        for k in range(0, len(salts), 16):
            mixed = _finish(base[:, None] ^ salts[None, k : k + 16]) & _U(NO_VALUE)
            out[here, k : k + 16] = np.minimum.reduceat(mixed, starts, axis=0).astype(np.int64)
    return out


def window_hashes(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` of each ``width`` words in a row of lists of words, and
    the bounds of the lists' shingles.  ``data`` and ``offsets`` are the UTF-8 bytes
    of all words, ``bounds`` those of the lists in words.  The shingles are hashed
    where they stand, none is made as a string."""
    lens = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    units = np.full(at[-1], 0x20, np.uint8)
    units[np.arange(offsets[0], offsets[-1]) - offsets[0] + np.repeat(np.arange(len(lens)), lens)] = data[offsets[0] : offsets[-1]]
    plain = not (units & 0x80).any()
    if not plain:
        of_byte = (units & 0xC0 != 0x80).astype(np.int64) + (units >= 0xF0)
        at = np.concatenate([[0], np.cumsum(of_byte)])[at]
        units = np.frombuffer(units.tobytes().decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass"), np.uint16)
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    upto = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(upto[-1]) + np.repeat(bounds[:-1] - bounds[0] - upto[:-1], counts)
    starts, lengths = at[first], at[first + width] - 1 - at[first]
    order = np.argsort(-lengths, kind="stable")
    starts, h = starts[order], np.full(len(order), FNV_OFFSET, _U)
    alive = len(h) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    for t, n in enumerate(alive):
        u = units[starts[:n] + t].astype(_U)
        # The high byte of a plain letter is 0: it multiplies alone.
        h[:n] = (h[:n] ^ u) * _U(FNV_PRIME**2 % (1 << 64)) if plain else (((h[:n] ^ (u & _U(255))) * _U(FNV_PRIME)) ^ (u >> _U(8))) * _U(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = _finish(h ^ lengths[order].astype(_U))
    return out, upto


def counted_pairs(parts: list[pa.RecordBatch], at_once: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``(a, b, both, na, nb)`` of the pairs of whole cells (cell, a, b, n, c), in
    which a row without b is the set of a.  The members of some ``at_once`` of a
    pair's smaller sets are looked up in the larger ones at a time."""
    rows = pa.Table.from_batches(parts)
    paired, sets = rows.filter(pc.is_valid(rows["b"])), rows.filter(pc.is_null(rows["b"]))
    cells, ids = (np.unique(rows[c].to_numpy()) for c in ("cell", "a"))
    ids = np.union1d(ids, paired["b"].to_numpy())
    key = lambda cell, pos: np.searchsorted(cells, cell.to_numpy()) * len(ids) + np.searchsorted(ids, pos.to_numpy())
    own = key(sets["cell"], sets["a"])
    order = np.argsort(own, kind="stable")
    own, n, lists = own[order], sets["n"].to_numpy()[order].astype(np.int64), sets["c"].combine_chunks().take(pa.array(order))
    # A document has a set of each of its rows: a pair meets them all.
    a, b = paired["a"].to_numpy(), paired["b"].to_numpy()
    x, i = _ranges(own, key(paired["cell"], paired["a"]))
    y, j = _ranges(own, key(paired["cell"], paired["b"])[i])
    x, i = x[j], i[j]
    a, b = a[i], b[i]
    members, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    of_set = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    known = np.unique(of_set * len(members) + code)
    code, size = known % max(1, len(members)), np.bincount(known // max(1, len(members)), minlength=len(lists))
    first = np.cumsum(size) - size
    few, many = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
    upto = np.concatenate([[0], np.cumsum(size[few])])
    both, lo = np.zeros(len(x), np.int64), 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + at_once, "right")) - 1)
        row = np.repeat(np.arange(lo, hi), size[few[lo:hi]])
        asked = many[row] * len(members) + code[first[few[row]] + np.arange(len(row)) - (upto[row] - upto[lo])]
        hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked if len(known) else np.zeros(0, bool)
        both[lo:hi] = np.bincount(row[hit] - lo, minlength=hi - lo)
        lo = hi
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, both, n[x], n[y])], ["a", "b", "both", "na", "nb"])


def _ranges(ordered: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of each of ``asked`` in ``ordered``, with the place of the asked one."""
    lo, hi = np.searchsorted(ordered, asked, "left"), np.searchsorted(ordered, asked, "right")
    of = np.repeat(np.arange(len(asked)), hi - lo)
    return np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo), of


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words ``data[start:end]``, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left, h = ends - starts, (ends - starts).astype(_U) * _U(GAMMA)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
    here, k = np.arange(len(starts)), 0
    while len(here):
        h[here] = _finish(h[here] ^ (eight[starts[here] + 8 * k] & masks[np.minimum(left[here] - 8 * k, 8)]))
        k += 1
        here = here[left[here] > 8 * k]
    return h


def word_windows(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``width`` words in a row of lists of words, given by the
    words' hashes, and the bounds of the lists' windows."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    upto = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(upto[-1]) + np.repeat(bounds[:-1] - upto[:-1], counts)
    h = np.zeros(len(first), _U)
    for k in range(width):
        h = _finish(h * _U(GAMMA) + words[first + k])
    return h, upto


def words_of(data: np.ndarray, offsets: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts with single blanks between words, but for
    those of a hash ``left_out``, and the bounds of the texts' words."""
    solid = np.append(data[offsets[0] : offsets[-1]] != 0x20, False)
    seam = np.zeros(len(solid), bool)
    seam[offsets - offsets[0]] = True
    before = np.append(False, solid[:-1])
    starts = np.flatnonzero(solid & (~before | seam))
    ends = np.flatnonzero(before & (~solid | seam))
    h = word_hashes(data[offsets[0] : offsets[-1]], starts, ends)
    kept = ~np.isin(h, left_out)
    return h[kept], np.searchsorted(starts[kept], offsets - offsets[0])


def minhash_lists(base: np.ndarray, upto: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Signatures of lists of hashed shingles, a row each."""
    out = np.full((len(upto) - 1, len(salts)), NO_VALUE, np.int64)
    here = np.flatnonzero(np.diff(upto))
    if len(here):
        for k in range(0, len(salts), 16):
            mixed = _finish(base[:, None] ^ salts[None, k : k + 16]) & _U(NO_VALUE)
            out[here, k : k + 16] = np.minimum.reduceat(mixed, upto[here], axis=0).astype(np.int64)
    return out


# ------------------------------------------------------------------ sequences
def _codes(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    known: dict = {}
    return tuple(np.array([known.setdefault(x, len(known)) for x in s], np.int64) for s in (a, b))


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, bit-parallel over one big integer."""
    if not a or not b:
        return 0
    places: dict = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = row & places.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def lcs_sequence(a: Sequence, b: Sequence) -> list:
    """One longest common subsequence; going back, up is taken when it is at
    least as long as left."""
    x, y = _codes(a, b)
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):
        step = np.maximum(table[i, 1:], np.where(y == x[i], table[i, :-1] + 1, 0))
        table[i + 1, 1:] = np.maximum.accumulate(step)
    i, j, out = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def edit_distance(a: Sequence, b: Sequence) -> int:
    x, y = _codes(a, b)
    if not len(x) or not len(y):
        return max(len(x), len(y))
    at = np.arange(len(y) + 1)
    row = at.copy()
    for i, v in enumerate(x, 1):
        step = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (y != v)]))
        row = np.minimum.accumulate(step - at) + at
    return int(row[-1])


def edit_similarity(a: Sequence, b: Sequence) -> float:
    longest = max(len(a), len(b))
    return 1.0 if longest == 0 else 1.0 - edit_distance(a, b) / longest


def local_alignment(a: Sequence, b: Sequence, match: int = 3, mismatch: int = -2, gap: int = -2) -> tuple[int, float, int, int, int, int]:
    """Smith-Waterman with linear gaps: (score, score / best possible, start
    and end in a, start and end in b), ends exclusive.  The first cell of the
    highest score in row order is taken; going back, up beats the diagonal and
    left beats both only if strictly better."""
    if match <= 0 or mismatch > 0 or gap >= 0:
        raise ValueError("match is positive, mismatch not positive, gap negative")
    x, y = _codes(a, b)
    if not len(x) or not len(y):
        return 0, 0.0, 0, 0, 0, 0
    h = np.zeros((len(x) + 1, len(y) + 1), np.int64)
    ramp = gap * np.arange(len(y) + 1)
    for i, v in enumerate(x, 1):
        cell = np.maximum(h[i - 1] + gap, 0)
        cell[1:] = np.maximum(cell[1:], h[i - 1, :-1] + np.where(y == v, match, mismatch))
        cell[0] = 0
        h[i] = np.maximum.accumulate(cell - ramp) + ramp
    best = int(h.max())
    if best == 0:
        return 0, 0.0, 0, 0, 0, 0
    i, j = (int(v) for v in np.unravel_index(int(h.argmax()), h.shape))
    end_a, end_b = i, j
    while h[i, j] > 0:
        diagonal = h[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else mismatch)
        up, left = h[i - 1, j] + gap, h[i, j - 1] + gap
        if diagonal >= up and diagonal >= left:
            i, j = i - 1, j - 1
        elif up >= left:
            i -= 1
        else:
            j -= 1
    return best, min(1.0, best / (match * min(len(x), len(y)))), i, end_a, j, end_b


def z_array(s: Sequence) -> list[int]:
    z, lo, hi = [0] * len(s), 0, 0
    for i in range(1, len(s)):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def prefix_function(s: Sequence) -> list[int]:
    p = [0] * len(s)
    for i in range(1, len(s)):
        k = p[i - 1]
        while k and s[i] != s[k]:
            k = p[k - 1]
        p[i] = k + (s[i] == s[k])
    return p


class Automaton:
    """All occurrences of many patterns in one scan.  Hits come by end, at one
    end from the longest pattern to the shortest, equal patterns by index."""

    def __init__(self, patterns: Sequence[str]) -> None:
        if any(not p for p in patterns):
            raise ValueError("patterns are not empty")
        self.next: list[dict[str, int]] = [{}]
        self.own: list[list[int]] = [[]]
        self.patterns = list(patterns)
        for k, p in enumerate(patterns):
            node = 0
            for c in p:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.own.append([])
                node = self.next[node][c]
            self.own[node].append(k)
        self.back = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            node = todo.popleft()
            for c, child in self.next[node].items():
                f = self.back[node]
                while f and c not in self.next[f]:
                    f = self.back[f]
                self.back[child] = self.next[f].get(c, 0)
                todo.append(child)

    def find(self, text: str) -> Iterable[tuple[int, int]]:
        """(start, pattern index) of every hit."""
        node = 0
        for end, c in enumerate(text, 1):
            while node and c not in self.next[node]:
                node = self.back[node]
            node = self.next[node].get(c, 0)
            at = node
            while at:
                for k in self.own[at]:
                    yield end - len(self.patterns[k]), k
                at = self.back[at]


def normalize_with_offsets(text: str) -> tuple[str, list[int]]:
    """The normal form and, for each of its characters, the place in the
    original that it comes from, both in code points; a separating space comes
    from the first separator of its run."""
    out: list[str] = []
    offsets: list[int] = []
    pending = -1
    for at, c in enumerate(text):
        if c.isalpha() or c.isdecimal():
            if pending >= 0 and out:
                out.append(" ")
                offsets.append(pending)
            pending = -1
            out.append(c.lower() if len(c.lower()) == 1 else "i")
            offsets.append(at)
        elif pending < 0:
            pending = at
    return "".join(out), offsets


# ------------------------------------------------------------------ Huffman
_MAGIC = b"HPD\x01"


class CorruptArchive(ValueError):
    """Bytes that no compressor of this format has written."""


def _huffman_codes(counts: dict[int, int]) -> dict[int, str]:
    """Lowest frequency first, ties to the smaller least symbol; the first of
    two joined trees gets 0."""
    heap: list[tuple[int, int, object]] = [(n, s, s) for s, n in counts.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, s, x), (m, t, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n + m, min(s, t), (x, y)))
    codes: dict[int, str] = {}
    stack = [(heap[0][2], "")] if heap else []
    while stack:
        tree, code = stack.pop()
        if isinstance(tree, tuple):
            stack += [(tree[0], code + "0"), (tree[1], code + "1")]
        else:
            codes[tree] = code
    return codes


def compress(data: bytes) -> bytes:
    counts = Counter(data)
    codes = _huffman_codes(counts)
    head = _MAGIC + struct.pack(">iH", len(data), len(counts)) + b"".join(struct.pack(">Bi", s, counts[s]) for s in sorted(counts))
    bits = "".join(codes[b] for b in data)
    bits += "0" * (-len(bits) % 8)
    return head + (int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b"")


def decompress(raw: bytes) -> bytes:
    if len(raw) < 10 or raw[:4] != _MAGIC:
        raise CorruptArchive("no header")
    size, symbols = struct.unpack(">iH", raw[4:10])
    body = 10 + 5 * symbols
    if size < 0 or symbols > 256 or len(raw) < body:
        raise CorruptArchive("impossible sizes")
    table = [struct.unpack(">Bi", raw[i : i + 5]) for i in range(10, body, 5)]
    counts = dict(table)
    if len(counts) != symbols or [s for s, _ in table] != sorted(counts) or any(n <= 0 for n in counts.values()) or sum(counts.values()) != size:
        raise CorruptArchive("impossible counts")
    codes = _huffman_codes(counts)
    need = sum(n * len(codes[s]) for s, n in counts.items())
    if len(raw) - body != (need + 7) // 8:
        raise CorruptArchive("wrong payload length")
    if symbols == 1:
        return bytes(counts) * size
    bits = "".join(f"{b:08b}" for b in raw[body:])
    if "1" in bits[need:]:
        raise CorruptArchive("padding is not zero")
    by_code, out, at = {c: s for s, c in codes.items()}, bytearray(), 0
    longest = max(map(len, codes.values()), default=0)
    while at < need:
        for width in range(1, longest + 1):
            s = by_code.get(bits[at : at + width])
            if s is not None:
                out.append(s)
                at += width
                break
        else:
            raise CorruptArchive("no such code")
    if Counter(out) != counts:
        raise CorruptArchive("payload does not fit the counts")
    return bytes(out)


# ------------------------------------------------------------------ graphs
Edge = tuple[int, int, float]
INF = float("inf")


def neighbours(n: int, edges: Sequence[Edge], directed: bool = False) -> list[list[tuple[int, float]]]:
    """Adjacency lists with the most recently added edge first."""
    out: list[deque] = [deque() for _ in range(n)]
    for a, b, w in edges:
        out[a].appendleft((b, w))
        if not directed:
            out[b].appendleft((a, w))
    return [list(x) for x in out]


def traverse(n: int, edges: Sequence[Edge], source: int, depth_first: bool = False) -> list[int]:
    near, seen, todo, out = neighbours(n, edges), {source}, deque([source]), []
    while todo:
        v = todo.pop() if depth_first else todo.popleft()
        out.append(v)
        for w, _ in near[v]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return out


def dijkstra(n: int, edges: Sequence[Edge], source: int, directed: bool = False) -> tuple[list[float], list[int]]:
    """Distances and previous vertices (-1: none)."""
    if any(w < 0 for _, _, w in edges):
        raise ValueError("negative edge")
    near = neighbours(n, edges, directed)
    dist, prev, heap = [INF] * n, [-1] * n, [(0.0, source)]
    dist[source] = 0.0
    while heap:
        d, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for w, cost in near[v]:
            if d + cost < dist[w]:
                dist[w], prev[w] = d + cost, v
                heapq.heappush(heap, (d + cost, w))
    return dist, prev


def bellman_ford(n: int, edges: Sequence[Edge], source: int) -> list[float]:
    """Directed distances; -inf for what a negative cycle reaches."""
    dist = [INF] * n
    dist[source] = 0.0
    for _ in range(n - 1):
        for a, b, w in edges:
            if dist[a] + w < dist[b]:
                dist[b] = dist[a] + w
    for _ in range(n):
        for a, b, w in edges:
            if dist[a] + w < dist[b]:
                dist[b] = -INF
    return dist


def floyd_warshall(n: int, edges: Sequence[Edge], directed: bool = True) -> np.ndarray:
    d = np.full((n, n), INF)
    np.fill_diagonal(d, 0.0)
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
        if not directed:
            d[b, a] = min(d[b, a], w)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
    for k in np.flatnonzero(np.diag(d) < 0):
        d[np.ix_(np.isfinite(d[:, k]) | (d[:, k] < 0), np.isfinite(d[k, :]) | (d[k, :] < 0))] = -INF
    return d


def kruskal(n: int, edges: Sequence[Edge]) -> list[Edge]:
    """Forest by (cost, from, to) with from < to."""
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b, w))
    return out


def prim(n: int, edges: Sequence[Edge]) -> list[Edge]:
    near, best, parent, done, out = neighbours(n, edges), [INF] * n, [-1] * n, [False] * n, []
    for _ in range(n):
        left = [v for v in range(n) if not done[v]]
        v = min(left, key=lambda u: (best[u], u))
        done[v] = True
        if parent[v] >= 0:
            out.append((parent[v], v, best[v]))
        for w, cost in near[v]:
            if not done[w] and (cost < best[w] or cost == best[w] and v < parent[w]):
                best[w], parent[w] = cost, v
    return out


def topological(n: int, edges: Sequence[Edge]) -> tuple[list[int], list[int]]:
    """Kahn's order, and the vertices on or behind a cycle."""
    near, degree = neighbours(n, edges, True), [0] * n
    for _, b, _ in edges:
        degree[b] += 1
    todo, out = deque(v for v in range(n) if not degree[v]), []
    while todo:
        v = todo.popleft()
        out.append(v)
        for w, _ in near[v]:
            degree[w] -= 1
            if not degree[w]:
                todo.append(w)
    return out, sorted(set(range(n)) - set(out))


def strong_components(n: int, edges: Sequence[Edge]) -> list[int]:
    """Smallest vertex of each vertex's strong component."""
    forward, backward = neighbours(n, edges, True), neighbours(n, [(b, a, w) for a, b, w in edges], True)
    order, seen = [], set()
    for s in range(n):
        stack = [(s, iter(forward[s]))] if s not in seen else []
        seen.add(s)
        while stack:
            v, it = stack[-1]
            for w, _ in it:
                if w not in seen:
                    seen.add(w)
                    stack.append((w, iter(forward[w])))
                    break
            else:
                order.append(v)
                stack.pop()
    label = [-1] * n
    for s in reversed(order):
        if label[s] < 0:
            part, todo = [], [s]
            label[s] = s
            while todo:
                v = todo.pop()
                part.append(v)
                for w, _ in backward[v]:
                    if label[w] < 0:
                        label[w] = s
                        todo.append(w)
            least = min(part)
            for v in part:
                label[v] = least
    return label


def max_flow(n: int, edges: Sequence[tuple[int, int, int]], source: int, sink: int) -> tuple[int, list[int]]:
    """Edmonds-Karp: flow value, and the source side of a minimum cut."""
    if any(c < 0 for _, _, c in edges):
        raise ValueError("negative capacity")
    room: list[dict[int, int]] = [defaultdict(int) for _ in range(n)]
    for a, b, c in edges:
        room[a][b] += c
        room[b][a] += 0
    flow = 0
    while True:
        prev, todo = {source: source}, deque([source])
        while todo and sink not in prev:
            v = todo.popleft()
            for w in sorted(room[v]):
                if room[v][w] > 0 and w not in prev:
                    prev[w] = v
                    todo.append(w)
        if sink not in prev:
            return flow, sorted(prev)
        path, v = [], sink
        while v != source:
            path.append((prev[v], v))
            v = prev[v]
        push = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= push
            room[b][a] += push
        flow += push


def greedy_select(candidates: Sequence[tuple[set, float, float]], limit: int | None = None) -> list[int]:
    """Indices by repeated best (new cover * relevance / cost); ties by cover,
    relevance and lower index; ends when nothing adds cover."""
    covered: set = set()
    out: list[int] = []
    while limit is None or len(out) < limit:
        best = None
        for i, (units, relevance, cost) in enumerate(candidates):
            new = len(units - covered)
            rank = (new * relevance / cost, new, relevance, -i)
            if i not in out and new and rank[0] > 0 and (best is None or rank > best):
                best = rank
        if best is None:
            break
        out.append(-best[3])
        covered |= candidates[-best[3]][0]
    return out


def set_cover(universe: set, sets: Sequence[tuple[set, float]]) -> tuple[list[int], set, float]:
    """Chosen sets, what stays uncovered, and their cost."""
    chosen = greedy_select([(s & universe, 1.0, c) for s, c in sets])
    left = universe - set().union(*(sets[i][0] for i in chosen)) if chosen else set(universe)
    return chosen, left, sum(sets[i][1] for i in chosen)
