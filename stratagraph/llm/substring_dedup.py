"""Near-duplicate passages by compact windows.

For each of a few hash functions, a document's shingles form a Cartesian tree by hash value: each
node is the minimum of all subsequences around it that stay inside its interval. A compact window
(l, c, r) stands for all of these at once. Inside a document the windows of different functions are
joined by their intervals: where those of two functions overlap, all subsequences of the overlap
share both minima, a signature. Documents with a signature in common may hold a pair of alike
passages there, and what they point at is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import column_of, drop_written, join_counted, map_groups, map_rows, numbered, release, texts, unpacked, wide_batches, written
from stratagraph.llm.components import components
from stratagraph.shipping import ship

#: Two of HASHES functions must agree: passages at 0.8 share a signature with probability 1 - 0.2**4 - 4 * 0.8 * 0.2**3 = 0.973, equal ones always.
SHINGLE, WORDS, SIMILARITY, HASHES = 5, 50, 0.8, 4
CACHE = 100_000
#: Bytes of short texts whose words are hashed together.
TOGETHER = 1 << 17
#: A mismatch weighs as many matches as keep the share of matches at SIMILARITY.
PENALTY, DROP = 4, 60
#: The same for a Jaccard similarity: it is SIMILARITY if both sides have 8/9 of matches.
STRICT = (8, 120)
#: A match is aligned if it is at most BAND shingles and a quarter of its distance to the anchor off the anchor's diagonal.
BAND = 8
#: Windows of a signature that one task compares with each other; larger groups are dealt out in pairs of chunks.
CHUNK = 1024


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 7)
        return got


_words = _Words()


def split(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased; ASCII white space parts them."""
    return text.encode().lower().split()


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the k-word shingles."""
    return _joined(np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words)), k)


def _joined(one: np.ndarray, k: int) -> np.ndarray:
    """The shingles of words with these hashes."""
    if len(one) < k:
        return np.zeros(0, dtype=np.uint64)
    m = len(one) - k + 1
    h = one[:m].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(32))
            h += one[i : i + m]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a lower-cased text begin, and the hashes that ``_words`` has of them: XXH64 with seed 7, of all words at once."""
    data = np.frombuffer(text + b" " + bytes(8), dtype=np.uint8)
    inside = ~_SPACE[data[: len(text) + 1]]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray((len(text) + 2,), dtype="<u8", buffer=data, strides=(1,))  # from every byte on
    h, at = size.astype(np.uint64) + (_P5 + np.uint64(7)), start.copy()
    long = np.flatnonzero(size >= 32)
    with np.errstate(over="ignore"):
        for more in (8, 16, 24):
            some = np.flatnonzero(size >= more)
            if not len(some):
                break
            x = _turned(eight[at[some]] * _P2, 31) * _P1
            h[some] = _turned(h[some] ^ x, 27) * _P1 + _P4
            at[some] += 8
        some = np.flatnonzero(size & 4)
        h[some] = _turned(h[some] ^ ((eight[at[some]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[some] += 4
        for more in (1, 2, 3):
            some = np.flatnonzero((size & 3) >= more)
            h[some] = _turned(h[some] ^ (data[at[some]].astype(np.uint64) * _P5), 11) * _P1
            at[some] += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    for i in long.tolist():
        h[i] = xxhash.xxh64_intdigest(text[start[i] : end[i]], 7)
    return start, h


def shingled_texts(lower: Iterable[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingles of lower-cased texts, one after another; the words of several short ones are hashed together."""
    held: list[bytes] = []
    size = 0

    def made() -> Iterator[np.ndarray]:
        start, one = word_hashes(b" ".join(held))
        ends = np.cumsum([len(t) + 1 for t in held])
        cuts = np.searchsorted(start, ends).tolist()
        every = _joined(one, k)
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield every[a : max(a, b - k + 1)]
        held.clear()

    for text in lower:
        if held and size + len(text) > TOGETHER:
            yield from made()
            size = 0
        held.append(text)
        size += len(text)
    if held:
        yield from made()


def minhash(h: np.ndarray, f: int) -> np.ndarray:
    """Function f of the shingles; 0 is left for the end of a document."""
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64((0xD1B54A32D192ED03 * (2 * f + 1)) % 2**64)) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(x ^ (x >> np.uint64(31)), np.uint64(1))


def compact_windows(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the nodes of the Cartesian tree whose intervals have ``width`` elements.

    The nodes are the minima of the subsequences of ``width`` elements; neighbouring subsequences with
    one minimum are its window, from the first element of the first to the last of the last. A value
    that comes again within ``width`` elements is one node with its first place as c, so a run of one
    value is one window. Zeros end a document: no window crosses them.
    """
    n = len(v)
    if n < width:
        return (np.zeros(0, dtype=np.int64),) * 3
    low, span = v, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    m = n - width + 1
    low = np.minimum(low[:m], low[width - span : width - span + m])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.concatenate([first[1:], [m]]) - 1
    inner = low[first] != 0
    first, last = first[inner], last[inner]
    c = first + v[first[:, None] + np.arange(width)].argmin(axis=1)
    return first, c, last + width - 1


def windows(docs: DataFrame, hashes: int = HASHES, words: int = WORDS, k: int = SHINGLE) -> DataFrame:
    """``key, row, l, c, r`` for every function and document (columns ``row, text``); a key's lowest three bits name its function."""
    width = words - k + 1

    def make():
        def step(batch):
            parts, owner = [], []
            for row, h in zip(batch.column(0).to_numpy(), shingled_texts((t.encode().lower() for t in texts(batch)), k), strict=True):
                if len(h) >= width:
                    parts.append(h)
                    owner.append(row)
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            at = 0
            while at < len(parts):  # a few documents at a time
                end, size = at, 0
                while end < len(parts) and (end == at or size + len(parts[end]) <= 1 << 17):
                    size += len(parts[end]) + 1
                    end += 1
                own = parts[at:end]
                starts = np.cumsum([0, *(len(p) + 1 for p in own)])
                flat = np.zeros(starts[-1], dtype=np.uint64)
                live = np.ones(starts[-1], dtype=bool)
                for s, p in zip(starts, own, strict=False):
                    flat[s : s + len(p)] = p
                    live[s + len(p)] = False
                for f in range(hashes):
                    v = np.where(live, minhash(flat, f), np.uint64(0))
                    left, c, r = compact_windows(v, width)
                    doc = np.searchsorted(starts, c, side="right") - 1
                    base = starts[doc]
                    for o, x in zip(out, ((v[c].view(np.int64) & ~7) | f, np.asarray(owner[at:end], dtype=np.int64)[doc], left - base, c - base, r - base), strict=True):
                        o.append(x)
                at = end
            cols = [np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out]
            return {n: pa.array(x if n in ("key", "row") else x.astype(np.int32)) for n, x in zip(("key", "row", "l", "c", "r"), cols, strict=True)}

        return step

    return map_rows(docs, make, "key long, row long, l int, c int, r int")


def shared(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``key, row, ...`` whose key several documents have, each with ``first`` and ``n``; and the written table of these keys.

    Keys are counted before the rows are joined to them. A key that very many rows have is split.
    """
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last").drop("last")
    keys = written(keys, f"{name}-keys")
    release(found.sparkSession)  # the counts' shuffle is as large as the join's, which follows
    return join_counted(found, keys, ["key"]), keys


def overlaps(key: np.ndarray, row: np.ndarray, left: np.ndarray, c: np.ndarray, r: np.ndarray, width: int, hashes: int = HASHES) -> dict[str, np.ndarray]:
    """Signatures of two functions: the interval join of a document's windows, for all documents (sorted by row) at once.

    Two windows meet if a subsequence of ``width`` shingles lies in both; l and r bound all of these.
    The lowest bit of a signature's key tells whether its functions follow one another.
    """
    _, number = np.unique(row, return_inverse=True)
    base = number.astype(np.int64) << 32
    function = key & 7
    own = []
    for f in range(hashes):
        at = np.flatnonzero(function == f)
        at = at[np.argsort(base[at] + left[at], kind="stable")]
        own.append((at, base[at] + left[at], base[at] + r[at] - (width - 1)))  # first and last start of such a subsequence
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for f in range(hashes):
        at, a0, a1 = own[f]
        for g in range(f + 1, hashes):
            other, b0, b1 = own[g]
            lo = np.searchsorted(b1, a0)
            n = np.maximum(np.searchsorted(b0, a1, side="right") - lo, 0)
            i = np.repeat(np.arange(len(at)), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            x, y = at[i], other[j]
            with np.errstate(over="ignore"):
                both = (key[x].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (key[x].view(np.uint64) >> np.uint64(29))
                both = ((both + key[y].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
            both = (both & ~1) | (g == f + 1)
            for o, v in zip(out, (both, row[x], c[x], np.maximum(left[x], left[y]), np.minimum(r[x], r[y])), strict=True):
                o.append(v)
    names = ("key", "row", "c", "l", "r")
    return {n: np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for n, o in zip(names, out, strict=True)}


def signatures(found: DataFrame, hashes: int, width: int) -> DataFrame:
    """``key, row, c, l, r``: the signatures of every document, from its windows (``key, row, l, c, r``)."""
    names = ("key", "row", "l", "c", "r")
    schema = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = {n: np.zeros(0, dtype=np.int64) for n in names}

        def made(cols):
            got = overlaps(cols["key"], cols["row"], cols["l"], cols["c"], cols["r"], width, hashes)
            return pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in schema], schema=schema)

        for b in batches:
            rest = {n: np.concatenate([rest[n], b.column(i).to_numpy().astype(np.int64)]) for i, n in enumerate(names)}
            if len(rest["row"]):
                cut = int(np.searchsorted(rest["row"], rest["row"][-1]))  # the last document may go on in the next batch
                if cut:
                    yield made({n: x[:cut] for n, x in rest.items()})
                    rest = {n: x[cut:] for n, x in rest.items()}
        if len(rest["row"]):
            yield made(rest)

    ship(found.sparkSession)
    dealt = found.select(*names).repartition("row").sortWithinPartitions("row")
    return dealt.mapInArrow(run, "key long, row long, c int, l int, r int")


def grow(hit: np.ndarray, c: int, penalty: int = PENALTY, drop: int = DROP) -> tuple[int, int]:
    """The stretch around c with the best score, matches against mismatches, until the score has dropped by ``drop``."""

    def reach(h: np.ndarray) -> int:
        few = drop // penalty + 1
        if len(h) >= few and not h[:few].any():
            return 0
        total, best, place, at, block = 0, 0, -1, 0, 256
        while at < len(h):
            part = h[at : at + block]
            match, last = bool(part[0]), -1
            for end in [*np.flatnonzero(part[1:] != part[:-1]).tolist(), len(part) - 1]:  # runs of matches, or of mismatches
                if match:
                    total += end - last
                    if total > best:
                        best, place = total, at + end
                else:
                    total -= penalty * (end - last)
                    if best - total > drop:
                        return place + 1
                match, last = not match, end
            at, block = at + block, 4096
        return place + 1

    return c - reach(hit[:c][::-1]), c + reach(hit[c + 1 :])


def _stretches(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every stretch of ``width`` shingles."""
    power, out, length, span = np.uint64(0x9E3779B97F4A7C15), None, 0, 1
    with np.errstate(over="ignore"):
        bits = h.copy()
        while span <= width:
            if width & span:
                out, length = (bits, span) if out is None else (out[: len(out) - span] * power + bits[length : length + len(out) - span], length + span)
            if span * 2 <= width:
                bits = bits[: len(bits) - span] * power + bits[span:]
            power = power * power
            span *= 2
    return out


class Target:
    """What comparisons with one document share: its shingles in order, and its stretches."""

    def __init__(self, b: np.ndarray, width: int):
        self.b, self.width = b, width
        self.order = np.argsort(b, kind="stable")
        self.sorted = b[self.order]
        self.number = np.cumsum(np.concatenate([[False], self.sorted[1:] != self.sorted[:-1]])) if len(b) else self.order
        self._places = None
        self.names, self.where = np.unique(_stretches(b, width), return_index=True) if len(b) >= width else (b[:0], np.zeros(0, dtype=np.int64))

    def of(self, at: np.ndarray) -> np.ndarray:
        """Where the values at these places of ``sorted`` stand."""
        hit = np.zeros(len(self.b), dtype=bool)
        hit[self.number[at]] = True
        out = np.empty(len(self.b), dtype=bool)
        out[self.order] = hit[self.number]
        return out

    def places(self) -> Places:
        if self._places is None:
            self._places = Places(self.b)
        return self._places


class Places:
    """Where the values of a sequence stand in it, for the nearest place to a wanted one."""

    def __init__(self, b: np.ndarray):
        self.names, number = np.unique(b, return_inverse=True)
        self.n = len(b)
        self.at = np.sort(number * (self.n + 1) + np.arange(self.n))

    def starts(self, values: np.ndarray) -> np.ndarray:
        """Where the places of each value begin among all; -1 if it has none."""
        number = np.minimum(np.searchsorted(self.names, values), len(self.names) - 1)
        return np.where(self.names[number] == values, number * (self.n + 1), -1)

    def distance(self, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Distance from ``wanted`` to the nearest place of each value (by ``starts``), over n if it has none."""
        after = np.searchsorted(self.at, starts + np.minimum(np.maximum(wanted, 0), self.n - 1))
        far = 4 * self.n + 4
        best = np.full(len(starts), far)
        for i in (after - 1, after):
            got = self.at[np.minimum(np.maximum(i, 0), self.n - 1)] - starts
            best = np.where((got >= 0) & (got < self.n), np.minimum(best, np.abs(got - wanted)), best)
        return np.where(starts >= 0, best, far)


class Sides:
    """Two sequences' places, and where those of each shingle begin in the other one."""

    def __init__(self, a: np.ndarray, target: Target):
        self.in_b, self.in_a = target.places(), Places(a)
        self.to_b, self.to_a = self.in_b.starts(a), self.in_a.starts(target.b)


def aligned(to_b: np.ndarray, to_a: np.ndarray, in_b: Places, in_a: Places, i: int, j: int, c: int, x: int, y: int, d: int, penalty: int, drop: int) -> tuple[int, int, int, int]:
    """The stretches around c and d, inside i to j and x to y, grown by matches near the diagonal of c and d alone.

    ``to_b`` and ``to_a`` tell for each shingle of one text where its places in the other begin (``Places.starts``).
    """
    s, t = np.arange(i, j + 1), np.arange(x, y + 1)
    here = in_b.distance(to_b[i : j + 1], s - c + d) <= BAND + np.abs(s - c) // 4
    there = in_a.distance(to_a[x : y + 1], t - d + c) <= BAND + np.abs(t - d) // 4
    (p, q), (u, v) = grow(here, c - i, penalty, drop), grow(there, d - x, penalty, drop)
    return i + p, i + q, x + u, x + v


def longest(hit: np.ndarray, c: int, share: float) -> tuple[int, int]:
    """First and last place of the longest stretch that holds c and has ``share`` of matches."""
    over = np.concatenate([[0.0], np.cumsum(hit - share)]) + 1e-9 * np.arange(len(hit) + 1)
    # the last end whose sum is as high as a start's: sums over all later ends fall from end to end
    highest = np.maximum.accumulate(over[:c:-1])
    length = len(hit) - np.searchsorted(highest, over[: c + 1]) - np.arange(c + 1)
    i = int(np.where(length + np.arange(c + 1) > c, length, 0).argmax())
    return i, max(c, i + int(length[i]) - 1)


def around(c: int, n: int, width: int) -> tuple[int, int]:
    """Two widths to each side of c."""
    return max(0, c - 2 * width), min(n, c + 2 * width)


def roomy(hit: np.ndarray, c: int, width: int, similarity: float) -> bool:
    """Whether a stretch of ``width`` near c, and with c, has as many matches anywhere as an alike one needs near its diagonal."""
    i, j = around(c, len(hit), width)
    p, q = longest(hit[i:j], c - i, 2 * similarity / (1 + similarity))
    return q - p + 1 >= width


def nearby(to_b: np.ndarray, to_a: np.ndarray, in_b: Places, in_a: Places, c: int, d: int, width: int, similarity: float) -> tuple[int, int, int, int] | None:
    """The longest stretches around c and d that share what alike ones of one length do, within two widths of them; None if one is under ``width``."""
    share = 2 * similarity / (1 + similarity)
    (i, j), (x, y) = around(c, len(to_b), width), around(d, len(to_a), width)
    s = np.arange(i, j)
    p, q = longest(in_b.distance(to_b[i:j], s - c + d) <= BAND + np.abs(s - c) // 4, c - i, share)
    if q - p + 1 < width:
        return None
    t = np.arange(x, y)
    u, v = longest(in_a.distance(to_a[x:y], t - d + c) <= BAND + np.abs(t - d) // 4, d - x, share)
    return (i + p, i + q, x + u, x + v) if v - u + 1 >= width else None


def _equal(a: np.ndarray, target: Target) -> list[tuple[int, int, int, int]]:
    """Maximal places in a whose stretches all stand in the target, with the place of the first and last there."""
    width, names = target.width, target.names
    if len(a) < width or not len(names):
        return []
    wa = _stretches(a, width)
    at = np.minimum(np.searchsorted(names, wa), len(names) - 1)
    hit = np.flatnonzero(names[at] == wa)
    if not len(hit):
        return []
    parts = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [(int(p[0]), int(p[-1]) + width - 1, int(target.where[at[p[0]]]), int(target.where[at[p[-1]]]) + width - 1) for p in parts]


def passages(a: np.ndarray, target: Target, anchors: list[int], words: int = WORDS, k: int = SHINGLE, similarity: float = SIMILARITY, one: bool = False) -> list[tuple[int, int, int, int]]:
    """Verified passages (first and last word in a, in the target) of two shingle sequences.

    Equal stretches of ``words`` words are found wherever they are. Around the places in a that
    anchors name, stretches with few differences are compared: ``words`` words on both sides and a
    Jaccard similarity of ``similarity`` or more. Stretches first take in whatever the other text has
    anywhere; if these are too unlike, what is aligned with the anchor is compared. Each pair of
    stretches is compared once, however often their shingles repeat. ``one``: some are enough.
    """
    width, b = words - k + 1, target.b
    out = _equal(a, target)
    if len(b) < width or (one and out) or sum(j - i + 1 for i, j, _, _ in out) == len(a):
        return [(i, j + k - 1, x, y + k - 1) for i, j, x, y in out]
    at = np.minimum(np.searchsorted(target.sorted, a), len(b) - 1)
    in_b, in_a = target.sorted[at] == a, None
    order = target.order
    lo, hi = np.searchsorted(target.sorted, a[anchors], "left"), np.searchsorted(target.sorted, a[anchors], "right")
    left: list[tuple[int, int]] = []
    right: list[tuple[int, int]] = []
    tried = set()
    narrow: list[tuple[int, int, int, int, int]] = []
    own = None

    def alike(i: int, j: int, x: int, y: int) -> bool:
        one, other = np.unique(a[i : j + 1]), np.unique(b[x : y + 1])
        both = len(np.intersect1d(one, other, assume_unique=True))
        return both >= similarity * (len(one) + len(other) - both)

    def stretch(known: list[tuple[int, int]], hit: np.ndarray, c: int) -> tuple[int, int]:
        for s in known:
            if s[0] <= c <= s[1]:
                return s
        known.append(grow(hit, c))
        return known[-1]

    near: set[tuple[int, int]] = set()
    for c, s, e in zip(anchors, lo.tolist(), hi.tolist(), strict=True):
        i, j = stretch(left, in_b, c) if e > s else (0, -1)
        if any(x <= c <= y and x <= i and j <= y for x, y, _, _ in out):
            continue
        if in_a is None:
            in_a = target.of(at[in_b])
        room = None
        for d in order[s:e].tolist():
            x, y = stretch(right, in_a, d)
            found = None
            if j - i + 1 >= width and y - x + 1 >= width:
                if (i, x, y) not in tried:
                    tried.add((i, x, y))
                    if alike(i, j, x, y):
                        out.append((i, j, x, y))
                        break
                if any(p <= c <= q and u <= d <= v and abs(d - c - o) <= BAND for p, q, u, v, o in narrow):
                    continue
                own = own or Sides(a, target)
                for penalty, drop in ((PENALTY, DROP), STRICT):
                    p, q, u, v = aligned(own.to_b, own.to_a, own.in_b, own.in_a, i, j, c, x, y, d, penalty, drop)
                    narrow.append((p, q, u, v, d - c))
                    if q - p + 1 >= width and v - u + 1 >= width and alike(p, q, u, v):
                        found = (p, q, u, v)
                        break
            # the best scores may end before a difference that a passage can hold
            if not found and ((d - c) // BAND, c // BAND) not in near:
                near.add(((d - c) // BAND, c // BAND))
                if room is None:
                    room = roomy(in_b, c, width, similarity)
                if room and roomy(in_a, d, width, similarity):
                    own = own or Sides(a, target)
                    got = nearby(own.to_b, own.to_a, own.in_b, own.in_a, c, d, width, similarity)
                    if got and alike(*got):
                        found = got
            if found:
                out.append(found)
                break
    return [(i, j + k - 1, x, y + k - 1) for i, j, x, y in out]


def squeezed(keyed: DataFrame) -> DataFrame:
    """``row, packed``: compressed words, for joins that send texts to the documents they are compared with."""

    def make():
        press = zstandard.ZstdCompressor(level=3)
        return lambda batch: {"row": batch.column(0), "packed": [press.compress(b" ".join(split(t))) for t in texts(batch)]}

    return map_rows(keyed, make, "row long, packed binary")


def opened(packed: bytes) -> list[bytes]:
    return zstandard.decompress(packed).split()


SPANS = "spans array<struct<first:int,last:int,other_first:int,other_last:int>>"


def verified(pairs: DataFrame, packed: DataFrame, words: int, k: int, similarity: float) -> DataFrame:
    """``row, other, spans, missed`` of ``row, other, anchors``: passages found in whole texts, and the anchors that no passage holds.

    A document that very many others point at has its pairs in several tasks.
    """
    counted = written(pairs.groupBy("other").agg(F.count("*").alias("n")).join(packed.select(F.col("row").alias("other"), F.col("packed").alias("other_packed")), "other"), "compared")
    both = join_counted(pairs.join(packed, "row"), counted, ["other"]).select("row", "other", "anchors", "packed", "other_packed")

    def make():
        def step(batch):
            spans, missed, target = [], [], None
            every, own, other = (batch.column(i).to_pylist() for i in (2, 3, 4))
            new = [i == 0 or u != other[i - 1] for i, u in enumerate(other)]
            parts = shingled_texts((zstandard.decompress(p) for t, u, n in zip(own, other, new, strict=True) for p in ((u, t) if n else (t,))), k)
            for anchors, n in zip(every, new, strict=True):
                if n:
                    target = Target(next(parts), words - k + 1)
                got = passages(next(parts), target, anchors, words, k, similarity)
                spans.append([{"first": i, "last": j, "other_first": x, "other_last": y} for i, j, x, y in got])
                missed.append([c for c in anchors if not any(i <= c <= j for i, j, _, _ in got)])
            return {"row": batch.column(0), "other": batch.column(1), "spans": spans, "missed": missed}

        return step

    out = written(map_rows(both, make, f"row long, other long, {SPANS}, missed array<int>"), "verified")
    drop_written(counted)
    release(pairs.sparkSession)
    return out


def shingled(places: DataFrame, packed: DataFrame, k: int, width: int) -> DataFrame:
    """``row, c, l, r, anchor, around``: 32 bits of each shingle from ``width`` before l to as many after r, and where among them c's value stands."""
    asked = places.groupBy("row").agg(F.collect_set(F.struct("c", "l", "r")).alias("asked"))

    def make():
        def step(batch):
            out = []
            rows, places, packed = (batch.column(i).to_pylist() for i in range(3))
            for row, asked, h in zip(rows, places, shingled_texts(map(zstandard.decompress, packed), k), strict=True):
                few = (h >> np.uint64(32)).astype(np.uint32)
                for a in asked:
                    lo = max(0, a["l"] - width)
                    at = a["l"] - lo + int(np.argmax(h[a["l"] : a["r"] + 1] == h[a["c"]]))  # c may lie before a run of its value
                    out.append((row, a["c"], a["l"], a["r"], at, few[lo : a["r"] + 1 + width].tobytes()))
            return dict(zip(("row", "c", "l", "r", "anchor", "around"), map(list, zip(*out, strict=True)), strict=True))

        return step

    return map_rows(asked.join(packed, "row"), make, "row long, c int, l int, r int, anchor int, around binary")


def near_anchor(hit: np.ndarray, last: np.ndarray, shared: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, shares: tuple[float, ...]) -> list[np.ndarray]:
    """For each share, which rows of ``hit`` have a stretch of ``width`` or more that may hold a place from ``low`` to ``high`` and so many hits, or ``width`` hits in a row anywhere.

    Of shingles that come again, ``last`` has the place before (or -1): those without a hit count once, as far as is sure. No stretch
    has more distinct hits than ``shared``. Rows may end with places of no hit and no place before; these change nothing where the
    row itself has ``width`` places.
    """
    n, length = hit.shape
    if length < width:
        return [np.zeros(n, dtype=bool)] * len(shares)
    hits, misses = np.zeros((n, length + 1)), np.zeros((n, length + 1))
    np.cumsum(hit, axis=1, out=hits[:, 1:])
    np.cumsum((last < 0) & ~hit, axis=1, out=misses[:, 1:])
    run = (hits[:, width:] - hits[:, :-width] == width).any(axis=1)
    at = np.arange(length + 1)
    fewest = np.zeros(n)
    if (last >= 0).any():
        # distinct shingles without a hit in stretches of ``width``: each counts for the starts between its place before and this one
        row, place = np.nonzero(~hit)
        since = np.broadcast_to(np.maximum(np.maximum(last + 1, at[:-1] - width + 1), 0), hit.shape)[row, place]
        changes = np.bincount(row * (length + 1) + since, minlength=n * (length + 1)) - np.bincount(row * (length + 1) + place + 1, minlength=n * (length + 1))
        fewest = np.cumsum(changes.reshape(n, length + 1), axis=1)[:, : length + 1 - width].min(axis=1)
    late, before = at[: length + 1 - width] > high[:, None], at[width:] <= low[:, None]
    out = []
    for s in shares:
        over = (1 - s) * hits - s * misses + 1e-9 * at
        least = np.minimum.accumulate(np.where(late, np.inf, over[:, : length + 1 - width]), axis=1)
        out.append(run | ((fewest <= shared * (1 - s) / s + 1e-9) & ((over[:, width:] >= least) & ~before).any(axis=1)))
    return out


class Windows:
    """Windows' shingles, numbered: what tells of one of them and many others whether they can be alike."""

    def __init__(self, around: list[np.ndarray], anchor: np.ndarray):
        self.size = np.array([len(x) for x in around])
        self.start = np.cumsum(self.size) - self.size
        flat = np.concatenate(around)
        order = np.sort((flat << np.uint64(32)) | np.arange(len(flat), dtype=np.uint64))
        value, order = order >> np.uint64(32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], value[1:] != value[:-1]])
        self.number, self.last = np.empty(len(flat), dtype=np.int64), np.full(len(flat), -1)
        self.number[order] = np.cumsum(new) - 1
        owner = np.repeat(np.arange(len(around)), self.size)
        same = ~new[1:] & (owner[order[1:]] == owner[order[:-1]])
        again = order[1:][same]
        self.last[again] = order[:-1][same] - self.start[owner[again]]
        #: How often a window has a shingle that it had before.
        self.repeats = np.bincount(owner[again], minlength=len(around))
        #: The anchor's shingle, and its first and last place.
        self.anchor = self.number[self.start + anchor]
        at = np.flatnonzero(self.number == self.anchor[owner])
        self.low, self.high = np.empty(len(around), dtype=np.int64), np.empty(len(around), dtype=np.int64)
        self.low[owner[at[::-1]]] = (at - self.start[owner[at]])[::-1]
        self.high[owner[at]] = at - self.start[owner[at]]
        self.place = np.full(int(new.sum()), -1)  # of a shingle in the window at hand

    def places(self, x: int) -> slice:
        return slice(self.start[x], self.start[x] + self.size[x])

    def alike(self, x: int, others: np.ndarray, numbers: np.ndarray, owner: np.ndarray, width: int, similarity: float) -> np.ndarray:
        """Which of the others may have a passage in common with x: equal ``width`` anywhere, or alike around both anchors.

        ``numbers`` are the others' shingles, ``owner`` the places of their windows in ``others``. Nothing that ``passages`` finds
        is left out: alike stretches hold the anchors' shingle, share ``similarity`` of either and more of the shorter.
        """
        own, size = self.number[self.places(x)], int(self.size[x])
        self.place[own] = np.arange(size)
        shared = np.bincount(owner[self.place[numbers] >= 0], minlength=len(others))
        # a passage has as many distinct shingles as its width, less what repeats around it; the other shares them but for a fifth
        near = np.flatnonzero(shared >= similarity * max(1, width - int(self.repeats[x])))
        near = near[(self.size[others[near]] >= width) & (size >= width)]
        ys = others[near]
        if len(ys):
            shares = (similarity, 2 * similarity / (1 + similarity))
            inside = np.arange(int(self.size[ys].max())) < self.size[ys][:, None]
            place, last = np.full(inside.shape, -1), np.full(inside.shape, -1)
            parts = [self.places(y) for y in ys.tolist()]
            place[inside] = self.place[np.concatenate([self.number[p] for p in parts])]
            last[inside] = np.concatenate([self.last[p] for p in parts])
            there = place >= 0
            here = np.zeros((len(ys), size), dtype=bool)
            here[np.nonzero(there)[0], place[there]] = True
            both = here.sum(axis=1)
            here = here[:, self.place[own]]
            other = self.anchor[x] != self.anchor[ys]  # not known where the other has this one's shingle
            left = near_anchor(here, self.last[self.places(x)], both, np.full(len(ys), self.low[x]), np.full(len(ys), self.high[x]), width, shares)
            some = np.flatnonzero(other | left[0])
            if len(some):
                right = near_anchor(there[some], last[some], both[some], self.low[ys[some]], self.high[ys[some]], width, shares)
                some = some[other[some] | (right[0] & (left[1][some] | right[1]))]
            near = near[some]
        self.place[own] = -1
        return near


def equal_stretches(around: list[np.ndarray], row: np.ndarray, asked: np.ndarray, width: int) -> set[tuple[int, int]]:
    """(place, earliest place) of places that have a stretch of ``width`` shingles of an earlier row, where either is asked for; places ascend by row."""
    size = np.array([len(x) for x in around])
    flat = np.concatenate(around)
    if len(flat) < width:
        return set()
    owner = np.repeat(np.arange(len(row)), size)
    names, inside = _stretches(flat, width), owner[: len(flat) - width + 1] == owner[width - 1 :]
    owner = owner[: len(names)][inside]
    _, first, number = np.unique(names[inside], return_index=True, return_inverse=True)
    of = owner[first[number]]
    later = np.flatnonzero((row[of] != row[owner]) & (asked[owner] | asked[of]))
    return set(zip(owner[later].tolist(), of[later].tolist(), strict=True))


def compared(batch: pa.RecordBatch, words: int, k: int, similarity: float) -> list[tuple]:
    """(row, other, c) of windows of one signature that are alike, in a chunk or between two (rows ascending).

    Equal stretches are found by their hashes, for all windows at once, where one of the two is in no
    passage yet (``miss``). Windows whose documents are not connected with the signature's first
    (``apart``) are then compared with all whose documents are not connected with theirs.
    """
    width = words - k + 1
    i, j, row, root, c, anchor, miss, apart, part = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("i", "j", "row", "root", "c", "anchor", "miss", "apart", "part"))
    around = batch.column("around").to_pylist()
    flat = np.frombuffer(b"".join(around), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(x) // 4 for x in around]).tolist()
    around = [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)]
    root, out = root.copy(), []
    # equal stretches share all signatures, so some of these are enough
    for x, y in sorted(equal_stretches(around, row, miss, width)) if batch.column("key")[0].as_py() & 1 else ():
        out.append((int(row[x]), int(row[y]), int(c[x])))
        root[root == root[x]] = root[y]
    left, right = np.flatnonzero(apart & (part == i[0])), np.flatnonzero(part == j[0])
    if not len(left) or not len(right) or (root == root[0]).all():
        return out
    known = Windows(around, anchor)
    numbers, owner = np.concatenate([known.number[known.places(x)] for x in right.tolist()]), np.repeat(np.arange(len(right)), known.size[right])
    targets: dict[int, Target] = {}
    for x in left.tolist():
        if (root[right] == root[x]).all():
            continue
        for y in right[known.alike(x, right, numbers, owner, width, similarity)].tolist():
            if root[y] == root[x]:
                continue
            a, b = (x, y) if row[x] > row[y] else (y, x)
            if b not in targets:
                targets[b] = Target(around[b], width)
            if passages(around[a], targets[b], [int(anchor[a])], words, k, similarity, one=True):
                out.append((int(row[a]), int(row[b]), int(c[a])))
                root[root == root[y]] = root[x]
    return out


def left_out(checked: DataFrame, k: int) -> DataFrame:
    """``row, first, c``: anchors that no passage holds, of the pair they were tried in or of another with the same row."""
    held = checked.where(F.size("spans") > 0).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("held"))
    missed = checked.where(F.size("missed") > 0).join(held, "row", "left").select("row", F.col("other").alias("first"), "held", F.explode("missed").alias("c"))
    inside = F.coalesce(F.exists("held", lambda s: F.col("c").between(s["first"], s["last"] - (k - 1))), F.lit(False))
    return missed.where(~inside).select("row", "first", "c")


def rest(met: DataFrame, checked: DataFrame, packed: DataFrame, words: int, k: int, similarity: float) -> DataFrame | None:
    """``row, other, anchors`` of documents that are alike where they share a signature, though not like its first document.

    Where windows of a signature are in no passage yet, or their documents not connected, all windows
    of that signature are compared, in pairs of chunks: for equal stretches, and for alike passages
    between documents not connected yet. Nothing but alike windows leaves a task.
    """
    roots = written(components(checked.where(F.size("spans") > 0).select(F.col("row").alias("a"), F.col("other").alias("b"))), "roots")
    missed = checked.where(F.size("missed") > 0).select("row", F.col("other").alias("first"), F.explode("missed").alias("c"))
    for side in ("row", "first"):
        missed = missed.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    apart = missed.where(F.coalesce("row_root", "row") != F.coalesce("first_root", "first")).select("row", "first", "c", F.lit(True).alias("apart"))
    missed = written(apart.unionByName(left_out(checked, k).withColumn("apart", F.lit(False))).groupBy("row", "first", "c").agg(F.max("apart").alias("apart")), "missed")
    asked = met.where("n > 2").join(missed, ["row", "first", "c"]).where(F.col("apart") | (F.col("key").bitwiseAND(F.lit(1)) == 1))
    keys = written(met.groupBy("key").agg(F.count("*").alias("n")).join(asked.select("key").distinct(), "key"), "mixed")
    if keys.isEmpty():
        return None
    places = join_counted(met.select("key", "row", "c", "l", "r", "first"), keys, ["key"])
    places = places.join(missed.withColumn("miss", F.lit(True)), ["row", "first", "c"], "left").join(roots.withColumnRenamed("node", "row"), "row", "left")
    places = written(places.withColumn("miss", F.coalesce("miss", F.lit(False))).withColumn("apart", F.coalesce("apart", F.lit(False))).withColumn("root", F.coalesce("root", "row")), "places")
    full = places.join(shingled(places, packed, k, words - k + 1), ["row", "c", "l", "r"]).withColumn("m", F.ceil(F.col("n") / CHUNK).cast("int"))
    full = full.withColumn("part", F.pmod(F.xxhash64("row"), F.col("m")).cast("int"))
    # every window goes to the tasks in which its chunk stands on either side
    every = F.sequence(F.lit(0), F.col("m") - 1)
    tasks = F.array_distinct(F.concat(F.transform(every, lambda o: F.struct(o.alias("i"), F.col("part").alias("j"))), F.transform(every, lambda o: F.struct(F.col("part").alias("i"), o.alias("j")))))
    dealt = full.withColumn("t", F.explode(tasks)).select("key", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "row", "root", "c", "anchor", "around", "miss", "apart", "part")
    release(met.sparkSession)
    some = map_groups(dealt, ["key", "i", "j"], ["row", "c"], lambda b: compared(b, words, k, similarity), "row long, other long, c int")
    out = written(some.groupBy("row", "other").agg(F.sort_array(F.collect_set("c")).alias("anchors")), "rest")
    for t in (roots, missed, keys, places):
        drop_written(t)
    return out


def near_passages(table: DataFrame, text: str, *, hashes: int = HASHES, words: int = WORDS, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``row, other, spans``: verified passages of a later row and an earlier one that has them, of a ``numbered`` table.

    Spans are (first word, last word, the same in the other row), from 0. Of equal texts the first
    stands for all, and each other one has its whole text in common with it (texts of under ``words``
    words have no passages). Null texts are empty. A row may have passages in common with several
    earlier ones; rows that share a passage are connected by such pairs, not all paired.
    """
    width = words - k + 1
    whole = F.coalesce(F.col(text), F.lit(""))
    names = table.select("row", F.md5(whole).alias("name"), F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words"))
    first = names.groupBy("name").agg(F.min("row").alias("other"), F.max("row").alias("last"), F.count("*").alias("n"))
    again = written(first.where("other <> last").select("name", "other", "n"), "texts")
    copies = written(join_counted(names, again, ["name"]).where("row <> other").select("row", "other", "n_words"), "copies")
    drop_written(again)
    keyed = table.select("row", whole.alias("text"))
    alone = keyed.join(copies.select("row"), "row", "left_anti")
    found = written(windows(alone, hashes, words, k), "compact")
    release(table.sparkSession)
    some, keys = shared(found, "windows")
    with wide_batches(table.sparkSession):
        joint = written(signatures(some, hashes, width), "signatures")
    drop_written(found)
    drop_written(keys)
    release(table.sparkSession)
    met, keys = shared(joint, "signatures")
    met = written(met, "met")
    drop_written(joint)
    release(table.sparkSession)
    packed = written(squeezed(keyed.join(met.select("row").distinct(), "row", "left_semi")), "packed")
    release(table.sparkSession)
    pairs = written(met.where("row <> first").groupBy("row", F.col("first").alias("other")).agg(F.sort_array(F.collect_set("c")).alias("anchors")), "pairs")
    checked = verified(pairs, packed, words, k, similarity)
    more = rest(met, checked, packed, words, k, similarity)
    if more is not None:
        checked = checked.unionByName(verified(more, packed, words, k, similarity))
    every = F.array(F.struct(F.lit(0).alias("first"), (F.col("n_words") - 1).alias("last"), F.lit(0).alias("other_first"), (F.col("n_words") - 1).alias("other_last")))
    out = checked.where(F.size("spans") > 0).select("row", "other", "spans").unionByName(copies.where(F.col("n_words") >= words).select("row", "other", every.alias("spans")))
    for t in (keys, pairs, met, packed):
        drop_written(t)
    release(table.sparkSession)
    return out


def _covered(spans: Column) -> Column:
    """Words in the union of spans."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s, x):
        new = F.greatest(F.lit(0), x["last"] - F.greatest(x["first"], s["end"] + 1) + 1)
        return F.struct(F.greatest(s["end"], x["last"]).alias("end"), (s["n"] + new).cast("long").alias("n"))

    return F.aggregate(F.sort_array(spans), start, step, lambda s: s["n"])


def documents_with_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, class_id, n_passages, duplicate_words, partners`` for every document.

    The class is named by the smallest id among documents that verified passages connect; alone, a
    document is its own class. ``n_passages`` and ``duplicate_words`` count what the document repeats
    from earlier rows (smaller ids, null last; of one id, earlier places), ``partners`` lists the ids of
    those it was compared with. Null texts are empty; texts of under 50 words have no passages. Null ids
    name no class that holds another id. Rows that repeat are documents of their own, with passages in
    common. Other columns are ignored. A text of any length is compared whole.
    """
    some = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    table = numbered(some, "id", "passages")
    found = near_passages(table, column_of(some, "text"), **options)
    ids = table.select("row", F.col(column_of(some, "id")).alias("id"))
    joined = components(found.select(F.col("row").alias("a"), F.col("other").alias("b")))
    placed = ids.join(joined.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    # a component's root is its least row, which has its smallest id
    placed = placed.join(ids.select(F.col("row").alias("root"), F.col("id").alias("class_id")), "root")
    partner = found.join(ids.select(F.col("row").alias("other"), F.col("id").alias("partner")), "other")
    counts = partner.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.collect_set("partner")).alias("partners"))
    counts = counts.select("row", F.size(F.array_distinct(F.transform("spans", lambda s: F.struct(s["first"], s["last"])))).cast("long").alias("n_passages"), _covered(F.col("spans")).alias("duplicate_words"), "partners")
    out = placed.join(counts, "row", "left")
    empty = F.array().cast(f"array<{dict(some.dtypes)['id']}>")
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"), F.coalesce("duplicate_words", F.lit(0).cast("long")).alias("duplicate_words"), F.coalesce("partners", empty).alias("partners"))


def remove_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the words of passages that earlier rows have; all rows and columns stay.

    Earlier are smaller ids (null last), and of one id, earlier places; of equal texts of ``words``
    words or more all but the first lose all their words. White space before a deleted word goes with
    it. Null and empty texts stay as they are.
    """
    names, kinds = docs.columns, [t for _, t in docs.dtypes]
    table = numbered(docs, id_col, "passages")
    found = near_passages(table, column_of(docs, text_col), **options)
    cuts = found.select("row", F.explode("spans").alias("s")).groupBy("row").agg(F.collect_set(F.struct("s.first", "s.last")).alias("cuts"))
    flat = table.join(cuts, "row", "left").select(*[F.col(f"all.c{i}").alias(f"c{i}") for i in range(len(names))], "cuts")
    at = names.index(text_col)

    def make():
        import re

        piece = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

        def step(batch):
            clean = []
            for t, cuts in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if t and cuts:
                    parts = piece.findall(t)
                    keep = np.ones(len(parts), dtype=bool)
                    for s in cuts:
                        keep[s["first"] : s["last"] + 1] = False
                    t = "".join(p for p, k in zip(parts, keep, strict=True) if k)
                clean.append(t)
            return {f"c{i}": batch.column(i) for i in range(len(names))} | {f"c{at}": clean}

        return step

    out = map_rows(flat, make, ", ".join(f"c{i} {t}" for i, t in enumerate(kinds)))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
