"""Byte-level BPE by a rank queue: a bitmap of two levels tells the lowest merge rank that waits.

Each rank has a bucket of positions in a linked list of parts. Finding the first set bit gives the
next rank, its bucket the leftmost position; entries whose pair has changed meanwhile are skipped.
Work is O(n log n) in the length of a pre-token, so very long pre-tokens need no special case.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import map_rows, texts

#: White space as the pre-token pattern sees it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space with the run that follows it: no pre-token reaches beyond.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WIDTH = 8
CACHE = 800_000


class RankQueueBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        by_rank = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, r in ranks.items():
            by_rank[r] = piece
        self.lengths = np.fromiter(map(len, by_rank), dtype=np.int64, count=len(by_rank))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(by_rank), dtype=np.uint8)
        self.low = [0] * ((len(by_rank) >> WIDTH) + 1)
        self.chunks, self.pieces = _Chunks(self), _Pieces(self)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> RankQueueBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        got = ranks.get(piece)
        if got is not None:
            return [got]
        n, get, low = len(piece), ranks.get, self.low
        mask = (1 << WIDTH) - 1
        after, before = list(range(1, n + 2)), list(range(-1, n))
        waits = [-1] * n  # the rank under which a position's pair stands in the queue
        buckets: dict[int, list[int]] = {}
        top = 0
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                waits[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> WIDTH] |= 1 << (r & mask)
                    top |= 1 << (r >> WIDTH)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            r = (word << WIDTH) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    top &= top - 1
            if waits[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            waits[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
            h = before[i]
            for at, end in ((h, k), (i, after[k])) if k < n else ((h, k),):
                if at >= 0:
                    new = get(piece[at:end])
                    if new is None:
                        waits[at] = -1
                    elif waits[at] != new:
                        waits[at] = new
                        if new in buckets:
                            heappush(buckets[new], at)
                        else:
                            buckets[new] = [at]
                            low[new >> WIDTH] |= 1 << (new & mask)
                            top |= 1 << (new >> WIDTH)
            if k >= n:
                waits[i] = -1
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> array:
        """Ids of a text, as unsigned 32-bit integers."""
        out = array("I")
        out.frombytes(b"".join(map(self.chunks.__getitem__, CHUNK.findall(text))))
        return out

    def decode(self, ids, block: int = 1 << 20) -> bytes:
        """Bytes of a sequence of ids, a block at a time."""
        out, ids = [], np.asarray(ids, dtype=np.int64)
        for at in range(0, len(ids), block):
            own = ids[at : at + block]
            n = self.lengths[own]
            ends = np.cumsum(n)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(self.starts[own] - ends + n, n)].tobytes())
        return b"".join(out)


class _Chunks(dict):
    """Ids of a chunk; chunks that recur are encoded once per worker."""

    def __init__(self, bpe: RankQueueBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        got = self.bpe.encode_chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = got
        return got


class _Pieces(dict):
    """Ids of a pre-token, for those that stand in several chunks."""

    def __init__(self, bpe: RankQueueBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        got = array("I", self.bpe.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = got
        return got


_loaded: dict[str, RankQueueBPE] = {}


def loaded(path: str, pattern: str) -> RankQueueBPE:
    if path not in _loaded:
        _loaded[path] = RankQueueBPE.from_file(path, pattern)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids binary``: each document's ids as little-endian unsigned 32-bit integers.

    Null texts are empty and have no ids. A row out for every row in; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        bpe = loaded(path, pattern)
        return lambda batch: {id_col: batch.column(0), "ids": [bpe.encode(t).tobytes() for t in texts(batch)]}

    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, f"`{id_col}` {kind}, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every document: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    Rows as for ``encode_documents``; the hashes are of the whole id sequence and of the decoded bytes.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        bpe = loaded(path, pattern)

        def step(batch):
            n, ids_hash, text_hash = [], [], []
            for t in texts(batch):
                ids = bpe.encode(t)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return {id_col: batch.column(0), "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

        return step

    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
