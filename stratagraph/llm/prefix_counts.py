"""Exact token counts of every prefix of a text, for vocabularies whose merges follow the pieces' scores.

A sequence of such pieces is the encoding of its text exactly if each two neighbours are the encoding
of theirs. So the last piece of each prefix is the one piece that may stand after the last piece of
the prefix before it, and the count of a prefix is one more than that prefix's. Pieces never reach
from other characters over a word mark, so texts fall into segments that are counted on their own.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import map_rows, texts

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Entries that each cache may have; a full one is emptied.
CACHE = 800_000


class PrefixCounter:
    """Prefix counts for a byte-fallback vocabulary. ``scores`` has a piece's merge score; higher merges first."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.totals = _Totals(self)

    @classmethod
    def from_sentencepiece(cls, path: str) -> PrefixCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by plain merging; only pieces and pairs of pieces are looked up with it."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def _alone(self, a: str) -> bool:
        got = self.whole.get(a)
        if got is None:
            got = self.whole[a] = self.merged(a) == [a]
        return got

    def segment(self, s: str) -> list[int]:
        """Token counts of every prefix of a segment, the whole last."""
        scores, longest, fits, alone = self.scores, self.longest, self._fits, self._alone
        n = len(s)
        counts, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                piece = s[j:i]
                if piece not in scores:
                    continue
                before = last[j]
                if alone(piece) and (not before or before not in scores or fits(before, piece)):
                    counts[i], last[i] = counts[j] + 1, piece
                    break
            else:  # one character that the vocabulary lacks: its bytes
                counts[i], last[i] = counts[i - 1] + len(s[i - 1].encode()), s[i - 1]
        return counts[1:]

    def marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def prefixes(self, text: str) -> np.ndarray:
        """Element i: tokens of the first i code points of the text, for every i from 0 to its length."""
        if not text:
            return np.zeros(1, dtype=np.int64)
        parts, base = [], 0
        for s in SEGMENT.findall(self.marked(text)):
            own = np.asarray(self.segment(s), dtype=np.int64) + base
            base = int(own[-1])
            parts.append(own)
        out = np.concatenate(parts)
        out[0] = 0  # the mark alone stands for the empty text
        return out

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last prefix's count."""
        if not text:
            return 0
        totals = self.totals
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(totals.__getitem__, text.split(" ")))
        return sum(totals[s[1:]] if s[0] == MARK else self.segment(s)[-1] for s in SEGMENT.findall(self.marked(text)))

    def cut(self, text: str, budget: int) -> int:
        """Length of the longest prefix, in code points, whose own encoding has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


class _Totals(dict):
    """Count of a segment that begins with one mark, by what follows the mark."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, rest: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self.counter.segment(MARK + rest)[-1]
        if len(rest) <= 64:
            self[rest] = got
        return got


_loaded: dict[str, PrefixCounter] = {}


def loaded(path: str) -> PrefixCounter:
    """One counter per worker process, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter.from_sentencepiece(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, with_cut: bool = False) -> DataFrame:
    """Bytes, tokens and whether these pass ``limit``, for every document.

    ``with_cut`` adds ``cut_chars``: how many code points of the text fit the limit. Null texts are
    empty and have 0 tokens. A row out for every row in, whatever its id; other columns are ignored.
    The vocabulary is read on each executor from ``path``.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        counter = loaded(path)

        def step(batch):
            own = texts(batch)
            n = [counter.count(t) for t in own]
            out = {id_col: batch.column(0), "n_bytes": [len(t.encode()) for t in own], "n_tokens": n, "over_limit": [x > limit for x in n]}
            if with_cut:
                out["cut_chars"] = [len(t) if x <= limit else counter.cut(t, limit) for t, x in zip(own, n, strict=True)]
            return out

        return step

    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", cut_chars long" * with_cut
    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, schema)
