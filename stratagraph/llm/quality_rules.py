"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import map_rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Characters that may end a line of prose.
ENDS = ".!?…:;\"'”’»)]。！？：；」』）"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = ("cookie", "javascript", "all rights reserved", "terms of use", "privacy policy", "lorem ipsum", "click here", "sign up", "log in", "subscribe")
#: Words for each boilerplate phrase of a line, up to which it counts as boilerplate however long it is.
PHRASE_WORDS = 30
SEPARATORS = {"|", "»", "«", ">", "<", "•", "·", "/", "::", "→", "-", "–"}
_SYMBOL_MAP = {ord(c): None for c in SYMBOLS}


def line_fails(line: str, words: list[str]) -> bool:
    """Punctuation, navigation and boilerplate rules for one line that has words."""
    n = len(words)
    if sum(w in SEPARATORS for w in words) * 5 > n:
        return True  # navigation: links between separators
    symbols = len(line) - len(line.translate(_SYMBOL_MAP))
    if symbols * 10 > len(line):
        return True
    if line.count("!!") * 2 > n:
        return True
    if n < 5 and line.rstrip()[-1:] not in ENDS:
        return True  # a short line that no sentence ends
    low = line.lower()
    return sum(low.count(x) for x in BOILERPLATE) * PHRASE_WORDS >= n


def repeated_words(words: list[str], window: int = 5) -> int:
    """Words in windows that the text has twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=n)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    m = n - window + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(window):
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += code[k : k + m]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def judge(text: str, max_lost: float = 0.5) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text of one document."""
    words = WORD.findall(text)
    n = len(words)
    word_chars = sum(map(len, words))
    n_symbols = len(text) - len(text.translate(_SYMBOL_MAP))
    seen: set[str] = set()
    dup = lost = 0
    left = []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            left.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if again or line_fails(line, own):
            lost += sum(map(len, own))
        else:
            left.append(line)
    repeated = repeated_words(words)
    base = n < 10 or 100 * repeated > 20 * n
    kept = not base and lost <= max_lost * word_chars
    return n, word_chars, n_symbols, dup, repeated, base, kept, "\n".join(left)




def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, with_text: bool = False) -> DataFrame:
    """Counts and verdict for every document; ``with_text`` adds ``cleaned``, its text without the failing lines.

    Null and empty texts have no words and are not kept. Ids may be null or repeat: a row out for
    every row in. Other columns are ignored. A text of any length is judged whole, one at a time.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean" + ", cleaned string" * with_text

    def make():
        def step(batch):
            rows = [judge(t, max_lost) for t in texts(batch)]
            cols = list(zip(*rows, strict=True))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")
            return {id_col: batch.column(0)} | dict(zip(names, map(list, cols), strict=True))

        return step

    return map_rows(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, schema)
