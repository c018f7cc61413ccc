"""Packing along a space-filling curve: documents in Hilbert order of their hashed vectors fill sequences one after another."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratagraph.llm.common import map_rows, texts, written

LENGTH, END = 4096, 2
DIMS, BITS = 4, 12
#: Runs of one generation, about 220 bytes each; a Python worker remembers two: workers outlive their tasks and share an executor's memory with its heap.
CACHE = 400_000
STOPS = (".", ",")
#: Letters of Latin-1 (normalising leaves each as it is, or makes it lower-case), and signs that begin no contraction and no special token.
LETTERS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([#*$%&.,;:!?]*)")
LOWER = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
PLAIN = re.compile(f"[{LOWER}]+")


def projection(vocabulary: int, dims: int = DIMS) -> np.ndarray:
    """A direction for every token id, from a hash of the id: values from -1 to 1."""
    x = np.arange(vocabulary * dims, dtype=np.uint64).reshape(vocabulary, dims)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2**52 - 1.0


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative integers below 2**bits (Skilling's transposition)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def ends_in_letter(word: str) -> bool:
    """Whether a word ends in a letter that normalising leaves one: a mark of its own would join what follows."""
    last = word[-1:]
    return last.isalpha() and (last.isascii() or unicodedata.normalize("NFC", word).lower()[-1:].isalpha())


class WordTokens:
    """Ids of texts by a tokenizer that drops white space, so that runs between spaces are encoded on their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.model, self.forms = self.tokenizer.model, self.letter_forms()

    def letter_forms(self) -> dict[int, str] | None:
        """What the tokenizer makes of each letter of ``LOWER`` before its model sees it; none if it does more to words of these than that."""
        normal, before = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if before is None or (normal is not None and normal.normalize_str(LOWER) != LOWER):
            return None
        forms = {ord(c): "".join(piece for piece, _ in before.pre_tokenize_str(c)) for c in LOWER}
        return forms if [piece for piece, _ in before.pre_tokenize_str(LOWER)] == [LOWER.translate(forms)] else None

    def plain(self, word: str) -> bytes:
        """Ids of a word of ``LOWER``: one piece, as it is, for the library's model."""
        return array(self.code, [t.id for t in self.model.tokenize(word.translate(self.forms))]).tobytes()

    @staticmethod
    def parts(run: str) -> tuple[str, ...]:
        """Shorter or lower-case runs whose ids make up those of ``run``; none if it is best left whole.

        Letters of Latin-1 are lower-cased by the tokenizer, and signs after them are a token run of their own, as is a full stop or
        comma after any letter.
        """
        if found := LETTERS.fullmatch(run):
            word, signs = found[1].lower(), found[2]
            return (word, signs) if signs else () if word == run else (word,)
        return (run[:-1], run[-1]) if run[-1:] in STOPS and ends_in_letter(run[:-1]) else ()

    def unknown(self, runs: set[str]) -> list[str]:
        """Those that neither generation has; what the older one has is taken over."""
        new = [c for c in runs if c not in self.known]
        if not self.older:
            return new
        self.known.update((c, self.older[c]) for c in new if c in self.older)
        return [c for c in new if c not in self.known]

    def encode(self, batch: list[str], most: int = 1 << 20) -> list[np.ndarray]:
        """Ids of each text; new runs of several texts (of ``most`` characters, or one text) go to the tokenizer together."""
        known, kind, out, at = self.known, self.code, [], 0
        while at < len(batch):
            if len(known) >= CACHE:  # runs that come again move to the next generation, so that frequent ones are not encoded anew
                self.older, self.known = known, {}
                known = self.known
            group, size = [], 0
            while at < len(batch) and (not group or size + len(batch[at]) <= most):
                group.append(batch[at].replace("\n", " ").split(" "))
                size += len(batch[at])
                at += 1
            new = self.unknown(set().union(*group))
            # what normalising and splitting make the same shares its words
            parts = {c: p for c in new if (p := self.parts(c))}
            words = self.unknown(set(new).difference(parts).union(*parts.values()))
            if self.forms is not None:
                plain = set(filter(PLAIN.fullmatch, words))
                known.update((c, self.plain(c)) for c in plain)
                words = [c for c in words if c not in plain]
            for c, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
                known[c] = array(kind, e.ids).tobytes()
            for c, p in parts.items():
                known[c] = b"".join([known[x] for x in p])
            get = known.__getitem__
            out += [np.frombuffer(b"".join(map(get, chunks)), dtype=self.dtype) for chunks in group]
        return out


_loaded: dict[str, tuple[WordTokens, np.ndarray]] = {}


def loaded(path: str) -> tuple[WordTokens, np.ndarray]:
    if path not in _loaded:
        words = WordTokens(path)
        _loaded[path] = words, projection(words.size)
    return _loaded[path]


def grid(ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The mean direction of a document's tokens, squashed onto the grid."""
    mean = np.zeros(directions.shape[1])
    if len(ids):
        mean = np.add.reduce(directions[ids]) / len(ids)
    return ((np.tanh(mean * 5) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """``id, key, n, ids``: Hilbert key, number of ids with the closing one, and the ids without it."""

    def make():
        words, directions = loaded(path)

        def step(batch):
            rows = words.encode(texts(batch))
            keys = hilbert_keys(np.array([grid(r, directions) for r in rows]))
            return {"id": batch.column(0), "key": keys.tolist(), "n": [len(r) + 1 for r in rows], "ids": [r.tobytes() for r in rows]}

        return step

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {dict(docs.dtypes)[id_col]}, key long, n long, ids binary")


def offsets(tokens: DataFrame) -> DataFrame:
    """``row, start``: where each document begins in the order of the curve.

    Only keys and lengths are range-sorted. The driver sees one total for each partition.
    """
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = tokens.select("key", "id", "row", "n").repartitionByRange(parts, "key", "id", "row").sortWithinPartitions("key", "id", "row")
    order = order.select("row", "n", F.spark_partition_id().alias("part"))
    schema = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("within", pa.int64()), ("n", pa.int64())])

    def run(batches):
        done = 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = done + np.cumsum(n)
            if len(n):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ends - n), b.column(1)], schema=schema)
                done = int(ends[-1])

    placed = written(order.mapInArrow(run, "row long, part int, within long, n long"), "curve")
    totals = sorted((r["part"], r["total"]) for r in placed.groupBy("part").agg(F.sum("n").alias("total")).collect())
    base, sofar = [], 0
    for part, total in totals:
        base += [F.lit(part), F.lit(sofar).cast("long")]
        sofar += total
    first = F.element_at(F.create_map(*base), F.col("part")) if base else F.lit(0).cast("long")
    return placed.select("row", (first + F.col("within")).alias("begin"))


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids, every sequence but the last one full.

    Texts are tokenised once; their ids wait in a table in the shared folder. A null or empty text is
    the closing id alone. Null ids sort first; rows that repeat are packed each on their own, and ties
    on the curve go by id, then by row. Other columns are ignored. An empty table gives no pieces.

    Returns ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    tokens = written(tokenised(docs, path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    begun = tokens.join(offsets(tokens).hint("shuffle_hash"), "row")
    kind = dict(docs.dtypes)[id_col]
    flat = pa.schema([to_arrow_schema(StructType.fromDDL(f"id {kind}")).field(0), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])

    def run(batches):
        dtype = loaded(path)[0].dtype
        for batch in batches:
            out = []
            for doc, n, ids, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.append(np.frombuffer(ids, dtype=dtype), end).astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, length)
                    size = min(n - at, length - offset)
                    out.append((doc, at, size, zlib.crc32(own[at : at + size]), n, sequence, offset))
                    at += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), flat, strict=True)], schema=flat)

    pieces = begun.select("id", "n", "ids", "begin").mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)
