"""Packing by exact reassembly against the tokenizer library."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from stratagraph.llm import packing

PATH = P.path("word_bpe_49k.json")


def test_hilbert_neighbours_touch():
    side = 8
    points = np.array([[a, b, c] for a in range(side) for b in range(side) for c in range(side)])
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_tokens_equal_library():
    odd = ["", " ", "It's  A\ttest\n\nÉcole ÉCOLE", "<|endoftext|> x<|startoftext|>y", "a\x1cb", "ΟΔΟΣ ΟΔΟΣ.", "é", "1234 5'6", "你好 世界", "it's. it's, a., b,. ,. . É. ǅ, x\u0301. 5. ª, <|endoftext|>. ʰ.", "it's it a b"]
    library = Tokenizer.from_file(PATH)
    for t, ids in zip(odd, packing.WordTokens(PATH).encode(odd), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_plain_words_go_to_the_model_alone():
    """Words of Latin-1 letters do not pass the whole tokenizer; ids are the library's, as they are beside letters and signs that are not plain."""
    library, words = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    plain = ["schauüach", "Auütz", "ciónasdoes###", "Geieä", "STRASSE.", "éleviç,", packing.LOWER, packing.LOWER.upper(), "x" * 3000]
    odd = ["ÿ÷×ß", "Ünï'ts", "e\u0301te", "ª º µ", "ŒÆæ", "İi", "ſ", "Ø'S", "é<|endoftext|>"]
    seen = []

    class Spy:
        def encode_batch_fast(self, new, **options):
            seen.extend(new)
            return library.encode_batch_fast(new, **options)

    words.tokenizer = Spy()
    text = " ".join(plain + odd)
    assert words.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert seen and not [x for x in seen if packing.PLAIN.fullmatch(x)]
    words.forms = None
    words.known.clear()
    assert words.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces(spark):
    texts = [(1, "hello world " * 900), (2, None), (2, ""), (None, "x"), (5, "the end"), (5, "the end"), (7, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, ids string, row long")
    got = packing.pack(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted(((i is None, i), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts if i != 5 and i is not None)
    for (_, i), ids in want:
        own = sorted((r for r in got if r.doc_id == i and r.doc_tokens == len(ids)), key=lambda r: r.start)
        at = 0
        for r in own if i != 2 else own[:1]:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.LENGTH or s == max(r.sequence_id for r in got)
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_marks_that_normalising_makes_join_what_follows():
    words = ["\u0915\u095c", "TAKS\u0130", "\u0915\u095c\u0915", "\u0130x", "\u0958", "caf\u00e9", "cafe\u0301", "\u0391\u03a3", "\u1fb3", "\u01f0", "\ufb2a", "\u0345a", "\u1e9e", "\uac00"]
    runs = [w + stop for w in words for stop in (",", ".")]
    runs += [chr(c) + "," for c in range(0x80, 0x30000) if chr(c).isalpha()]
    library = Tokenizer.from_file(PATH)
    want = library.encode_batch_fast(runs, add_special_tokens=False)
    for t, ids, e in zip(runs, packing.WordTokens(PATH).encode(runs), want, strict=True):
        assert ids.tolist() == e.ids, ascii(t)


def test_runs_of_one_word_are_encoded_once():
    """Runs that differ by capitals or signs after the word cost one run of the tokenizer, and get its ids."""
    runs = [w + s for w in ("word", "Word", "WORD", "s", "S", "It") for s in ("", ".", ",", "$$$", "%%.", "#*&", "!?", ":;")]
    runs += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>.", "word|", "word<", "it's", "It's.", "IT'S", "a'", "a''s", "9.", "a9$", "\u212a.", "x\u0301$", "caf\u00e9$", "A$a", "$A"]
    library = Tokenizer.from_file(PATH)
    mine = packing.WordTokens(PATH)
    for t, ids in zip(runs, mine.encode(runs), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
    sent, inner = [], packing.WordTokens(PATH)
    tokenizer = inner.tokenizer
    inner.tokenizer = type("Counted", (), {"encode_batch_fast": lambda self, words, **k: sent.extend(words) or tokenizer.encode_batch_fast(words, **k)})()
    inner.encode(["word Word WORD word. Word$$$ WORD,"])
    assert sorted(sent) == ["$$$", ",", ".", "word"]


def test_frequent_runs_outlast_the_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    sent, words = [], packing.WordTokens(PATH)
    tokenizer = words.tokenizer
    words.tokenizer = type("Counted", (), {"encode_batch_fast": lambda self, runs, **k: sent.extend(runs) or tokenizer.encode_batch_fast(runs, **k)})()
    texts = ["the of " + " ".join(f"x{chr(97 + i)}{chr(97 + j)}" for j in range(26)) for i in range(20)]
    for t in texts:
        assert words.encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert sent.count("the") == 1 and len(words.known) + len(words.older) < 160
