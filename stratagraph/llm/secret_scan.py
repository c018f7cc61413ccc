"""Secrets in texts: fixed patterns, and a battery of randomness tests for whatever else looks like a key.

Runs of 20 or more symbols are candidates. The smallest alphabet that holds a run is its inferred encoding. Three
tests ask whether its symbols could be drawn evenly from it: chi-squared of the symbols' counts, the number of
runs above and below the alphabet's middle (Wald and Wolfowitz), and serial correlation at lag one. Fisher's
method makes one p-value of three; keys have any, ordinary text in an encoding has small ones.

How often ordinary text passes is measured, not assumed: the texts that hold candidates, without them, are written
in the same encodings and cut into pieces as long as the shortest candidate of a length band. For each size of
alphabet and band, the least p is sought at which the rate of passing pieces, times the candidates, is at most
``LEVEL`` of the candidates that pass. Short bands, where tests tell little, so need larger p, or report nothing; so
does a band of very few candidates. Counts cover all documents.

Everything is SQL functions over columns. Texts are read once; what is kept of them is matches, lengths between
matches, and the pieces of texts with candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.llm.common import written

#: Fixed by the contract, in its order.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_ASSIGNED = 6
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = (*PATTERNS, "random")
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encodings by size: name, symbols, and how ordinary text is written in it.
ENCODINGS = (
    ("hex", DIGITS + "abcdef", F.lower), ("HEX", DIGITS + "ABCDEF", F.upper), ("base32", UPPER + "234567", F.upper), ("base36", DIGITS + LOWER, F.lower),
    ("BASE36", DIGITS + UPPER, F.upper), ("base64", UPPER + LOWER + DIGITS + "+/", lambda c: c), ("base64url", UPPER + LOWER + DIGITS + "-_", lambda c: c),
)
#: Least lengths of the bands.
BANDS = (20, 28, 40, 64)
#: Share of ordinary runs among those reported.
LEVEL = 0.02
BINS = 100
LEAST_P = 1e-12


def _class(symbols: str) -> str:
    return "[" + symbols.replace("-", r"\-") + "]"


def encoding(run: Column) -> Column:
    """Name of the smallest alphabet that holds all of a run but its padding; null for numbers and for runs that mix alphabets."""
    core = F.regexp_replace(run, "=+$", "")
    out = F.when(core.rlike("^[0-9]*$"), F.lit(None).cast("string"))
    for name, symbols, _ in ENCODINGS:
        out = out.when(core.rlike(f"^{_class(symbols)}+$"), F.lit(name))
    return out


def band(n: Column) -> Column:
    out = F.lit(BANDS[0])
    for least in BANDS[1:]:
        out = F.when(n >= least, least).otherwise(out)
    return out


def _of_encoding(name: Column, value) -> Column:
    out = None
    for e, symbols, _ in ENCODINGS:
        out = F.when(name == e, value(symbols)) if out is None else out.when(name == e, value(symbols))
    return out


def normal_tail(z: Column) -> Column:
    """Probability above ``z`` (not negative) of the standard normal law, within 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * series


def battery(runs: DataFrame) -> DataFrame:
    """Adds ``p_even, p_runs, p_serial`` and Fisher's ``p`` to runs ``value, encoding``; padding is left out.

    chi-squared has its exact mean and variance under even drawing, and the cube root for its shape. A run on one side
    of the middle, or of one symbol, has the least p.
    """
    df = runs.withColumn("_y", F.regexp_replace("value", "=+$", "")).withColumn("_n", F.length("_y").cast("double"))
    df = df.withColumn("_k", _of_encoding(F.col("encoding"), lambda s: F.lit(float(len(s)))))
    squares = _of_encoding(F.col("encoding"), lambda s: F.aggregate(F.array(*[F.lit(c) for c in s]), F.lit(0.0), lambda a, c: a + F.pow(F.col("_n") - F.length(F.replace(F.col("_y"), c, F.lit(""))), F.lit(2.0))))
    half = lambda s: F.translate(F.col("_y"), s, "L" * (len(s) // 2) + "H" * (len(s) - len(s) // 2))
    df = df.withColumn("_sides", _of_encoding(F.col("encoding"), half))
    df = df.withColumn("_v", _of_encoding(F.col("encoding"), lambda s: F.transform(F.split("_y", ""), lambda c: F.position(c, F.lit(s)).cast("double"))))

    chi = F.col("_k") / F.col("_n") * squares - F.col("_n")
    mean, var = F.col("_k") - 1, 2 * (F.col("_k") - 1) * (F.col("_n") - 1) / F.col("_n")
    ninth = var / (9 * mean * mean)
    df = df.withColumn("_z_even", (F.cbrt(F.greatest(chi, F.lit(0.0)) / mean) - (1 - ninth)) / F.sqrt(ninth))

    high = F.col("_n") - F.length(F.replace(F.col("_sides"), F.lit("H"), F.lit("")))
    expected = 2 * high * (F.col("_n") - high) / F.col("_n") + 1
    spread = (expected - 1) * (expected - 2) / (F.col("_n") - 1)
    seen = F.size(F.regexp_extract_all("_sides", F.lit("L+|H+"), F.lit(0)))
    df = df.withColumn("_z_runs", F.when(spread > 0, F.abs(seen - expected) / F.sqrt(spread)))

    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    n = F.col("_n").cast("int")
    df = df.withColumn("_sum", total(F.col("_v"))).withColumn("_squares", total(F.transform("_v", lambda x: x * x)))
    df = df.withColumn("_lagged", total(F.zip_with(F.slice("_v", F.lit(1), n - 1), F.slice("_v", F.lit(2), n - 1), lambda a, b: a * b)))
    m = F.col("_sum") / F.col("_n")
    around = F.col("_squares") - F.col("_sum") * m
    joint = F.col("_lagged") - m * (2 * F.col("_sum") - F.element_at("_v", 1) - F.element_at("_v", -1)) + (F.col("_n") - 1) * m * m
    df = df.withColumn("_z_serial", F.when(around > 0, F.abs(joint / around + 1 / F.col("_n")) * F.sqrt("_n")))

    tail = lambda z: normal_tail(F.abs(z))
    bounded = lambda p: F.least(F.greatest(F.coalesce(p, F.lit(LEAST_P)), F.lit(LEAST_P)), F.lit(1.0))
    df = df.withColumn("p_even", bounded(F.when(F.col("_z_even") >= 0, tail(F.col("_z_even"))).otherwise(1 - tail(F.col("_z_even")))))
    df = df.withColumn("p_runs", bounded(2 * tail(F.col("_z_runs")))).withColumn("p_serial", bounded(2 * tail(F.col("_z_serial"))))
    x = -(F.log("p_even") + F.log("p_runs") + F.log("p_serial"))
    return df.withColumn("p", F.exp(-x) * (1 + x + x * x / 2)).select(*runs.columns, "p_even", "p_runs", "p_serial", "p")


def thresholds(tested: DataFrame, level: float = LEVEL) -> DataFrame:
    """``size, band, least``: the least bin of p at which candidates (``target``) of an alphabet's size and a band are reported.

    Bands without a bin that meets ``level`` have no row. The table has a row for each size and band at most.
    """
    counts = tested.groupBy("size", "band", "bin").agg(F.count_if("target").alias("t"), F.count_if(~F.col("target")).alias("d"))
    above = W.partitionBy("size", "band").orderBy(F.desc("bin"))
    whole = W.partitionBy("size", "band")
    counts = counts.select("size", "band", "bin", *[F.sum(c).over(w).alias(name) for c, w, name in (("t", above, "t"), ("d", above, "d"), ("t", whole, "all_t"), ("d", whole, "all_d"))])
    rate = (F.col("d") + 1) / F.col("all_d") * F.col("all_t") / F.col("t")
    return counts.where((F.col("all_d") > 0) & (F.col("t") > 0)).where(rate <= level).groupBy("size", "band").agg(F.min("bin").alias("least"))


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, hits, pieces``: a written table of what each text's patterns match, and of ordinary text where there are candidates.

    A hit is ``kind, at`` (its number among those of the kind), ``before`` (code points since the last match),
    ``n`` (its own), ``value``.
    """
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    patterns = [*PATTERNS.values(), RANDOM]
    for k, pattern in enumerate(patterns):
        df = df.withColumn(f"m{k}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("m0v", F.regexp_extract_all("text", F.lit(patterns[0]), F.lit(2)))
    for k, pattern in enumerate(patterns):
        df = df.withColumn(f"b{k}", F.when(F.size(f"m{k}") > 0, F.transform(F.split("text", pattern, -1), F.length)))
    # lambdas read nothing but their arrays: what they name besides would be worked out anew for each element
    value = {0: lambda s: F.when(F.length(s.m0v) >= LEAST_ASSIGNED, F.lit("")), 3: lambda s: s.m3}
    none = F.array().cast("array<struct<kind:int,at:int,before:int,n:int,value:string>>")

    def hit(k: int) -> Column:
        made = lambda s, i: F.struct(F.lit(k).alias("kind"), i.alias("at"), s[f"b{k}"].alias("before"), F.length(s[f"m{k}"]).alias("n"), value.get(k, lambda s: F.lit(""))(s).alias("value"))
        return F.coalesce(F.transform(F.arrays_zip(f"m{k}", f"b{k}", *["m0v"] * (k == 0)), made), none)

    df = df.withColumn("hits", F.concat(*[hit(k) for k in range(4)]))
    df = df.withColumn("seen", F.transform("m3", lambda x: F.struct(encoding(x).alias("e"), band(F.length(F.regexp_replace(x, "=+$", ""))).alias("b"))))
    df = df.withColumn("plain", F.when(F.size("m3") > 0, F.regexp_replace("text", RANDOM, " ")))
    pieces, no_pieces = [], F.array().cast("array<struct<encoding:string,band:int,value:string>>")
    for name, symbols, written_in in ENCODINGS:
        df = df.withColumn(f"in_{name}", F.when(F.exists("seen", lambda s: s.e == name), F.regexp_replace(written_in(F.col("plain")), f"[^{_class(symbols)[1:]}", "")))  # noqa: B023
        for least in BANDS:
            cut = F.transform(F.regexp_extract_all(f"in_{name}", F.lit(".{%d}" % least), F.lit(0)), lambda x: F.struct(F.lit(name).alias("encoding"), F.lit(least).alias("band"), x.alias("value")))  # noqa: B023
            pieces.append(F.when(F.exists("seen", lambda s: (s.e == name) & (s.b == least)), cut).otherwise(no_pieces))  # noqa: B023
    return written(df.select(F.monotonically_increasing_id().alias("row"), "id", "hits", F.concat(*pieces).alias("pieces")), "secrets")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """A row for each row of ``docs``: its id, ``n_assign, n_access, n_hex, base_sha256, spans, n_random``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind, joined by commas; ``base_sha256`` is
    the hash of those of the fixed patterns. Spans of the tests do not overlap those. A null text is empty; null and
    repeated ids give a row each; other columns are dropped. Whole texts are read; the spans of one text meet in one task.
    """
    found = _matches(docs, id_col, text_col)
    hits = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*").where("n IS NOT NULL")
    so_far = W.partitionBy("row", "kind").orderBy("at")
    hits = hits.withColumn("end", F.sum(F.col("before") + F.col("n")).over(so_far).cast("long")).withColumn("start", F.col("end") - F.col("n"))
    hits = hits.where("value IS NOT NULL").withColumn("base", F.col("kind") < 3)
    in_text = W.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(in_text.rowsBetween(W.unboundedPreceding, 0))
    behind = F.min(F.when(F.col("base"), F.col("start"))).over(in_text.rowsBetween(0, W.unboundedFollowing))
    hits = hits.withColumn("free", ~F.col("base") & ~F.coalesce((before > F.col("start")) | (behind < F.col("end")), F.lit(False)))

    size = _of_encoding(F.col("encoding"), lambda s: F.lit(len(s)))
    runs = hits.where("kind = 3").withColumn("encoding", encoding(F.col("value"))).where("encoding IS NOT NULL")
    runs = runs.select("row", "start", "end", "free", "encoding", band(F.length(F.regexp_replace("value", "=+$", ""))).alias("band"), "value", F.lit(True).alias("target"))
    pieces = found.where(F.size("pieces") > 0).select("row", F.explode("pieces").alias("c")).select("row", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(False).alias("free"), "c.encoding", "c.band", "c.value", F.lit(False).alias("target"))
    tested = lambda df: battery(df).select("row", "start", "end", "free", "target", "band", size.alias("size"), F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin"))
    least = thresholds(tested(runs.unionByName(pieces)), level)
    random = tested(runs.where("free")).join(least, ["size", "band"]).where("bin >= least").select("row", F.lit(3).alias("kind"), "start", "end")

    spans = hits.where("base").select("row", "kind", "start", "end").unionByName(random)
    named = F.array(*[F.lit(k) for k in KINDS])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(named, s.kind), s.start, s.end)), ",")
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)])
    spans = spans.select("row", text(F.filter("all", lambda s: s.kind < 3)).alias("base"), text(F.col("all")).alias("spans"), *[f"n_{name}" for name in KINDS])
    none = F.lit(0).cast("long")
    return found.select("row", "id").join(spans, "row", "left").select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_random", none).alias("n_random"),
    )
