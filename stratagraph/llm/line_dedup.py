"""Line dedup over a suffix array of line ids, built by prefix doubling.

Every document is a sequence of line ids, and every line begins a suffix. A suffix's rank is a path:
its line id, then for k = 1, 2, ... the number of its run of 2**k lines, which a range sort of the
pairs (rank of its half, rank of the suffix that follows the half) gives in each round. A suffix
whose number no other has, or whose document ends, is ranked and drops out of the rounds, so these
shrink to what is repeated. Paths compare as arrays, so sorting by them gives the suffix array of all suffixes that
begin with a repeated line. The longest common prefix of two neighbours follows from the entries
their paths share, then those of the suffixes behind that, and so on. Cut where it falls below a
length, the array falls into intervals: all copies of one run. All but the first copy are later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.llm.common import column_of, drop_written, join_counted, map_rows, numbered, written

WORD, GAP = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]"


def line_ids(docs: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """``row, pos, left, path, long``: every line with a word.

    ``pos`` counts such lines, ``left`` tells how many there are from this one on, ``path`` is the
    line's 128-bit hash as two numbers, ``long`` tells if it has ``min_words`` words.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(WORD))
    each = docs.select("row", lines.alias("lines")).select("row", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    many = f"^{GAP}*+(?:{WORD}+{GAP}++){{{max(0, min_words - 1)}}}{WORD[:-1]}"
    return each.select("row", "pos", (F.col("n") - F.col("pos")).alias("left"), F.array(F.xxhash64("line"), F.xxhash64(F.lit(1), "line")).alias("path"), F.col("line").rlike(many).alias("long"))


def _sorted_numbers(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``at``, which ascends in the order of ``keys`` through a range sort, written once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)


def suffix_paths(lines: DataFrame) -> DataFrame:
    """``row, pos, left, long, path``: the final path of every suffix that begins with a repeated line, in written tables.

    Two suffixes have equal paths only if they are equal to the ends of their documents. Counts are
    taken before anything is joined to them; keys with very many rows are split (``join_counted``).
    """
    counts = written(lines.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "line-counts")
    first = join_counted(lines, counts, ["path"]).select("row", "pos", "left", "long", "path", F.lit(True).alias("open"), F.lit(1).alias("step"))
    tables = [written(first, "suffixes")]
    drop_written(counts)
    # all rounds run the same plan, in which the length of the runs is a column, so that Spark compiles it once
    while n := (now := tables[-1].where("open")).count():
        known = tables[-1].select("row", "pos", "path")
        if len(tables) > 1:
            known = known.unionByName(_ended(tables[:-1]).select("row", "pos", "path"))
        ahead = known.select("row", F.col("pos").alias("at"), F.col("path").alias("next"))
        # a line that occurs once is in no table of suffixes: such lines come first among all, by their places
        lone = F.array(F.lit(-(1 << 63)).cast("long"), F.col("row"), F.col("at").cast("long"))
        follows = F.when(F.col("left") <= F.col("step"), F.array().cast("array<bigint>")).otherwise(F.coalesce("next", lone))
        keyed = written(now.withColumn("at", F.col("pos") + F.col("step")).join(ahead, ["row", "at"], "left").withColumn("next", follows).drop("at", "open"), "keyed")
        ranks = _sorted_numbers(keyed.groupBy("path", "next").agg(F.count("*").alias("n")), ["path", "next"], "ranks")
        # a suffix that ends in this run equals the others of its number
        is_open = (F.col("n") > 1) & (F.col("left") > F.col("step"))
        again = join_counted(keyed, ranks, ["path", "next"], total=n).select("row", "pos", "left", "long", F.concat("path", F.array("at")).alias("path"), is_open.alias("open"), (F.col("step") * 2).alias("step"))
        tables.append(written(again, "suffixes"))
        drop_written(keyed)
        drop_written(ranks)
    out = _ended(tables)
    out._parts = tables
    return out


def _ended(tables: list[DataFrame]) -> DataFrame:
    """The suffixes that left the rounds, in one scan of the tables of several rounds."""
    paths = [t._written_at for t in tables]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths).where("NOT open").drop("open", "step")


def _levels(a: str, b: str) -> Column:
    """How many numbers two paths share: k for suffixes that share a run of 2**(k - 1) lines, but none of 2**k."""
    return F.greatest(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) - 1, F.lit(0))


def suffix_array(paths: DataFrame) -> DataFrame:
    """``at, before, part, row, pos, long, lcp``: suffixes in order, with the lines each has in common with the one ``before`` it (written).

    Equal suffixes follow the order of documents. ``part`` is the range partition, of which there are
    as many as shuffle partitions; only tables of one row for each are seen whole.
    """
    order = _sorted_numbers(paths, ["path", "row", "pos"], "suffix-order").withColumn("part", F.shiftright("at", 33))
    ends = order.groupBy("part").agg(F.max_by(F.struct("at", "row", "pos", "path"), "at").alias("end"))
    edges = ends.select("part", F.lag("end").over(W.orderBy("part")).alias("edge"))
    pairs = order.join(edges, "part").withColumn("b", F.coalesce(F.lag(F.struct("at", "row", "pos", "path")).over(W.partitionBy("part").orderBy("at")), "edge"))
    same = F.col("path") == F.col("b.path")
    level = F.when(F.col("b").isNull(), 0).otherwise(_levels("path", "b.path"))
    pairs = pairs.withColumn("level", F.when(same, 0).otherwise(level)).withColumn("lcp", F.when(same, F.col("left")).when(level > 0, F.pow(F.lit(2), level - 1).cast("int")).otherwise(0))
    now = written(pairs.select("at", F.col("b.at").alias("before"), "part", "row", "pos", "long", F.col("b.row").alias("brow"), F.col("b.pos").alias("bpos"), "level", "lcp"), "neighbours")
    drop_written(order)
    first, open_, more = now, now.where("level > 1").select("at", "row", "pos", "brow", "bpos", "lcp"), []
    while not open_.isEmpty():
        x = paths.select("row", F.col("pos").alias("xpos"), F.col("path").alias("x"), "left")
        y = paths.select(F.col("row").alias("brow"), F.col("pos").alias("ypos"), F.col("path").alias("y"))
        both = open_.withColumn("xpos", F.col("pos") + F.col("lcp")).withColumn("ypos", F.col("bpos") + F.col("lcp")).join(x, ["row", "xpos"]).join(y, ["brow", "ypos"])
        equal, shared = F.col("x") == F.col("y"), _levels("x", "y")
        gain = F.when(equal, F.col("left")).when(shared > 0, F.pow(F.lit(2), shared - 1).cast("int")).otherwise(0)
        got = written(both.select("at", "row", "pos", "brow", "bpos", (F.col("lcp") + gain).alias("lcp"), F.when(equal, 0).otherwise(shared).alias("level")).where(gain > 0), "longer")
        more.append(got)
        open_ = got.where("level > 1").drop("level")
    if not more:
        return first
    grown = more[0]
    for m in more[1:]:
        grown = grown.unionByName(m)
    best = grown.groupBy("at").agg(F.max("lcp").alias("grown"))
    out = written(first.drop("brow", "bpos", "level").join(best, "at", "left").withColumn("lcp", F.greatest("lcp", F.coalesce("grown", F.lit(0)))).drop("grown"), "suffix-array")
    for d in (first, *more):
        drop_written(d)
    return out


def intervals(array: DataFrame, depths: list[int]) -> DataFrame:
    """``array`` with a column ``in<depth>`` for each depth: where the suffix's interval begins (written).

    An interval is what lies between two neighbours with fewer than ``depth`` lines in common; it may
    reach over many partitions.
    """
    cut = {d: F.when(F.col("lcp") < d, F.col("at")) for d in depths}
    starts = array.groupBy("part").agg(*[F.max(cut[d]).alias(f"top{d}") for d in depths])
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = starts.select("part", *[F.max(f"top{d}").over(earlier).alias(f"top{d}") for d in depths])
    inside = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = array.join(carried, "part").select(*array.columns, *[F.coalesce(F.max(cut[d]).over(inside), F.col(f"top{d}")).alias(f"in{d}") for d in depths])
    return written(rows, "intervals")


def later_copies(placed: DataFrame, depth: int) -> DataFrame:
    """``at, row, pos, depth``: the suffixes whose first ``depth`` lines an earlier place has (written).

    The first copy in an interval of ``intervals`` is the least (row, pos).
    """
    name = f"in{depth}"
    found = written(placed.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first")).where("n > 1"), "firsts")
    out = join_counted(placed, found, [name]).where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    out = written(out.select("at", "row", "pos", F.lit(depth).alias("depth")), "later-copies")
    drop_written(found)
    return out


def remove_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """``docs`` with its text cleaned, and ``n_lines, n_removed, longest_run``: lines with words, those deleted, and lines
    in the longest run that begins at a deleted place and stands elsewhere too (0 without one).

    A repeated run counts if it has ``min_lines`` lines or is a line of ``min_words`` words; in every
    copy but the first its lines go. The first copy is that of the smallest id (null last), then of
    the earliest row and line. Lines without words stay and are not part of runs. Null texts stay
    null; a document may end up with an empty text. All rows and columns are kept, except that a
    column named like a new one is replaced. Very long texts are cut into lines like any other.
    """
    if min_lines < 1:
        raise ValueError("min_lines is at least 1")
    names = docs.columns
    kept = [c for c in names if c not in ("n_lines", "n_removed", "longest_run")]
    table = numbered(docs, id_col, "lines")
    lines = written(line_ids(table.select("row", F.col(column_of(docs, text_col)).alias("_text")), "_text", min_words), "line-ids")
    paths = suffix_paths(lines)
    drop_written(lines)
    array = suffix_array(paths)
    for d in paths._parts:
        drop_written(d)
    whole = table.select(F.col("row").alias("_row"), F.struct(*[F.col(column_of(docs, c)).alias(f"_k{i}") for i, c in enumerate(kept)]).alias("_all"))
    placed = intervals(array, sorted({1, min_lines}))
    runs = later_copies(placed, min_lines)
    if min_lines > 1:  # single long lines: all places of an interval of depth 1 begin with the same line
        runs = runs.unionByName(later_copies(placed.where("long"), 1))
    drop_written(placed)
    # a place's longest run is shared with the neighbour before it or the one after it
    edges = array.select("at", "lcp").unionByName(array.select(F.col("before").alias("at"), "lcp")).where("lcp > 0")
    deepest = runs.join(edges, "at").groupBy("row").agg(F.max("lcp").alias("_longest"))
    cuts = runs.select("row", F.explode(F.sequence("pos", F.col("pos") + F.col("depth") - 1)).alias("p")).groupBy("row").agg(F.collect_set("p").alias("_cuts"))
    marks = cuts.join(deepest, "row").withColumnRenamed("row", "_row")
    whole = whole.join(marks, "_row", "left").withColumn("_longest", F.coalesce("_longest", F.lit(0)))
    flat = whole.select(*[F.col("_all")[f"_k{i}"].alias(f"_c{i}") for i in range(len(kept))], "_cuts", "_longest")
    kinds = dict(docs.dtypes)
    text_at = kept.index(text_col)
    schema = ", ".join(f"_c{i} {kinds[c]}" for i, c in enumerate(kept)) + ", n_lines long, n_removed long, longest_run long"

    def make():
        import re

        word = re.compile(WORD.replace("\\\\", "\\"))

        def step(batch):
            clean, n_lines, n_removed = [], [], []
            for t, cuts in zip(batch.column(text_at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                gone, out, at = set(cuts or ()), [], 0
                for line in (t or "").split("\n"):
                    if word.search(line):
                        if at not in gone:
                            out.append(line)
                        at += 1
                    else:
                        out.append(line)
                clean.append(None if t is None else "\n".join(out))
                n_lines.append(at)
                n_removed.append(len(gone))
            out = {f"_c{i}": batch.column(i) for i in range(len(kept))}
            return out | {f"_c{text_at}": clean, "n_lines": n_lines, "n_removed": n_removed, "longest_run": batch.column(len(kept) + 1).cast("int64")}

        return step

    result = map_rows(flat, make, schema)
    return result.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], "n_lines", "n_removed", "longest_run")


#: The same deletions by window functions, and longest runs by growing all repeated runs line by line, for tables whose ids differ.
ORACLE_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), worded AS MATERIALIZED (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o,
    lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, o) AS one,
    CASE WHEN following IS NOT NULL THEN row_number() OVER (PARTITION BY line, following ORDER BY doc_id, o) END AS two
  FROM worded
), marked AS (
  SELECT *, (one > 1 AND words >= 8) OR coalesce(two, 1) > 1 OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY o), 1) > 1 AS gone FROM ranked
), every AS (
  SELECT l.doc_id, l.i, l.line, m.o IS NOT NULL AS worded, coalesce(m.gone, false) AS gone FROM lines l LEFT JOIN marked m USING (doc_id, i)
), repeated(n, doc_id, o, run) AS (
  SELECT 1::BIGINT, doc_id, o, run FROM (SELECT doc_id, o, dense_rank() OVER (ORDER BY line) AS run, count(*) OVER (PARTITION BY line) AS places FROM worded) WHERE places > 1
  UNION ALL
  SELECT n + 1, doc_id, o, run FROM (
    SELECT r.n, r.doc_id, r.o, dense_rank() OVER (ORDER BY r.run, w.line) AS run, count(*) OVER (PARTITION BY r.run, w.line) AS places
    FROM repeated r JOIN worded w ON w.doc_id = r.doc_id AND w.o = r.o + r.n) WHERE places > 1
), longest AS (
  SELECT r.doc_id, max(r.n) AS n FROM repeated r JOIN ranked k USING (doc_id, o) WHERE (k.one > 1 AND k.words >= 8) OR k.two > 1 GROUP BY r.doc_id
)
SELECT doc_id, n_lines, n_removed, coalesce(n, 0)::BIGINT AS longest_run, clean_md5 FROM (
SELECT doc_id, count_if(worded)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS clean_md5
FROM every GROUP BY doc_id
) LEFT JOIN longest USING (doc_id)
"""
