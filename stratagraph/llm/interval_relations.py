"""Relations between the intervals of two tables, counted without making their pairs: offline dominance counting.

A sweep goes over the starts. Fenwick trees over the ranks of the ends hold, for what the sweep has passed,
counts, sums of starts and ends, and sums of checksums. Asked just before an interval's start, just after it and
at its end, for the ranks below its start, below its end and up to its end, they tell how many intervals stand in
each of nine relations to it, in how many slots they meet, and the sum of their checksums. The sweep is offline:
every node of a tree keeps its running sums in order of start, so that all questions of a batch are asked at once.

Both tables are dealt out by their key. The intervals that are asked about come grouped by key, start and end,
and are copied to each part of a key whose questions are many; the questions themselves are never copied. A part
has at least as many questions as the key has groups, so copies are no more than questions.

Sessions of one client never overlap and stand a gap apart, so their groups number at most three a slot: what a
task holds of one client is bounded by the calendar, not by its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stratagraph.llm.common import give_back, wide_batches
from stratagraph.shipping import ship

#: In the order of the contract: the asking interval starts earlier, equally, later; ends earlier, equally, later.
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
#: Rows that a task takes into its trees at a time, beyond the rows of one part of a key.
HELD = 200_000
SCHEMA = "id long, relation string, n_pairs long, overlap_slots long, crc long"


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970 UTC; a timestamp without a zone is read as UTC, whatever the session's zone is."""
    at = F.col(f"`{name}`")
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(at)
    days = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(at)) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


def slot(us: Column, minutes: int) -> Column:
    """Number of the slot since 1970, rounded down for times before it too."""
    width = F.lit(minutes * 60_000_000)
    return F.round((us - F.pmod(us, width)) / width).cast("long")


def sessions(clicks: DataFrame, client: str = "client_id", ts: str = "ts", closing: Column | None = None, gap_minutes: int = 10) -> DataFrame:
    """``client, first, last`` (microseconds), ``open``: runs of a client's clicks without a gap of over ``gap_minutes``.

    Clicks without client or ts are left out, repeats change nothing. A session is open if ``closing`` (default:
    kind is purchase) holds for a click at its last ts; null does not hold.

    Clicks within one stretch as long as the gap belong together, so they are aggregated first: a client has at most
    one row a stretch, however many clicks. Runs are then found within blocks of 144 stretches, and joined from block
    to block by one row a block, so no window holds more than a block's or a calendar's worth of rows.
    """
    width = gap_minutes * 60_000_000
    closing = F.col("kind") == "purchase" if closing is None else closing
    at = clicks.select(F.col(f"`{client}`").alias("client"), micros(clicks, ts).alias("us"), F.coalesce(closing, F.lit(False)).cast("long").alias("closes"))
    at = at.where("client IS NOT NULL AND us IS NOT NULL")
    # the last ts and whether it closes, in one number
    short = at.groupBy("client", slot(F.col("us"), gap_minutes).alias("stretch")).agg(F.min("us").alias("lo"), F.max(F.col("us") * 2 + F.col("closes")).alias("hi"))
    short = short.withColumn("block", F.floor(F.col("stretch") / 144))
    last = lambda c: F.shiftright(c, 1)
    inside = W.partitionBy("client", "block").orderBy("stretch")
    apart = F.col("lo") - last(F.lag("hi").over(inside)) > width
    parts = short.withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("no", F.sum("fresh").over(inside))
    parts = parts.groupBy("client", "block", "no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    blocks = parts.groupBy("client", "block").agg(F.min("lo").alias("first_lo"), F.max("lo").alias("last_lo"), F.max("hi").alias("last_hi"), F.max("no").alias("n"))
    along = W.partitionBy("client").orderBy("block")
    blocks = blocks.withColumn("goes_on", F.coalesce(F.col("first_lo") - last(F.lag("last_hi").over(along)) <= width, F.lit(False)))
    blocks = blocks.withColumn("own", F.when((F.col("n") > 1) | ~F.col("goes_on"), F.col("last_lo")))
    begun = blocks.withColumn("begun", F.last("own", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))).where("goes_on").select("client", "block", F.lit(1).cast("long").alias("no"), "begun")
    whole = parts.join(begun, ["client", "block", "no"], "left").groupBy("client", F.coalesce("begun", "lo").alias("first")).agg(F.max("hi").alias("hi"))
    return whole.select("client", "first", last(F.col("hi")).alias("last"), (F.col("hi").bitwiseAND(1) == 1).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """``id, client, first, last`` (microseconds), ``open`` of every sale with client and sold_at: until it and its lines are shipped.

    A sale is open if a line of it has no shipped_at. Without lines it ends as it starts. Lines are aggregated before
    the join, so a sale of very many lines is one row; lines without sale_id belong to none. Rows of one sale_id
    are sales of their own.
    """
    shipped = lines.where("sale_id IS NOT NULL").groupBy("sale_id").agg(F.max(micros(lines, "shipped_at")).alias("shipped"), F.max(F.col("shipped_at").isNull()).alias("open"))
    own = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("first"))
    return own.join(shipped, "sale_id", "left").select(F.col("sale_id").alias("id"), "client", "first", F.greatest("first", "shipped").alias("last"), F.coalesce("open", F.lit(False)).alias("open"))


def _tree_sums(group: np.ndarray, rank: np.ndarray, weights: np.ndarray, ask_group: np.ndarray, ask_time: np.ndarray, ask_rank: np.ndarray) -> np.ndarray:
    """Sums of the weights of the first ``ask_time`` points with ranks up to ``ask_rank`` in the trees of ``ask_group``.

    Points are in order of the sweep, ranks start at 1 in each group. A point stands in one node at most of
    each level of its Fenwick tree; a question visits one node for each bit of its rank.
    """
    n, out = len(group), np.zeros((len(ask_rank), weights.shape[1]), np.int64)
    most = int(rank.max(initial=0))
    for level in range(most.bit_length()):
        node = ((rank - 1) >> level) + 1
        at = np.flatnonzero(node & 1)
        where = group[at] * (most + 1) + node[at]
        order = np.argsort(where, kind="stable")
        at, where = at[order], where[order]
        sums = np.zeros((len(at) + 1, weights.shape[1]), np.int64)
        np.cumsum(weights[at], axis=0, out=sums[1:])
        key = where * (n + 1) + at
        ask = np.flatnonzero((ask_rank >> level) & 1)
        start = (ask_group[ask] * (most + 1) + (ask_rank[ask] >> level)) * (n + 1)
        out[ask] += sums[np.searchsorted(key, start + ask_time[ask])] - sums[np.searchsorted(key, start)]
    return out


def _answers(group: np.ndarray, asks: np.ndarray, start: np.ndarray, end: np.ndarray, is_open: np.ndarray, n: np.ndarray, crc: np.ndarray) -> dict[str, tuple[np.ndarray, ...]]:
    """For each relation: which of the asking rows have pairs, and their counts, slots (0 where both are open) and checksums. ``group`` ascends."""
    values = np.unique(np.concatenate([start, end[~is_open]]))
    wide = len(values) + 1
    s, e = np.searchsorted(values, start), np.where(is_open, len(values), np.searchsorted(values, end))
    p = np.flatnonzero(~asks)
    p = p[np.argsort(group[p] * wide + s[p], kind="stable")]
    gp, starts, ends = group[p], group[p] * wide + s[p], group[p] * wide + e[p]
    ranks = np.unique(ends)
    rank = np.searchsorted(ranks, ends, "right") - np.searchsorted(ranks, gp * wide)
    weights = np.stack([n[p], n[p] * start[p], n[p] * np.where(is_open[p], 0, end[p]), crc[p]], axis=1)
    total = np.zeros((len(p) + 1, 4), np.int64)
    np.cumsum(weights, axis=0, out=total[1:])

    q = np.flatnonzero(asks)
    g, qs, qe, qo = group[q], start[q], end[q], is_open[q]
    at_s, at_e, base = g * wide + s[q], g * wide + e[q], np.searchsorted(ranks, g * wide)
    head = np.searchsorted(starts, g * wide)
    before, after, over = np.searchsorted(starts, at_s), np.searchsorted(starts, at_s, "right"), np.searchsorted(starts, at_e, "right")
    below_s, below_e, upto_e = np.searchsorted(ranks, at_s) - base, np.searchsorted(ranks, at_e) - base, np.searchsorted(ranks, at_e, "right") - base
    asked = [(before, below_s), (before, below_e), (before, upto_e), (after, below_e), (after, upto_e), (over, below_e), (over, upto_e)]
    sums = _tree_sums(gp, rank, weights, np.tile(g, 7), np.concatenate([t for t, _ in asked]), np.concatenate([r for _, r in asked]))
    before_s, before_lt, before_le, after_lt, after_le, over_lt, over_le = sums.reshape(7, len(q), 4)
    before_all, after_all, over_all = (total[t] - total[head] for t in (before, after, over))
    found = {
        "overlaps": (over_all - over_le) - (after_all - after_le), "finished_by": (over_le - over_lt) - (after_le - after_lt), "contains": over_lt - after_lt,
        "starts": (after_all - after_le) - (before_all - before_le), "equals": (after_le - after_lt) - (before_le - before_lt), "started_by": after_lt - before_lt,
        "during": before_all - before_le, "finishes": before_le - before_lt, "overlapped_by": before_lt - before_s,
    }
    out = {}
    for name in RELATIONS:
        k, sum_start, sum_end, sum_crc = found[name].T
        to = sum_end if name in ("contains", "started_by", "overlapped_by") else k * np.where(qo, 0, qe)
        since = sum_start if name in ("overlaps", "finished_by", "contains") else k * qs
        has = np.flatnonzero(k)
        out[name] = (q[has], k[has], (to - since + k)[has], sum_crc[has])
    return out


def _asked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    col = {c: rows.column(c).to_numpy() for c in ("key", "part", "asks", "first", "n", "crc")}
    is_open = rows.column("last").is_null().to_numpy()
    last = rows.column("last").fill_null(0).to_numpy()
    group = np.zeros(len(is_open), np.int64)
    group[1:] = np.cumsum((np.diff(col["key"]) != 0) | (np.diff(col["part"]) != 0))
    ids = rows.column("id")
    for name, (at, k, slots, crc) in _answers(group, col["asks"].astype(bool), col["first"], last, is_open, col["n"], col["crc"]).items():
        if len(at):
            both_open = is_open[at] if name in ("finished_by", "equals", "finishes") else np.zeros(len(at), bool)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).combine_chunks(), pa.array([name] * len(at)), pa.array(k), pa.array(slots, mask=both_open), pa.array(crc)], names=["id", "relation", "n_pairs", "overlap_slots", "crc"])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and part; parts are swept together until ``HELD`` rows are at hand."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < HELD:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key, part = rows.column("key").to_numpy(), rows.column("part").to_numpy()
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0))
        if len(cut):
            yield from _asked(rows.slice(0, int(cut[-1]) + 1))
            held = rows.slice(int(cut[-1]) + 1).to_batches()
    if held:
        yield from _asked(pa.Table.from_batches(held).combine_chunks())
    give_back()


def relations(asking: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, relation, n_pairs, overlap_slots, crc`` of every asking interval and relation that has pairs.

    ``asking``: ``id, key, first, last``; ``asked``: ``key, first, last, crc``. Key, first and last are whole
    numbers: slots, both ends inclusive; a null ``last`` is an open end, later than all others and equal to other
    open ends. Rows without key or first, and intervals that end before they start, share no slot. ``overlap_slots``
    is null where both are open. Repeated rows count each; ids may repeat and may be null. Extra columns are dropped.
    """
    spark = asking.sparkSession
    whole = "key IS NOT NULL AND first IS NOT NULL AND (last IS NULL OR last >= first)"
    longs = [F.col(c).cast("long").alias(c) for c in ("key", "first", "last")]
    asking = asking.select(F.col("id").cast("long").alias("id"), *longs).where(whole)
    groups = asked.select(*longs, F.col("crc").cast("long").alias("crc")).where(whole).groupBy("key", "first", "last").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    # keys with over a quarter of a partition's share of the questions: at most four a partition
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    counts = asking.groupBy("key").agg(F.count("*").alias("asks"))
    total = counts.agg(F.sum("asks")).first()[0] or 0
    share = max(4096, total // (4 * parts))
    hot = counts.where(F.col("asks") > share).join(groups.groupBy("key").agg(F.count("*").alias("groups")), "key")
    found = hot.select("key", F.ceil(F.col("asks") / F.greatest("groups", F.lit(share))).cast("int").alias("parts")).collect()
    hot = F.broadcast(spark.createDataFrame(found, "key long, parts int"))
    left = asking.join(hot, "key", "left").select("id", "key", F.coalesce(F.pmod(F.xxhash64("id", "first", "last"), F.col("parts")), F.lit(0)).cast("int").alias("part"), F.lit(1).alias("asks"), "first", "last", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("crc"))
    right = groups.join(hot, "key", "left").select(F.lit(None).cast("long").alias("id"), "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("asks"), "first", "last", "n", "crc")
    dealt = left.unionByName(right).repartition("key", "part").sortWithinPartitions("key", "part")
    ship(spark)
    with wide_batches(spark):
        return dealt.mapInArrow(_sweep, SCHEMA)


def sale_session_relations(sales: DataFrame, lines: DataFrame, clicks: DataFrame, slot_minutes: int = 60) -> DataFrame:
    """How each sale's interval relates to the sessions of its client, in slots; the checksum is the CRC-32 of a session's exact first ts."""
    slots = lambda df: [slot(F.col("first"), slot_minutes).alias("first"), F.when(~F.col("open"), slot(F.col("last"), slot_minutes)).alias("last")]
    bought, seen = sale_intervals(sales, lines), sessions(clicks)
    return relations(
        bought.select("id", F.col("client").alias("key"), *slots(bought)),
        seen.select(F.col("client").alias("key"), *slots(seen), F.crc32(F.col("first").cast("string").cast("binary")).alias("crc")),
    )


#: crc32 of a decimal text, bit by bit: a character is xored in, then eight shifts (-1) follow.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0})+1), lambda i: [ord(substr({0}, i, 1))::BIGINT, -1,-1,-1,-1,-1,-1,-1,-1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"

ORACLE_SQL = f"""
WITH c AS (SELECT client_id AS client, epoch_us(ts) AS us, coalesce(kind = 'purchase', false) AS p FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client ORDER BY us) <= 600000000 THEN 0 ELSE 1 END AS fresh FROM c),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM f),
ends AS (SELECT client, no, min(us) AS lo, max(us) AS hi FROM s GROUP BY ALL),
ses AS (SELECT client, min(lo) AS lo, max(hi) AS hi, bool_or(p) AS open FROM (SELECT e.client, e.no, lo, hi, s.p FROM ends e JOIN s ON s.client = e.client AND s.no = e.no AND s.us = e.hi) GROUP BY client, no),
x AS (SELECT client, lo // 3600000000 AS a, CASE WHEN open THEN 9223372036854775807 ELSE hi // 3600000000 END AS b, {_CRC.format("lo::VARCHAR")} AS crc FROM ses),
l AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped, bool_or(shipped_at IS NULL) AS open FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id),
y AS (SELECT v.sale_id, client_id AS client, epoch_us(sold_at) // 3600000000 AS s, CASE WHEN coalesce(open, false) THEN 9223372036854775807 ELSE greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) // 3600000000 END AS e FROM sales v LEFT JOIN l ON l.sale_id = v.sale_id WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
r AS (SELECT y.sale_id, CASE WHEN s < a THEN CASE WHEN e < b THEN 'overlaps' WHEN e = b THEN 'finished_by' ELSE 'contains' END WHEN s = a THEN CASE WHEN e < b THEN 'starts' WHEN e = b THEN 'equals' ELSE 'started_by' END ELSE CASE WHEN e < b THEN 'during' WHEN e = b THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
  CASE WHEN least(e, b) < 9223372036854775807 THEN least(e, b) - greatest(s, a) + 1 END AS slots, crc FROM y JOIN x ON x.client = y.client AND a <= e AND s <= b)
SELECT sale_id, relation, count(*)::BIGINT AS n_pairs, sum(slots)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM r GROUP BY sale_id, relation
"""
