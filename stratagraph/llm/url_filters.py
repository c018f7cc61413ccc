"""URL filtering by explicit host and path rules, then by association rules mined from labelled URLs.

Everything here is DataFrame, SQL or JVM machine-learning code: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label:bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: runs of letters and digits, lower-cased, numbers left out."""
    parts = F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^\\p{L}\\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: ~t.rlike("^[0-9]*$"))))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_count: int = 8, min_confidence: float = 0.6) -> DataFrame:
    """Token combinations that imply a bad label.

    ``labelled`` has ``tokens`` and ``bad``. FP-growth keeps combinations with at least
    ``min_support`` of the rows and ``min_count`` rows; of the rules towards the label, those with
    ``min_confidence``. A rule is dropped if a part of it is a rule already. The driver only sees the
    frequent single tokens, of which there are at most (tokens of a url) / ``min_support``.

    Returns ``rule_id, rule_tokens, key`` where key is the rule's rarest token.
    """
    n = labelled.count()
    empty = labelled.select(F.lit(0).cast("long").alias("rule_id"), F.col("tokens").alias("rule_tokens"), F.lit("").alias("key")).where("false")
    if n == 0:
        return empty
    rows = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(rows)
    found = model.associationRules.where(F.element_at("consequent", 1) == BAD).select(F.array_sort("antecedent").alias("rule_tokens"), "support")
    found = found.where(~F.array_contains("rule_tokens", BAD)).withColumn("rule_id", F.xxhash64(F.concat_ws(" ", "rule_tokens")))
    freq = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    posted = found.select("rule_id", "rule_tokens", F.explode("rule_tokens").alias("token")).join(freq, "token")
    keyed = posted.groupBy("rule_id", "rule_tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    # a rule falls if another one, posted under one of its tokens, is part of it
    smaller = keyed.select(F.col("key").alias("token"), F.col("rule_tokens").alias("part"))
    larger = posted.join(smaller, "token").where((F.size("part") < F.size("rule_tokens")) & (F.size(F.array_except("part", "rule_tokens")) == 0))
    return keyed.join(larger.select("rule_id").distinct(), "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame, key_col: str) -> DataFrame:
    """Ids of rows whose tokens hold all tokens of some rule; an inverted index finds a rule by its rarest token.

    Only tokens that are some rule's key are posted. Keys are among the frequent tokens that mining
    has bounded, so the driver may hold them.
    """
    keys = sorted(r["key"] for r in rules.select("key").distinct().collect())
    held = F.array_intersect("tokens", F.array(*map(F.lit, keys)).cast("array<string>"))
    posted = urls.select(key_col, "tokens", F.explode(held).alias("key"))
    hits = posted.join(rules, "key").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return hits.select(key_col).distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules=RULES, **mining) -> DataFrame:
    """Judge every url: the longest fitting rule decides, else the mined rules.

    A page is labelled by the row of ``labels`` with its id: bad if its quality is 0 or it is toxic;
    of several rows, one bad row makes it bad. Labels with null ids or null values are not used.
    Null and malformed urls have an empty host and path, fit no rule and are matched by their tokens
    alone (null: none, allowed). Rows of ``pages`` that repeat stay as they are; extra columns of
    either table are ignored. An empty table of labels leaves only the explicit rules.

    Returns ``id_col, host, path, rule, verdict``.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.where(F.col(label_id).isNotNull() & bad.isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(bad).alias("bad"))
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    labelled = judged.select("_id", url_tokens(F.col("url")).alias("tokens")).join(marks, "_id").select("tokens", "bad")
    mined = mine_rules(labelled, **mining)
    distinct = judged.where(F.col("url").isNotNull()).select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    blocked = matched(distinct, mined, "url").withColumn("_hit", F.lit(True))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = judged.join(blocked, "url", "left")
    return out.select(
        F.col("_id").alias(id_col), "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_hit"), "block").otherwise("allow")).alias("verdict"),
    )
