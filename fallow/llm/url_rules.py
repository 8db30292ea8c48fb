"""URL filter: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

A rule is (verdict, host, path).  It fits a url whose host is the rule's host or a
subdomain of it and whose path starts with the rule's path; the longest rule wins.

Each url is expanded into the expressions that could equal a rule: the suffixes of
its host with as many labels, and the prefixes of its path with as many characters,
as some rule has.  Rules are grouped by the first hex digits of their digest, and
expressions meet these groups in an equi-join on those digits alone; the full digest
then picks the rules of the group that fit.  A group holds the rules that share a
short prefix, so its size is that of a hash collision.  Expressions are looked up
once per distinct (host, path), so that a url or host with a third of all rows costs
no more than any other; the rule side is an ordinary join side that Spark broadcasts
only under its own size threshold.  Rows are stored once with one of `SLOTS` slots in
turn, and verdicts go back to them by (host, path, slot), so that the rows of one hot
url are dealt over that many tasks.

Defined results: a url that is null or has no ``://`` has empty host and path; a
url that no rule fits gets a null rule and the default verdict; repeated rows are
judged alike; an empty rule table leaves every url to the default; other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallow.session import settle

SLOTS = 1024  # parts of one url's rows in the join back
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lowered) and path of a url, both empty without ``://``."""
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    """Full digest of an expression; the length keeps host and path apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def labels(host: Column) -> Column:
    return F.size(F.split(host, "[.]", -1))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", digits: int = 8) -> DataFrame:
    """Per row of ``pages``: key, host, path, rule (host and path of the winner) and verdict."""
    host, path = host_and_path(F.col("__url"))
    slot = F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)).cast("int")
    parsed = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url")).select("__key", host.alias("host"), path.alias("path"), slot.alias("slot"))
    parsed = settle(parsed)

    full = digest(F.col("host"), F.col("path"))
    listed = rules.select("verdict", "host", "path").distinct()
    listed = listed.select(
        full.alias("rule_digest"),
        F.substring(full, 1, digits).alias("short"),
        F.struct(
            (F.length("host") + F.length("path")).alias("chars"),
            F.length("host").alias("host_chars"),
            (F.col("verdict") == "block").alias("blocks"),  # of equal rules with two verdicts, block wins
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
        ).alias("winner"),
        labels(F.col("host")).alias("n_labels"),
        F.length("path").alias("n_chars"),
    )
    # one row: the (labels, path characters) that occur among rules, bounded by their lengths
    shapes = listed.agg(F.sort_array(F.collect_set(F.struct("n_labels", "n_chars")))).first()[0]
    pairs = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(c).alias("chars")) for n, c in shapes]) if shapes else F.lit(None).cast("array<struct<labels:int,chars:int>>")

    seen = parsed.select("host", "path").distinct()
    asked = seen.select("host", "path", F.explode(pairs).alias("s")).where(
        (labels(F.col("host")) >= F.col("s.labels")) & (F.length("path") >= F.col("s.chars"))
    )
    asked = asked.select("host", "path", digest(F.expr("substring_index(host, '.', -s.labels)"), F.expr("substring(path, 1, s.chars)")).alias("asked"))
    sharing = listed.groupBy("short").agg(F.collect_list(F.struct("rule_digest", "winner")).alias("sharing"))
    met = asked.withColumn("short", F.substring("asked", 1, digits)).join(sharing, "short")
    confirmed = F.filter("sharing", lambda rule: rule["rule_digest"] == F.col("asked"))
    winner = F.array_max(F.transform(confirmed, lambda rule: rule["winner"]))
    best = met.groupBy("host", "path").agg(F.max(winner).alias("winner"))
    dealt = parsed.select("host", "path", "slot").distinct().join(best, ["host", "path"])
    return parsed.join(dealt, ["host", "path", "slot"], "left").select(
        F.col("__key").alias(key),
        "host",
        "path",
        F.col("winner.rule").alias("rule"),
        F.coalesce("winner.verdict", F.lit(default)).alias("verdict"),
    )
