"""Secret scan over a ledger of content-addressed blobs.

Every version of a file is addressed by the SHA-256 of its text.  A ledger in the
shared folder records which (blob, rule version) pairs were scanned and what was
found.  A run scans only pairs the ledger has not seen, appends them, and joins
the findings back to every path that holds the blob: a text copied a million
times is scanned once, a new rule version rescans blobs for that rule alone.

Spans are code point offsets, the end exclusive, of the leftmost non-overlapping
matches of a rule's pattern.  A rule may ask for a least length of a group;
shorter matches are dropped after matching, since they use up text.  Start offsets
are running sums over the pieces between matches and the matches themselves, taken
in blocks of as many matches as there are blocks, so that n matches cost n^1.5 steps
and not n^2; redaction cuts the text by blocks of gaps in the same way.

Rows are stored once with their digest and one of `SLOTS` slots in turn.  Findings
go to the (blob, slot) pairs that occur and from there to the rows, so the rows of
one blob, however many, are dealt over that many tasks.

Defined results: a null text is scanned as an empty one and has no span; repeated
rows get the same findings; an empty table gives an empty result; other columns are
ignored.  An append that was cut short may leave a pair in the ledger twice: reading
takes each span once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fallow.session import settle

SLOTS = 1024  # parts of one blob's rows in the join back

# Kinds of the contract first, in its order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int = 0  # the group that must have at least `least` characters
    least: int = 1
    needs: str = ""  # a literal that every match contains

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", 1, ASSIGN, group=2, least=12),
    Rule("access", 1, "AKIA[A-Z0-9]+", least=18, needs="AKIA"),
    Rule("hex", 1, "[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("chat", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
)

SPAN = "struct<start:int,rank:int,kind:string,end:int,version:int>"
LEDGER = f"blob string, pairs array<string>, spans array<{SPAN}>"
NONE = f"cast(array() as array<{SPAN}>)"


def let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def in_blocks(items: Column, of_block) -> Column:
    """`of_block(first, last)` of blocks of places of `items`, of about as many places as there are blocks; null items give none."""
    last = F.size(items) - 1
    width = F.ceil(F.sqrt(F.size(items))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last, F.greatest(width, F.lit(1))), lambda at: of_block(at, F.least(at + width - 1, last)))
    return F.when(F.size(items) > 0, blocks)


def running(totals: Column, join, start: Column) -> Column:
    """What `join` makes of `start` and all earlier items, for each item and after the last."""

    def add(state, x):
        now = join(state["at"], x)
        return F.struct(now.alias("at"), F.concat(state["out"], F.array(now)).alias("out"))

    return F.aggregate(totals, F.struct(start.alias("at"), F.array(start).alias("out")), add, lambda s: s["out"])


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule; `rank` orders kinds that start at one place."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length),
    ).cast("array<struct<gap:int,size:int,part:int>>")

    def add(state, x):
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["size"]).alias("end"), F.lit(rule.version).alias("version"))
        hit = x["size"].isNotNull() & (x["part"] >= rule.least)  # the last gap has no match after it
        return F.struct(
            (start + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(hit, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    def placed(f):
        chars = in_blocks(f, lambda lo, hi: F.aggregate(F.sequence(lo, hi), F.lit(0), lambda n, i: n + f[i]["gap"] + F.coalesce(f[i]["size"], F.lit(0))))
        zero = lambda at: F.struct(at.alias("at"), F.expr(NONE).alias("out"))
        spans = lambda blocks, starts: F.transform(
            blocks, lambda b, k: F.aggregate(F.sequence(b["lo"], b["hi"]), zero(starts[k]), lambda state, i: add(state, f[i]), lambda state: state["out"])
        )
        ends = in_blocks(f, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
        return F.flatten(let(running(chars, lambda x, y: x + y, F.lit(0)), lambda starts: spans(ends, starts)))

    any_match = text.rlike(rule.pattern)
    if rule.needs:
        any_match = text.contains(rule.needs) & any_match
    return F.when(any_match, let(found, placed)).otherwise(F.expr(NONE))


def stored(rows: DataFrame, text: str, **columns: Column) -> DataFrame:
    """`columns` of all rows, with the digest of the text (null: empty) as `blob` and a slot, written once."""
    slot = F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)).cast("int")
    return settle(rows.select(*[c.alias(name) for name, c in columns.items()], address(text).alias("blob"), slot.alias("slot")), "zstd")


def address(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def with_findings(rows: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Stored rows (with blob and slot) and the spans of their blob, joined by (blob, slot)."""
    known = findings(rows.sparkSession, ledger, rules)
    dealt = rows.select("blob", "slot").distinct().join(known, "blob")
    return rows.join(dealt, ["blob", "slot"], "left").withColumn("spans", F.coalesce("spans", F.expr(NONE)))


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """Scan what `ledger` (a folder all executors reach) has not seen; return path, blob and spans of every version.

    Spans are sorted by start, then by the rule's place in `rules`.
    """
    scan_unseen(versions, ledger, rules, text)
    own = stored(versions, text, path=F.col(path))
    return with_findings(own, ledger, rules).select(F.col("path").alias(path), "blob", "spans")


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Scan the (blob, rule version) pairs that the ledger lacks and append them."""
    _scan(versions.select(address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")), ledger, rules)


def _scan(own: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> None:
    """Scan rows of (blob, text)."""
    spark = own.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)  # an empty ledger on first use
    wanted = F.array(*[F.lit(r.pair) for r in rules])
    seen = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("seen"))
    unseen = (
        own.groupBy("blob").agg(F.first("text").alias("text"))
        .join(seen, "blob", "left")
        .withColumn("pairs", F.array_except(wanted, F.coalesce("seen", F.expr("cast(array() as array<string>)"))))
        .where(F.size("pairs") > 0)
    )
    spans = F.concat(*[
        F.when(F.array_contains("pairs", r.pair), spans_of(F.col("text"), r, i)).otherwise(F.expr(NONE)) for i, r in enumerate(rules)
    ])
    unseen.select("blob", "pairs", spans.alias("spans")).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its spans of the kinds and versions in `rules`, for blobs that have any."""
    given = F.array(*[F.lit(r.pair) for r in rules])

    def wanted(s):
        """Spans of a ledger without versions are of a version in `pairs`."""
        own = F.exists("pairs", lambda p: F.array_contains(given, p) & F.startswith(p, F.concat(s["kind"], F.lit("@"))))
        return F.coalesce(F.array_contains(given, F.concat(s["kind"], F.lit("@"), s["version"])), own)

    known = spark.read.schema(LEDGER).parquet(ledger).withColumn("spans", F.filter("spans", wanted)).where(F.size("spans") > 0)
    every = F.array_sort(F.flatten(F.collect_list("spans")))
    return known.groupBy("blob").agg(every.alias("spans")).withColumn("spans", each_once("spans"))


def each_once(spans: str) -> Column:
    """The distinct spans of a sorted array."""
    return let(F.col(spans), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def spans_text(spans: Column) -> Column:
    """`kind:start:end`, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span, or stretch of overlapping spans, replaced by a mark; `spans` sorted by start.

    What stays are the gaps between the largest end so far and a start at or behind it.
    """
    gaps_of = "array<struct<lo:int,hi:int>>"

    def add(state, s):
        fresh = s["start"] >= state["at"]
        gap = F.struct(state["at"].alias("lo"), s["start"].alias("hi"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], F.array(gap))).otherwise(state["out"]).alias("out"))

    def gaps(s, size):
        ends = in_blocks(s, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
        furthest = in_blocks(s, lambda lo, hi: F.aggregate(F.sequence(lo, hi), F.lit(0), lambda n, i: F.greatest(n, s[i]["end"])))

        def between(starts):
            zero = lambda at: F.struct(at.alias("at"), F.expr(f"cast(array() as {gaps_of})").alias("out"))
            each = F.transform(ends, lambda b, k: F.aggregate(F.sequence(b["lo"], b["hi"]), zero(starts[k]), lambda state, i: add(state, s[i]), lambda state: state["out"]))
            return F.concat(F.flatten(each), F.array(F.struct(F.element_at(starts, -1).alias("lo"), size.alias("hi"))))

        return let(running(furthest, F.greatest, F.lit(0)), between)

    def kept(t, g):
        """The gaps' texts with marks between them: a block's stretch is cut out once, its gaps out of that."""

        def block(lo, hi):
            first = g[lo]["lo"]
            stretch = F.substring(t, first + 1, g[hi]["hi"] - first)
            cut = lambda part: F.transform(F.slice(g, lo + 1, hi - lo + 1), lambda x: F.substring(part, x["lo"] - first + 1, x["hi"] - x["lo"]))
            return F.array_join(let(stretch, cut), mark)

        return F.array_join(in_blocks(g, block), mark)

    done = let(text, lambda t: let(spans, lambda s: let(gaps(s, F.length(t)), lambda g: kept(t, g))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def without_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text", size: str = "n_chars") -> DataFrame:
    """`docs`, with all their columns, with spans redacted and the column `size` brought up to date in changed rows."""
    rows = stored(docs, text, doc=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    given = {c: F.col(f"doc.`{c}`") for c in docs.columns}
    _scan(rows.select("blob", F.coalesce(given[text], F.lit("")).alias("text")), ledger, rules)
    marked = with_findings(rows, ledger, rules).withColumn("changed", redact(given[text], F.col("spans")))
    new = {text: F.col("changed")}
    if size in docs.columns:
        new[size] = F.when(F.size("spans") > 0, F.length("changed").cast(docs.schema[size].dataType)).otherwise(given[size])
    return marked.select(*[new.get(c, given[c]).alias(c) for c in docs.columns])
