"""Filter interaction audit: what every order of a set of filters removes, step by step.

A document's failures are one bit mask, so a corpus is a small table of mask cells: per
part and mask, the number of documents, and how many of them are good or toxic.  Orders
are enumerated by a recursive CTE over these masks: each level extends every filter
prefix with each unused letter, joins the mask cells and carries the bits applied so
far, and emits for each cell what that step does to it.  Weighing the emitted rows with
the counts of the cells gives the metrics; nothing is read per order.

Texts are read once and become narrow rows (id, digest, part, mask).  Repeats of an
earlier text are found by digest: copies are counted by partial aggregation, only the
smallest id of a text and its rows are kept apart, so a text that a third of all rows
share is no larger a task than any other.  The recursion has at most 2^k masks x the
number of prefixes as rows, for k filters, whatever the size of the table.

Defined results: a null text counts as empty; a null part is the empty string; a row
without id has no smaller id, repeats nothing, makes nothing a repeat and has no label;
rows with the same id and text repeat one another only if a smaller id has that text;
several labels of an id count as one, if any of them says so; an empty table has no part
and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallow.session import settle

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
REPEAT = "E"


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions by letter, for those that a text alone decides; `text` is not null."""
    words = F.array_remove(F.split(text, WORD_GAP, -1), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, fails=conditions, repeat: str = REPEAT, key: str = "doc_id", text: str = "text", part: str = "lang") -> tuple[DataFrame, str]:
    """(cells, letters): per part and mask the number of documents `n`, of good ones `good` and of toxic ones `toxic`.

    Bit i of a mask belongs to letter i; `repeat` is the letter of texts that a smaller id has too.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    by_letter = fails(F.col("whole"))
    letters = "".join(by_letter) + repeat
    mask = reduce(add, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(by_letter.values())])
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("whole"))
    own = own.select("id", "part", F.unhex(F.sha2("whole", 256)).alias("digest"), mask.alias("mask"))
    rows = settle(own.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")))

    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(said("quality"), said("toxic"))
    known = rows.where("id is not null").join(marks, "id", "left").na.fill(0, ["quality", "toxic"])
    # the smallest id of each text, with its number of rows; counts of the rest by partial aggregation
    texts = known.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("fresh", F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))
    again = F.col("mask").bitwiseOR(F.lit(1 << len(by_letter)))
    both = F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct(again.alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    split = texts.select("part", "quality", "toxic", both.alias("c")).select("part", "c.mask", "c.n", "quality", "toxic").where("n > 0")
    nameless = rows.where("id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("quality"), F.lit(0).cast("long").alias("toxic"))
    weigh = lambda c: F.sum(F.col(c) * F.col("n"))
    cells = split.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), weigh("quality").alias("good"), weigh("toxic").alias("toxic"))
    return cells, letters


#: One row per prefix and mask cell: what the prefix's last letter does to documents with that mask.
WALK = """
with recursive walk(prefix, step, mask, before, bit) as (
    select cast('' as string), 0, mask, 0, 0 from {masks}
    union all
    select concat(prefix, substr('{letters:s}', place + 1, 1)), step + 1, mask, before | bit, shiftleft(1, place)
    from (
        select *, explode(filter(sequence(0, {last:d}), i -> ((before | bit) & shiftleft(1, i)) = 0)) as place
        from walk where step <= {last:d}
    )
)
select prefix, step, mask,
    cast((mask & (before | bit)) = 0 as int) as kept,
    cast((mask & bit) != 0 and (mask & before) = 0 as int) as removed,
    cast((mask & bit) != 0 and (mask & before) != 0 as int) as redundant,
    cast(mask = bit as int) as only_here
from walk where step > 0
"""


def walk_orders(cells: DataFrame, letters: str) -> DataFrame:
    """The recursion over the masks that occur."""
    masks = settle(cells.select("mask").distinct())
    query = WALK.replace("{letters:s}", letters).replace("{last:d}", str(len(letters) - 1))
    return settle(cells.sparkSession.sql(query, masks=masks))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """Per part, order of all letters and step: the metrics of that step (see the module)."""
    cells = settle(cells)
    walk = walk_orders(cells, letters)
    count = lambda flag, of, name: F.sum(F.col(flag) * F.col(of)).alias(name)
    metrics = cells.join(walk, "mask").groupBy("part", "prefix").agg(
        count("kept", "n", "kept"), count("removed", "n", "removed"), count("redundant", "n", "redundant"),
        count("only_here", "n", "unique_fails"), count("removed", "good", "good_lost"), count("removed", "toxic", "toxic_lost"),
    )
    orders = walk.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    steps = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    steps = steps.withColumn("prefix", F.expr("substr(filter_order, 1, step)"))
    own = Window.partitionBy("part", F.substring("prefix", -1, 1))
    return metrics.join(steps, "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(own).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of this module over whole texts."""
    return audit(*mask_cells(docs, labels))
