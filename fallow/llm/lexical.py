"""Ranked lexical search: exact top documents per item, by a hybrid of term-at-a-time and document-at-a-time scoring.

Texts are read once: a map keeps, per document, its length and the frequencies of the
terms that any item asks for.  The number of documents, their total length and the
document frequencies are Spark aggregates over that narrow table.  Scoring is a second
map over it.  A task turns a bounded run of documents into posting lists and, item by
item, adds up the short lists term by term; the sums are from then on one iterator with
one bound, its largest sum.  It and the long lists are then taken document by document:
lists that even together cannot lift a document over the score to beat are left out of
the candidates, and are only searched, by skipping, for candidates that may still win,
largest bound first.  The score to beat rises from run to run of a task.

A task returns at most `k` documents per item; these are ranked within groups of tasks
first and then over all.  No posting list is ever shuffled or gathered.  Items are taken
in blocks of at most `BLOCK_TERMS` terms (or one item), so what a task holds and what is
sent to it does not grow with the tables; each block is one pass.

Scores are exact integers, so runs and their order do not matter.  A term's weight w is
floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 100 - 50 + (50 n N)
div L; its score sums w * ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, once
each.  64-bit integers hold 50 n N up to documents of 10^6 terms among 10^11 others.

Defined results: a null text has no term, and neither has a text of separators; each row
of the items is a query of its own, also if ids repeat or are null; equal scores go by
ascending doc_id, null ids last; documents of score 0 are no result; an empty table, or
items without terms, give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fallow.session import settle, ship_package

BLOCK_TERMS = 1 << 18  # terms of the items of one pass
RUN_POSTINGS = 1 << 20  # postings that a task inverts at a time
RUN_ROWS = 1 << 14
SHORT = 16  # a list is short if it holds at most one in so many documents of a run
NEAR_TASKS = 64  # tasks whose results are ranked together first
#: Separators and capitals as one byte table: what is no ASCII letter or digit becomes a space, capitals become small.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return (text or "").encode().translate(FOLD).split()


def item_blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of (id, distinct terms), read partition by partition."""
    block, held = [], 0
    for row in items.select(F.col(key).alias("id"), F.col(text).alias("text")).toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        if block and held + len(terms) > most:
            yield block
            block, held = [], 0
        if terms:
            block.append((row["id"], terms))
            held += len(terms)
    if block:
        yield block


POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])


def _count_terms(places: dict[bytes, int]):
    """Per document with a term: its length and the frequencies of the terms in `places`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = places.get
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                docs, sizes, found, owner = [], [], [], []
                for doc, text in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    words = terms_of(text)
                    if words:
                        hits = [p for p in map(find, words) if p is not None]
                        docs.append(doc)
                        sizes.append(len(words))
                        found.extend(hits)
                        owner.append(len(hits))
                row = np.repeat(np.arange(len(docs), dtype=np.int64), np.array(owner, np.int64))
                pairs, tf = np.unique(row << 32 | np.array(found, np.int64), return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(docs) + 1, dtype=np.int64) << 32).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32)))  # noqa: E731, B023
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), lists(pairs & 0xFFFFFFFF), lists(tf)], schema=_POSTINGS)

    return run


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, lengths, row of each posting, its term, its frequency) of bounded stretches of a batch."""
    terms, tfs = batch["terms"], batch["tfs"]
    ends = terms.offsets.to_numpy().astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + RUN_POSTINGS, "right")) - 1
        to = min(max(to, at + 1), at + RUN_ROWS, batch.num_rows)
        a, b = int(ends[at]), int(ends[to])
        row = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
        yield batch["doc_id"].slice(at, to - at), batch["n"].slice(at, to - at).to_numpy(), row, terms.values.slice(a, b - a).to_numpy(), tfs.values.slice(a, b - a).to_numpy()
        at = to


def top_of_run(lists: list[tuple[np.ndarray, np.ndarray, int]], rows: int, beat: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of documents that may be among the best `k`, of those that score at least `beat`.

    `lists` holds (ascending rows, scores, largest score) per term.  No document that
    belongs to the best `k` of at least `beat` is missing; all scores are whole.
    """
    short = [x for x in lists if len(x[0]) * SHORT <= rows]
    long = [x for x in lists if len(x[0]) * SHORT > rows]
    if short:  # term at a time
        at, where = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
        sums = np.zeros(len(at), np.int64)
        np.add.at(sums, where, np.concatenate([x[1] for x in short]))
        long.append((at, sums, int(sums.max(initial=0))))
    long.sort(key=lambda x: x[2])
    bounds = np.cumsum([x[2] for x in long])  # most that a document can get from this list and those before it
    need = max(beat, 1)
    lead = int(np.searchsorted(bounds, need))  # lists before `lead` are not enough by themselves
    if lead == len(long):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    dense = np.zeros(rows, np.int64)  # document at a time, for the documents of the leading lists
    for at, scores, _ in long[lead:]:
        dense[at] += scores
    docs = np.flatnonzero(dense)
    score = dense[docs]
    for i in range(lead - 1, -1, -1):
        if len(docs) > k:  # what the best k have already is to be beaten, too
            need = max(need, int(np.partition(score, len(score) - k)[len(score) - k]))
        may = score + bounds[i] >= need
        docs, score = docs[may], score[may]
        at, scores, _ = long[i]
        place = np.minimum(np.searchsorted(at, docs), len(at) - 1)  # skip to each candidate
        score = score + np.where(at[place] == docs, scores[place], 0)
    hit = score >= need
    return docs[hit], score[hit]


RANKED = "item int, doc_id long, score long, task int"
_RANKED = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("task", pa.int32())])


def _score(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)  # by item: (negative scores, ids); a null id is the largest
        last = np.iinfo(np.int64).max
        empty = np.empty(0, np.int64)
        named: list[np.ndarray] = [empty.astype(bool)] * len(items)
        for batch in batches:
            for docs, n, row, term, tf in _runs(batch):
                m = 50 + 50 * n * n_docs // n_terms
                tf = tf.astype(np.int64)
                score = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                order = np.argsort(term, kind="stable")  # rows ascend within a term
                row, score, term = row[order], score[order], term[order]
                present, first = np.unique(term, return_index=True)
                ends = np.append(first, len(term))
                tops = np.maximum.reduceat(score, first) if len(first) else empty
                has = docs.is_valid().to_numpy(zero_copy_only=False)
                ids = docs.fill_null(last).to_numpy()
                for item, asked in enumerate(items):
                    at = np.searchsorted(present, asked)
                    at = at[(at < len(present)) & (present[np.minimum(at, len(present) - 1)] == asked)] if len(present) else at[:0]
                    lists = [(row[ends[i] : ends[i + 1]], score[ends[i] : ends[i + 1]], int(tops[i])) for i in at.tolist()]
                    held, known = best[item]
                    beat = -int(held[-1]) if len(held) == k else 1
                    found, scores = top_of_run(lists, len(n), beat, k) if lists else (empty, empty)
                    if len(found):
                        s, d, h = np.append(held, -scores), np.append(known, ids[found]), np.append(named[item], has[found])
                        order = np.lexsort((d, ~h, s))[:k]
                        best[item], named[item] = (s[order], d[order]), h[order]
        for item, (s, d) in enumerate(best):
            if len(s):
                yield pa.record_batch([pa.array(np.full(len(s), item, np.int32)), pa.array(d, mask=~named[item]), pa.array(-s), pa.array(np.full(len(s), task, np.int32))], schema=_RANKED)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of `items`: its `k` best documents as item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    ship_package(spark)
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = items.schema[item].dataType
    done = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for block in item_blocks(items, item, item_text, BLOCK_TERMS):
        terms = sorted({t for _, own_terms in block for t in own_terms})
        places = {t: i for i, t in enumerate(terms)}
        postings = settle(own.mapInArrow(_count_terms(places), POSTINGS))
        n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(terms), np.int64)  # at most one row per term of the block
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        asked = [np.array([places[t] for t in own_terms], np.int32) for _, own_terms in block]
        found = postings.mapInArrow(_score(asked, weights, n_docs, n_terms, k), RANKED)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        near = Window.partitionBy("item", F.floor(F.col("task") / NEAR_TASKS)).orderBy(*order)
        found = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {kind.simpleString()}")
        done = done.unionByName(settle(found.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    return done
