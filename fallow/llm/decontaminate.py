"""Benchmark decontamination by pigeonhole edit matching.

Text is compared as words: runs of letters, marks and digits of any script, lowered;
in scripts that put no spaces between words each character is a word of its own.
White space, punctuation and symbols are gaps; characters that are not shown, such as
a soft hyphen, count as nothing.  A test item of m words may differ from a passage by `rate * m` word edits
at most.  It is split into one piece more than that budget, so a passage within the
budget holds at least one piece unchanged, in its place up to the budget's shift.
An Aho-Corasick automaton over all pieces finds the exact hits in one pass over a
document, and Myers' bit-parallel distance verifies the words around each hit.

Test items are taken in blocks of bounded size, one pass over the documents per
block, and the next block is sent out only when the pass before it is stored; a
worker builds the automaton of a block once.  Documents are never shuffled and every
word of every text is searched.

Defined results: null and empty texts, of documents or items, match nothing; an
item of fewer than 1 / rate words must occur unchanged; an item that occurs several
times in a document gives one row with the best place, the first of equals; repeated
rows give repeated results; an empty table of either kind gives no match; other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.session import settle, ship_package

RATE = 0.2
BLOCK_BYTES = 32 << 20
_GAPS = bytes(b if chr(b).isalnum() and b < 0x80 else 0x20 for b in range(256))
#: Code points of scripts without spaces between words (Thai, Lao, Burmese, Khmer, Chinese, Japanese).
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)


class _Characters(dict):
    """What each character beyond the known ones stands for: itself, a word of its own, a gap or nothing."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind[0] in "LMN":
            shown = f" {char} " if any(a <= code <= b for a, b in UNSPACED) else char
        else:
            shown = "" if kind == "Cf" else " "
        self[code] = shown
        return shown


_characters = _Characters()


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    if text.isascii():
        return text.lower().encode().translate(_GAPS).split()
    return text.lower().translate(_characters).encode().split()


def pieces_of(m: int, budget: int) -> list[tuple[int, int]]:
    """`budget + 1` even pieces of m words, as (first, end)."""
    n = budget + 1
    return [(m * i // n, m * (i + 1) // n) for i in range(n)]


def myers(pattern: list, text: list) -> list[int]:
    """Least edits between `pattern` and a stretch of `text` ending after each of its words."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | (1 << i)
    up, down, score, out = full, 0, m, []  # vertical differences +1 and -1
    for w in text:
        eq = at.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        score += bool(right & high) - bool(left & high)
        right, left = (right << 1) & full, (left << 1) & full  # a stretch may begin anywhere
        up = left | (full & ~(diagonal | right))
        down = right & diagonal
        out.append(score)
    return out


class Matcher:
    """The pieces of a block of items, ready to search."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, w, int(rate * len(w))) for i, w in ((i, words_of(t)) for i, t in items) if w]
        owners: dict[str, list] = {}
        for n, (_, words, budget) in enumerate(self.items):
            for first, end in pieces_of(len(words), budget):
                owners.setdefault(b" ".join([b"", *words[first:end], b""]).decode(), []).append((n, first))
        self.automaton = ahocorasick.Automaton()
        for piece, of in owners.items():
            self.automaton.add_word(piece, (len(piece), of))
        if owners:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def search(self, text: str | None) -> list[tuple]:
        """(item id, edits, budget, item words, first word, end word) of each item found."""
        words = words_of(text)
        if not words or self.automaton is None:
            return []
        line = b" ".join([b"", *words, b""]).decode()
        checked: dict[int, list] = {}
        counted = place = 0
        best: dict[int, tuple] = {}
        for last, (size, of) in self.automaton.iter(line):
            begin = last - size + 1
            place += line.count(" ", counted, begin) if begin >= counted else -line.count(" ", begin, counted)
            counted = begin
            for n, first in of:
                _, item, budget = self.items[n]
                start = place - first  # where the item would begin without shifts
                done = checked.setdefault(n, [])
                if done and done[-1] <= start <= done[-1] + budget:
                    continue  # inside the window that was verified last
                done.append(start)
                low = max(0, start - budget)
                window = words[low : max(0, start + 2 * budget + len(item))]
                scores = myers(item, window)
                edits = min(scores, default=len(item))
                if edits <= budget and (n not in best or (edits, low) < (best[n][0], best[n][1])):
                    end = low + scores.index(edits) + 1
                    back = myers(item[::-1], words[max(0, end - len(item) - edits) : end][::-1])
                    best[n] = (edits, low, end - back.index(edits) - 1, end)
        return [(self.items[n][0], edits, self.items[n][2], len(self.items[n][1]), first, end) for n, (edits, _, first, end) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The test items in blocks; a hash of the id deals them out."""
    own = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).distinct().orderBy("id", "text").collect()
        yield [(r["id"], r["text"]) for r in rows]


_latest: list = [None, None]


def matcher_of(items: Broadcast, rate: float) -> Matcher:
    """The matcher of a block, built once per worker; a worker keeps that of the latest block."""
    key = (items.value, rate)
    if _latest[0] is None or _latest[0][0] is not key[0] or _latest[0][1] != rate:
        _latest[:] = key, Matcher(items.value, rate)
    return _latest[1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, budget, item_words, first_word, end_word of every item found in a document."""
    spark = docs.sparkSession
    ship_package(spark)
    schema = "doc_id long, item_id long, edits int, budget int, item_words int, first_word int, end_word int"
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found, sent = [], None
    for items in item_blocks(benchmark, "item_id", "text", block_bytes):
        if sent:  # one block at a time is held
            found[-1] = settle(found[-1])
            sent.destroy()
        sent = spark.sparkContext.broadcast(items)
        found.append(own.mapInArrow(_finder(sent, rate), schema))
    return reduce(DataFrame.unionByName, found)


def _finder(items, rate: float):
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
    names = ["doc_id", "item_id", "edits", "budget", "item_words", "first_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(items, rate)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for hit in matcher.search(text)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, in which no item occurs."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = None
    for items in item_blocks(benchmark, "item_id", "text", block_bytes):
        if sent:  # one block at a time is held
            docs = settle(docs)
            sent.destroy()
        sent = spark.sparkContext.broadcast(items)
        docs = docs.mapInArrow(_filter(sent, rate, docs.columns.index(text)), docs.schema)
    return docs


def _filter(items, rate: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(items, rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.search(t) for t in batch.column(column).to_pylist()], pa.bool_()))

    return run
