"""Hierarchical packing into sequences of several context sizes.

Documents are encoded, ended with one id, and routed by length: whole windows of the
largest tier are cut off, the rest goes to the smallest tier that holds it.  Each tier
is packed with the documents routed to it, one to a sequence, and the gap behind each
is filled exactly from shorter tiers, largest first, the last filler cut.  What is
left without fillers is laid end to end and cut into full sequences, largest tier
first.  All sequences but a last one per group of input partitions are therefore
full, whatever the lengths.  The sequences of a tier are numbered through over all
partitions and dealt to step groups of `step_tokens` tokens each, so all steps cost
the same but for the last of a tier.

Encoding and packing run as one stream over each input partition, so texts are read
and encoded once and never shuffled; a task holds at most `POOL` waiting rests of less
than the largest tier.  The end of each partition, less than the smallest tier, is
packed with those of `NEIGHBOURS` partitions.  Numbers in a tier are a place in the
partition plus the sequences of earlier ones, from a table with a row per partition
and tier.

Encoding caches the ids of white-space-delimited strings per worker: the vocabulary's
rules never look across white space, so a text's ids are those of its strings.

Defined results: a null text counts as empty, and an empty text is its end id alone;
null ids are kept; repeated rows are packed as documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fallow.session import settle, ship_package

VOCABULARY = "word_bpe_49k.json"
END = 1
TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 32768
POOL = 512
NEIGHBOURS = 64
CACHED = 500_000
_encoders: dict[str, CachedEncoder] = {}


class _Known(dict):
    """What was learned, by string; a string that is looked up in vain is learned at once."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, string: bytes) -> bytes:
        found = self[string] = self.learn(string)
        return found


class CachedEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary's rules compose and lower characters, drop white space and cut at letters, digits and
    other characters; its merges then see one piece at a time.  A new string in plain lower-case letters is
    cut here, and only its new pieces go to the merges; any other string goes through the whole tokenizer.
    """

    #: The vocabulary's rule for pieces, for ASCII and for text.
    RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\s{letter}{digit}]+"
    SPACES = frozenset("\x1c\x1d\x1e\x1f\x85\xa0")  # white space to one regex engine and not to another
    PLAIN = "\u0250"  # first character that is left to the tokenizer

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.merges = self.tokenizer.model
        self.known = _Known(self._learn)
        self.spelled = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.ascii = re.compile(self.RULE.format(letter="a-z", digit="0-9").encode())
        self.text = regex.compile(self.RULE.format(letter=r"\p{L}", digit=r"\p{N}"))
        low = [chr(c) for c in range(ord(self.PLAIN)) if chr(c).isalpha() and chr(c).lower() == chr(c) and unicodedata.is_normalized("NFC", chr(c))]
        self.letters = re.compile(f"[{''.join(low)}]+")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}  # bytes as the vocabulary spells them

    def _pieces(self, string: bytes) -> list[bytes] | None:
        if string.isascii():
            return self.ascii.findall(string)
        text = string.decode()
        if max(text) < self.PLAIN and text.lower() == text and unicodedata.is_normalized("NFC", text) and self.SPACES.isdisjoint(text):
            return [p.encode() for p in self.text.findall(text)]
        return None

    def _learn(self, string: bytes) -> bytes:
        if string.isalpha():  # ASCII letters only: one piece, which is spelled as it is
            return self._merged(string.decode())
        if string[:-1].isalpha() and string[-1:].isascii():  # and a last character that is none: two pieces
            return self.known[string[:-1]] + self.known[string[-1:]]
        if not string.isascii() and self.letters.fullmatch(string.decode()):
            return self._merged(string.decode("latin-1").translate(self.shown))
        if (pieces := None if b"<|" in string else self._pieces(string)) is None:
            ids = self.tokenizer.encode(string.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if len(pieces) == 1:
            return self._merged(string.decode("latin-1").translate(self.shown))
        return b"".join([self.known[p] for p in pieces])

    def _merged(self, piece: str) -> bytes:
        spelled = self.spelled
        return b"".join([spelled[t.id] for t in self.merges.tokenize(piece)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED:
            self.known.clear()
        out, find = [], self.known.__getitem__
        for text in texts:
            raw = text.encode()
            # a reserved token is one in its own case only
            strings = raw.lower().split() if b"<|" not in raw else [s if b"<|" in s else s.lower() for s in raw.split()]
            out.append(b"".join(map(find, strings)))
        return out


def encoder(vocabulary: str) -> CachedEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = CachedEncoder(vocabulary)
    return _encoders[vocabulary]


class Packer:
    """Packs a stream of (doc, start, ids) rests into full sequences of the tiers."""

    def __init__(self, tiers=TIERS):
        self.tiers = tiers
        self.rests = {t: deque() for t in tiers}
        self.tokens = dict.fromkeys(tiers, 0)  # waiting, by tier
        self.waiting = 0
        self.done: list[tuple[int, list]] = []  # (tier, pieces) of full sequences

    def tier_of(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if n <= t)

    def _wait(self, piece, front: bool = False) -> None:
        doc, start, ids = piece
        tier = self.tier_of(len(ids))
        self.rests[tier].appendleft(piece) if front else self.rests[tier].append(piece)
        self.tokens[tier] += len(ids)
        self.waiting += 1

    def _take(self, tier: int):
        piece = self.rests[tier].popleft()
        self.tokens[tier] -= len(piece[2])
        self.waiting -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> None:
        top, at = self.tiers[0], 0
        while len(ids) - at >= top:
            self.done.append((top, [(doc, at, ids[at : at + top])]))
            at += top
        if at < len(ids):
            self._wait((doc, at, ids[at:]))
        if self.waiting > POOL:
            self.pack()

    def pack(self) -> None:
        """Pack every tier as long as shorter rests fill its gaps exactly."""
        for i, tier in enumerate(self.tiers):
            below = self.tiers[i + 1 :] or self.tiers[i:]
            while self.rests[tier]:
                lead = self.rests[tier][0]
                gap = tier - len(lead[2])
                if sum(self.tokens[t] for t in below) - (len(lead[2]) if tier in below else 0) < gap:
                    break
                pieces = [self._take(tier)]
                while gap:
                    pieces.append(self._filler(below, gap))
                    gap -= len(pieces[-1][2])
                self.done.append((tier, pieces))
        if self.waiting > POOL // 2:
            self.lay()

    def _filler(self, below, gap: int):
        """The longest waiting rest that fits the gap, else the shortest tier's next, cut."""
        for t in below:
            if self.rests[t] and len(self.rests[t][0][2]) <= gap:
                return self._take(t)
        t = next(t for t in reversed(below) if self.rests[t])
        doc, start, ids = self._take(t)
        self._wait((doc, start + gap, ids[gap:]), front=True)
        return doc, start, ids[:gap]

    def lay(self) -> list:
        """Lay all rests end to end, cut full sequences, return the pieces of the end."""
        pieces = deque(p for t in self.tiers for p in self.rests[t])
        for t in self.tiers:
            self.rests[t].clear()
            self.tokens[t] = 0
        self.waiting = 0
        total = sum(len(p[2]) for p in pieces)
        for tier in self.tiers:
            while total >= tier:
                self.done.append((tier, cut(pieces, tier)))
                total -= tier
        for p in pieces:
            self._wait(p)
        return list(pieces)


def cut(pieces: deque, size: int) -> list:
    """Take exactly `size` ids from the front of `pieces`."""
    out = []
    while size:
        doc, start, ids = pieces.popleft()
        if len(ids) > size:
            pieces.appendleft((doc, start + size, ids[size:]))
            ids = ids[:size]
        out.append((doc, start, ids))
        size -= len(ids)
    return out


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, place long, task long, ids binary"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("place", pa.int64()), ("task", pa.int64()), ("ids", pa.binary()),
])


class _Writer:
    """Rows of finished sequences; ids are unique by the base given and by sequence."""

    def __init__(self, base: int, task: int):
        self.base, self.task = base, task
        self.sequences, self.of_tier, self.rows = 0, dict.fromkeys(TIERS, 0), []

    def write(self, done: list) -> None:
        for tier, pieces in done:
            place, offset = self.of_tier[tier], 0
            self.of_tier[tier] += 1
            for (doc, tokens), start, ids in pieces:
                self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.base + self.sequences, offset, tier, place, self.task, None))
                offset += len(ids)
            self.sequences += 1
        done.clear()

    def leave(self, pieces: list) -> None:
        for (doc, tokens), start, ids in pieces:
            self.rows.append((doc, start, len(ids), None, tokens, None, None, None, None, self.task, ids.tobytes()))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _SCHEMA]
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _pack_partition(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        enc, packer, writer = encoder(vocabulary), Packer(), _Writer(task << 32, task)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part["doc_id"].to_pylist(), enc.encode(part["text"].to_pylist()), strict=True):
                    ids = np.frombuffer(ids + end, "<u4")
                    packer.add((doc, len(ids)), ids)
                writer.write(packer.done)
            yield writer.take()
        packer.pack()
        left = packer.lay()
        writer.write(packer.done)
        writer.leave(left)
        yield writer.take()

    return run


def _pack_ends(table: pa.Table) -> pa.Table:
    group = table["ends"][0].as_py()
    rows = sorted(table.select(["task", "doc_id", "start", "doc_tokens", "ids"]).to_pylist(), key=lambda r: (r["task"], r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids"]))
    packer, writer = Packer(), _Writer((1 << 53) + (group << 32), (1 << 31) + group)
    pieces = deque(((r["doc_id"], r["doc_tokens"]), r["start"], np.frombuffer(r["ids"], "<u4")) for r in rows)
    total = sum(len(p[2]) for p in pieces)
    for tier in TIERS:
        while total >= tier:
            packer.done.append((tier, cut(pieces, tier)))
            total -= tier
    if pieces:
        packer.done.append((TIERS[0], list(pieces)))  # the one sequence that is padded
    writer.write(packer.done)
    return pa.Table.from_batches([writer.take()])


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, step_tokens: int = STEP_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (its sequence's size), step_group."""
    ship_package(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    packed = settle(own.mapInArrow(_pack_partition(vocabulary), OUT))
    ends = packed.where(F.col("sequence_id").isNull()).withColumn("ends", F.floor(F.col("task") / NEIGHBOURS))
    ends = settle(ends.groupBy("ends").applyInArrow(_pack_ends, OUT))
    packed = packed.where(F.col("sequence_id").isNotNull()).unionByName(ends).drop("ids")
    # one row per task and tier; tasks in order number a tier's sequences through
    counts = packed.groupBy("task", "tier").agg((F.max("place") + 1).alias("n"))
    earlier = counts.select("task", "tier", (F.sum("n").over(Window.partitionBy("tier").orderBy("task")) - F.col("n")).alias("earlier"))
    tiers = F.array(*[F.lit(t) for t in TIERS])
    step = F.floor((F.col("earlier") + F.col("place")) * F.col("tier") / step_tokens)
    group = (step * len(TIERS) + F.array_position(tiers, F.col("tier")) - 1).alias("step_group")
    return packed.join(earlier, ["task", "tier"]).select(*[c for c in packed.columns if c not in ("task", "place")], group)
