"""Chat formatting by token-level assembly.

Every turn becomes  <turn> role <says> text </turn>, where role and text are encoded
apart from each other with a byte-level vocabulary and the control strings are
reserved ids spliced in between, beyond the vocabulary.  Text is encoded as ordinary
text, so content can never produce a reserved id.  In the readable form a content
backslash or control string gets a backslash before it; that is undone on reading.
The loss mask covers the text tokens of assistant turns: +1 where one begins, -1
where it ends, summed along the tokens.

Turns are encoded row by row, wherever the rows lie.  Rows then meet by conversation,
sorted by turn, and are assembled as a stream: a conversation is written as chunks
of at most `CHUNK` tokens, so that one with very many turns needs no more memory than
its longest turn.

Defined results: null text and null role are empty; turns are ordered by turn (null
first), then role, then text, and repeated rows are repeated turns; rows with a null
conversation id form one conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallow.session import ship_package

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Reserved ids follow the vocabulary's in this order.
CONTROLS = ("<turn>", "<says>", "</turn>")
LEARNED = "assistant"
CHUNK = 65536
_CONTENT = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_encodings: dict[str, object] = {}


def escape(text: str) -> str:
    return _CONTENT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def encoding(vocabulary: str):
    """The vocabulary at a path or, by name, of the public tokenizers; loaded once per worker."""
    if vocabulary not in _encodings:
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        _encodings[vocabulary] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def reserved(vocabulary: str) -> dict[str, int]:
    first = max(encoding(vocabulary)._mergeable_ranks.values()) + 1
    return {c: first + i for i, c in enumerate(CONTROLS)}


def _turn_encoder(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ids = encoding(vocabulary), reserved(vocabulary)
        for batch in batches:
            tokens, begins, ends = [], [], []
            for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                head = [ids["<turn>"], *enc.encode_ordinary(escape(role)), ids["<says>"]]
                body = enc.encode_ordinary(escape(text))
                tokens.append([*head, *body, ids["</turn>"]])
                begins.append(len(head) if role == LEARNED else 0)
                ends.append(len(head) + len(body) if role == LEARNED else 0)
            yield pa.record_batch(
                [batch["conv_id"], batch["turn"], batch["role"], batch["text"], pa.array(tokens, pa.list_(pa.int32())), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())],
                names=["conv_id", "turn", "role", "text", "tokens", "begin", "end"],
            )

    return run


def _assembler():
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"conv": None, "open": False, "chunk": 0}
        held: list[np.ndarray] = []
        masks: list[np.ndarray] = []

        def flush(last: bool) -> pa.RecordBatch:
            ids, mask = np.concatenate(held), np.concatenate(masks)
            row = pa.record_batch([[state["conv"]], [state["chunk"]], [last], pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))], schema=schema)
            state["chunk"] += 1
            held.clear(), masks.clear()
            return row

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "begin", "end")]
            for i, (conv, begin, end) in enumerate(zip(*columns, strict=True)):
                if state["open"] and conv != state["conv"]:
                    yield flush(True)
                    state["open"] = False
                if not state["open"]:
                    state.update(conv=conv, open=True, chunk=0)
                tokens = batch["tokens"][i].values.to_numpy()
                edges = np.zeros(len(tokens) + 1, np.int8)
                edges[begin] += 1
                edges[end] -= 1
                mask = np.cumsum(edges[:-1], dtype=np.int8)
                for at in range(0, len(tokens), CHUNK):
                    if sum(map(len, held)) + len(tokens[at : at + CHUNK]) > CHUNK:
                        yield flush(False)
                    held.append(tokens[at : at + CHUNK])
                    masks.append(mask[at : at + CHUNK])
        if state["open"]:
            yield flush(True)

    return run


def format_chats(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token sequences: conv_id, chunk (from 0), last, input_ids and loss_mask, in any order of rows."""
    ship_package(conversations.sparkSession)
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = own.mapInArrow(_turn_encoder(vocabulary), "conv_id long, turn long, role string, text string, tokens array<int>, begin int, end int")
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "tokens", "begin", "end")
    return dealt.mapInArrow(_assembler(), "conv_id long, chunk long, last boolean, input_ids array<int>, loss_mask array<byte>")


def _reader(vocabulary: str):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ids = encoding(vocabulary), reserved(vocabulary)
        turn_id, says_id, close_id = (ids[c] for c in CONTROLS)
        fresh = lambda: {"turns": 0, "hash": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0, "part": [], "mask": []}
        s = fresh()

        def close_part() -> None:
            """A role or a text has ended: its tokens, decoded and unescaped."""
            whole, mask = np.concatenate(s["part"] or [np.zeros(0, np.int32)]), np.concatenate(s["mask"] or [np.zeros(0, np.int8)])
            shown = enc.decode_bytes(whole.tolist()).decode()
            text = unescape(shown)
            s["hash"].update((text + "\n").encode())
            s["chars"] += len(shown)
            if mask.any():  # text under the mask, unescaped
                learned = unescape(enc.decode_bytes(whole[mask == 1].tolist()).decode())
                s["loss"].update(learned.encode())
                s["loss_chars"] += len(learned)
            s["part"], s["mask"] = [], []

        conv, chunk = None, 0  # of an open conversation, and the chunk that must follow
        for batch in batches:
            for i in range(batch.num_rows):
                now = (batch["conv_id"][i].as_py(), batch["chunk"][i].as_py())
                if now != (conv if chunk else now[0], chunk):
                    raise ValueError(f"conversation {now[0]}: chunk {now[1]} where chunk {chunk} of conversation {conv if chunk else now[0]} must follow")
                conv, chunk = now[0], 0 if batch["last"][i].as_py() else chunk + 1
                tokens = batch["input_ids"][i].values.to_numpy()
                mask = batch["loss_mask"][i].values.to_numpy()
                s["tokens"] += len(tokens)
                at = 0
                for stop in [*np.flatnonzero(tokens >= turn_id).tolist(), len(tokens)]:
                    if stop > at:
                        s["part"].append(tokens[at:stop])
                        s["mask"].append(mask[at:stop])
                    if stop < len(tokens):
                        s["chars"] += len(CONTROLS[tokens[stop] - turn_id])
                        if tokens[stop] == says_id:
                            close_part()
                        elif tokens[stop] == close_id:
                            close_part()
                            s["turns"] += 1
                    at = stop + 1
                if batch["last"][i].as_py():
                    yield pa.record_batch([[batch["conv_id"][i].as_py()], [s["turns"]], [s["hash"].hexdigest()], [s["loss_chars"]], [s["loss"].hexdigest()], [s["chars"]], [s["tokens"]]], schema=schema)
                    s = fresh()
        if chunk:
            raise ValueError(f"conversation {conv} ends without its last chunk; chunk {chunk} must follow")

    return run


def read_chats(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Read `format_chats` output back: per conversation its turns, learned text and readable length, as digests.

    turns_sha256 is over role, newline, text, newline per turn; loss_sha256 over the text under the loss mask.
    Chunks are brought together and into order first, so stored output may lie in any files and order; a
    chunk that is missing or there twice is an error.
    """
    ship_package(formatted.sparkSession)
    ordered = formatted.select("conv_id", "chunk", "last", "input_ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.mapInArrow(_reader(vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
