"""Chat formatting by columnar byte assembly.

A conversation becomes one text: for each turn a header `<|im_start|>ROLE\\n`, the content and a
footer `<|im_end|>\\n`. Inside roles and contents every control string is escaped by a backslash
before it, and every backslash is doubled, so that the text can be read back without loss. The text
of a batch is assembled in numpy: segment lengths, cumulative offsets and scatter indices, copied
into one preallocated Arrow buffer. The loss mask is a list of spans of bytes in that text (end
exclusive), one for each assistant turn.

Defined results: a null text or role is empty; turns stand by turn number, nulls first, ties by role
and text; repeated rows are turns of their own; rows without a conversation id form one conversation
whose id is null; an empty table gives an empty result; further columns are ignored. A conversation
is one row of the output, so it has to fit into one (2 GB).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_buffers, partitions, ship_code

START, END = b"<|im_start|>", b"<|im_end|>"
#: Control strings of common chat templates; none may stand unescaped in a content.
CONTROLS = (START, END, b"<|endoftext|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>")
ESCAPE = 92
ASSISTANT = "assistant"
OUT = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape_bytes(raw: np.ndarray, offsets: np.ndarray, line: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The same strings, a backslash before every backslash and every control string (line: and every line feed)."""
    hit = raw == ESCAPE
    if line:
        hit |= raw == 10
    firsts = {}
    for control in CONTROLS:
        if control[0] not in firsts:
            firsts[control[0]] = np.flatnonzero(raw == control[0])
        at = firsts[control[0]]
        at = at[at + len(control) <= len(raw)]
        for k in range(1, len(control)):
            at = at[raw[at + k] == control[k]]
        # a control string must not reach over into the next string
        row = np.searchsorted(offsets, at, side="right") - 1
        at = at[at + len(control) <= offsets[row + 1]]
        hit[at] = True
    if not hit.any():
        return raw, offsets
    shift = np.cumsum(hit)
    out = np.full(len(raw) + int(shift[-1]), ESCAPE, np.uint8)
    out[np.arange(len(raw)) + shift] = raw
    return out, offsets + np.concatenate([[0], shift])[offsets]


def scatter(out: np.ndarray, raw: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> None:
    """Copy string i of (raw, offsets) to out[to[i]:]."""
    lengths = np.diff(offsets)
    if len(raw):
        out[np.repeat(to - offsets[:-1], lengths) + np.arange(len(raw))] = raw


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Whole conversations, rows in order, as one batch of formatted texts."""
    n = len(conv)
    key = np.asarray(conv.fill_null(0)).astype(np.int64)
    null = np.asarray(conv.is_null())
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(new)
    role_raw, role_at = escape_bytes(*byte_buffers(role), line=True)
    text_raw, text_at = escape_bytes(*byte_buffers(text))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    total = len(START) + role_len + 1 + text_len + len(END) + 1
    at = np.concatenate([[0], np.cumsum(total)])
    buffer = pa.allocate_buffer(int(at[-1]), resizable=False)
    out = np.frombuffer(buffer, np.uint8)
    for k, byte in enumerate(START):
        out[at[:-1] + k] = byte
    scatter(out, role_raw, role_at, at[:-1] + len(START))
    text_to = at[:-1] + len(START) + role_len + 1
    out[text_to - 1] = 10
    scatter(out, text_raw, text_at, text_to)
    for k, byte in enumerate(END + b"\n"):
        out[text_to + text_len + k] = byte
    turns = np.diff(np.concatenate([first, [n]]))
    conv_at = at[np.concatenate([first, [n]])]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(conv_at.astype(np.int64)), buffer).cast(pa.string())
    loss = np.flatnonzero(np.asarray(pc.equal(role, ASSISTANT)))
    origin = np.repeat(conv_at[:-1], turns)
    loss_at = pa.array(np.searchsorted(loss, np.concatenate([first, [n]])).astype(np.int32))
    spans = [pa.ListArray.from_arrays(loss_at, pa.array((x - origin)[loss])) for x in (text_to, text_to + text_len)]
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(turns.astype(np.int64)), formatted, *spans],
        ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"],
    )


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; the last conversation of a slice waits for its other rows."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for part in by_bytes(batches, "text", 4 << 20):
        ids = part.column("conv_id")
        end = ids[part.num_rows - 1].as_py()
        same = pc.fill_null(pc.equal(ids, end), False) if end is not None else ids.is_null()
        tail = int(pc.sum(same).as_py())
        head = part.num_rows - tail
        if waiting and (head or last != end):
            done = waiting + ([part.slice(0, head)] if head else [])
            table = pa.Table.from_batches(done).combine_chunks()
            yield assemble(*(table.column(c).chunk(0) for c in ("conv_id", "role", "text")))
            waiting = []
        elif head:
            yield assemble(*(part.column(c).slice(0, head) for c in ("conv_id", "role", "text")))
        waiting.append(part.slice(head))
        last = end
    if waiting:
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield assemble(*(table.column(c).chunk(0) for c in ("conv_id", "role", "text")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted and the loss mask's spans for every conversation."""
    ship_code(conversations.sparkSession)
    turn = F.col("turn").cast("long").alias("turn")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        turn,
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return (
        rows.repartition(partitions(rows.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(format_batches, OUT)
    )


MARK = re.compile(rb"\\.|<\|im_start\|>|<\|im_end\|>", re.S)
HEADER_END = re.compile(rb"(?:\\.|[^\\\n])*\n", re.S)
UNESCAPE = re.compile(rb"\\(.)", re.S)


def unescape(raw: bytes) -> bytes:
    return UNESCAPE.sub(rb"\1", raw) if b"\\" in raw else raw


def parse(raw: bytes) -> list[tuple[bytes, bytes]]:
    """(role, content) of every turn, unescaped."""
    turns, start = [], 0
    for m in MARK.finditer(raw):
        if m[0] == START:
            start = m.end()
        elif m[0] == END:
            body = raw[start : m.start()]
            cut = HEADER_END.match(body).end()
            turns.append((unescape(body[: cut - 1]), unescape(body[cut:])))
    return turns


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, "formatted", 4 << 20):
        found = []
        columns = [part.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends")]
        for conv, text, starts, ends in zip(*columns):
            raw = text.encode()
            turns = parse(raw)
            loss = "".join(unescape(raw[a:b]).decode() for a, b in zip(starts, ends))
            whole = b"".join(role + b"\n" + content + b"\n" for role, content in turns)
            found.append((conv, len(turns), hashlib.sha256(whole).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of formatted conversations, read from the texts alone, as digests."""
    return formatted.mapInArrow(
        read_batches,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


PROBE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, ASSISTANT, PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(probe)))


def _escaped_sql(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for control in CONTROLS:
        text = f"replace({text}, '{control.decode()}', '\\{control.decode()}')"
    return text


OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), e AS (
  SELECT *, length({_escaped_sql("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_escaped_sql("text")}) + {len(START) + len(END) + 2} AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
