"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles the start of
anything that looks like a control string is escaped reversibly: every ``<`` followed by
one or more ``|`` gets one ``|`` more, so ``<|`` with exactly one bar occurs in control
strings only. In a role, ``\\`` and line feeds are written as ``\\\\`` and ``\\n`` first.

A batch of turns is assembled at once. Its five segments a turn (header, escaped role, line
feed, escaped text, footer) lie in one source buffer; their lengths and starts are numpy
arrays, cumulative sums of the lengths give the places, and one gather with scatter
indices copies all of them into a preallocated output buffer that becomes the Arrow
column. A conversation's offset is the place of its first turn, so turns are joined
without touching their bytes. The loss mask is the byte range of each assistant text.

Rows are dealt by conversation and sorted by turn inside a partition, so no group is
gathered but the conversation that is being put together, whose length is that of its
output row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Bytes of text that are assembled at once; the index arrays are eight times as large.
BLOCK_BYTES = 4 << 20
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(rb"<\|(\|+)")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\|+)", r"<|\1")


def escape_roles(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1", raw)


def unescape_role(raw: bytes) -> bytes:
    return re.sub(rb"\\(n|\\)", lambda m: b"\n" if m[1] == b"n" else b"\\", unescape(raw))


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, offsets, text_starts)`` of the formatted turns: one buffer, the n + 1 places
    of the turns in it, and the place of each turn's text."""
    parts, starts, lengths, base = [], [], [], 0
    n = len(texts)
    for column in (roles, texts):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        parts.append(data)
        starts.append(offsets[:-1] - offsets[0] + base)
        lengths.append(np.diff(offsets))
        base += len(data)
    fixed = np.frombuffer(START + b"\n" + END, dtype=np.uint8)
    source = np.concatenate([*parts, fixed])
    whole = lambda at, size: (np.full(n, base + at), np.full(n, size))
    header, feed, footer = whole(0, len(START)), whole(len(START), 1), whole(len(START) + 1, len(END))
    segment_starts = np.stack([header[0], starts[0], feed[0], starts[1], footer[0]], 1).ravel()
    segment_lengths = np.stack([header[1], lengths[0], feed[1], lengths[1], footer[1]], 1).ravel()
    places = np.concatenate([[0], np.cumsum(segment_lengths)])
    out = np.empty(places[-1], dtype=np.uint8)
    first = 0
    while first < len(segment_lengths):  # whole turns, so that the index arrays stay small
        last = max(first + 5, int(np.searchsorted(places, places[first] + BLOCK_BYTES, side="right") - 1) // 5 * 5)
        last = min(last, len(segment_lengths))
        gather = np.repeat(segment_starts[first:last] - places[first:last], segment_lengths[first:last]) + np.arange(places[first], places[last])
        np.take(source, gather, out=out[places[first] : places[last]])
        first = last
    return out, places[::5], places[3::5][:n]


_FORMATTED = pa.schema([("formatted", pa.large_string()), ("loss", pa.list_(pa.int64())), ("n_turns", pa.int64())])


def _conversations(keys: pa.Array, roles: pa.Array, texts: pa.Array, key_name: str) -> pa.RecordBatch:
    """One row for each run of equal keys. ``loss``: start and end bytes in turn."""
    n = len(keys)
    data, offsets, text_starts = assemble(escape_roles(roles), escape(texts))
    ids = pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    bounds = np.append(firsts, n)
    formatted = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(offsets[bounds].astype(np.int64)), pa.py_buffer(data))
    own = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False).astype(bool)
    conversation = np.repeat(np.arange(len(firsts)), np.diff(bounds))
    ends = offsets[1:] - len(END)
    spans = np.stack([text_starts, ends], 1) - offsets[firsts][conversation][:, None]
    counts = np.bincount(conversation[own], minlength=len(firsts))
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * counts)]), pa.int32()), pa.array(spans[own].ravel()))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(firsts)), formatted, loss, pa.array(np.diff(bounds))], names=[key_name, *_FORMATTED.names])


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id_col, formatted, loss, n_turns)`` with one row for each id.

    Turns are in the order of ``turn_col``, nulls first, then role, then text; repeated rows
    are turns of their own. Null roles and texts are empty. Rows with a null id form one
    conversation. ``loss`` holds the start and end byte of each assistant text in turn.
    """
    kind = turns.select(id_col).schema[0].dataType.simpleString()
    rows = turns.select(F.col(id_col), F.col(turn_col).alias("mediacat_turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role_col, "mediacat_role"), (text_col, "mediacat_text"))))
    rows = rows.repartition(id_col).sortWithinPartitions(id_col, "mediacat_turn", "mediacat_role", "mediacat_text").select(id_col, "mediacat_role", "mediacat_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the turns of the last conversation, which may go on

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                keys, roles, texts = (table.column(k).combine_chunks() for k in range(3))
                yield _conversations(keys, roles.cast(pa.large_string()), texts.cast(pa.large_string()), id_col)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            keys = batch.column(0)
            last = keys[len(keys) - 1]
            same = keys.is_null() if not last.is_valid else pc.fill_null(pc.equal(keys, last), False)
            start = pc.index(same, True).as_py()  # of the last conversation in this batch
            if start == 0 and held and held[0].column(0)[0].equals(last):
                held.append(now)
                continue
            if start:
                yield from done(pa.concat_tables([*held, now.slice(0, start)]))
            else:
                yield from done(pa.concat_tables(held)) if held else ()
            held = [now.slice(start)]
        if held:
            yield from done(pa.concat_tables(held))

    return rows.mapInArrow(run, f"`{id_col}` {kind}, formatted string, loss array<bigint>, n_turns bigint")


def parse(formatted: bytes) -> list[tuple[bytes, bytes, int, int]]:
    """``(role, text, start, end)`` of each turn, unescaped, with the text's byte range.
    Raises ``ValueError`` if anything but turns is there."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at byte {at}")
    return turns


def digest(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the output of :func:`format_chats` says when it is read back."""
    kind = chats.select(id_col).schema[0].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for formatted, loss in zip(b.column(1).cast(pa.large_binary()), b.column(2), strict=True):
                raw, spans = formatted.as_py(), loss.as_py()
                turns = parse(raw)
                if [x for r, _, s, e in turns if r == b"assistant" for x in (s, e)] != spans:
                    raise ValueError("the loss mask doesn't cover the assistant texts")
                all_turns, own = hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in turns:
                    all_turns.update(role + b"\n" + text + b"\n")
                chars = 0
                for s, e in zip(spans[::2], spans[1::2], strict=True):
                    text = unescape(raw[s:e])
                    own.update(text)
                    chars += len(text.decode())
                rows.append((len(turns), all_turns.hexdigest(), chars, own.hexdigest(), len(raw.decode())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])

    return chats.select(id_col, "formatted", "loss").mapInArrow(run, f"`{id_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
