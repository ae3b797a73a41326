"""Chat records with a loss mask that is exact to the character.

A conversation is rendered whole by a template, encoded once with character offsets, and the spans
of its turns are laid over the spans of its tokens by binary search. The template's control strings
are tokens of their own, so no token reaches from a turn's text over its border.

    <|im_start|>role<|im_sep|>text<|im_end|>

Inside roles and texts every ``<|`` gets a backslash, ``<\\|``, and every ``<``, backslashes, ``|`` one
more backslash, which ``unescaped`` takes away again; so nothing a text says can open or close a turn.

Turns are ordered by number, then role and text; a null role or text is empty, a null number comes
first. Repeated turns stay. Rows without conversation id form one conversation with a null id. The
rows of a conversation are brought together by a sort that can spill, and a task holds one
conversation and its tokens at a time: the record is one value, so its size is the bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

# fixed values: control strings of the template
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"

_OPEN = re.compile(r"<(\\*)\|")
_OPENED = re.compile(r"<(\\*)\\\|")


def escaped(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def rendered(turns: Sequence[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The record of (role, text) turns, and the character span of each turn's text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        out += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def read_back(record: str) -> list[tuple[str, str]]:
    """The turns of a record."""
    turns = []
    for piece in record.split(START)[1:]:
        role, _, rest = piece.partition(SEP)
        turns.append((unescaped(role), unescaped(rest[: -len(END)])))
    return turns


def loss_mask(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span; both are sorted (start, end) character ranges.

    A token is in the last span that starts at or before it, or in none. Empty tokens and empty
    spans hold nothing.
    """
    if not len(spans):
        return np.zeros(len(tokens), dtype=bool)
    at = np.searchsorted(spans[:, 0], tokens[:, 0], side="right") - 1
    inside = (at >= 0) & (tokens[:, 1] <= spans[np.maximum(at, 0), 1])
    return inside & (tokens[:, 0] < tokens[:, 1])


def masked_text(record: str, tokens: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, once: tokens may share a character, as bytes of one letter do."""
    kept = tokens[mask]
    if not len(kept):
        return ""
    ends = np.maximum.accumulate(kept[:, 1])
    starts = np.maximum(kept[:, 0], np.append(0, ends[:-1]))
    fresh = np.flatnonzero(np.append(True, starts[1:] != ends[:-1]))
    stops = np.append(ends[fresh[1:] - 1], ends[-1])
    return "".join(unescaped(record[a:b]) for a, b in zip(starts[fresh], stops))


def tokenizer_with_controls(spec: str) -> Tokenizer:
    """The tokenizer of a file's text, with the control strings as tokens behind its own."""
    own = Tokenizer.from_str(spec)
    own.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (START, SEP, END)])
    own.no_truncation()
    own.no_padding()
    return own


def _encoded(own: Tokenizer, record: str) -> tuple[np.ndarray, np.ndarray]:
    found = own.encode(record, add_special_tokens=False)
    offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
    return np.array(found.ids, dtype=np.int64), offsets


_SCHEMA = (
    "conv_id bigint, n_turns bigint, formatted string, ids array<bigint>, mask array<boolean>,"
    " turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def format_chats(rows: DataFrame, tokenizer_path: str, whole: bool = True) -> DataFrame:
    """One row per conversation of ``conv_id``, ``turn``, ``role``, ``text``.

    ``formatted`` is the record, ``ids`` its tokens and ``mask`` true on those of assistant texts.
    The other columns are read back from these three; without ``whole`` only they are returned.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file
    turns = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
    kept = names if whole else [n for n in names if n not in ("formatted", "ids", "mask")]
    schema = ", ".join(c for c in _SCHEMA.split(", ") if c.split(" ")[0] in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_with_controls(shared.value)
        for found in _some(_conversations(batches), lambda c: _row(own, *c, whole)):
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in kept} for r in found], schema=_arrow(kept))

    return dealt.mapInArrow(run, schema)


def _arrow(kept: Sequence[str]) -> pa.Schema:
    kinds = {
        "formatted": pa.string(), "ids": pa.list_(pa.int64()), "mask": pa.list_(pa.bool_()),
        "turns_sha256": pa.string(), "loss_sha256": pa.string(),
    }
    return pa.schema([(n, kinds.get(n, pa.int64())) for n in kept])


def _conversations(batches: Iterator[pa.RecordBatch]):
    """(id, turns) of each run of sorted rows."""
    now, turns = object(), []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]
        for conv, role, text in zip(*columns):
            if conv != now:
                if turns:
                    yield now, turns
                now, turns = conv, []
            turns.append((role, text))
    if turns:
        yield now, turns


def _some(items, make, budget: int = 4 << 20):
    """Lists of made rows that hold about ``budget`` characters."""
    out, size = [], 0
    for item in items:
        out.append(make(item))
        size += out[-1]["formatted_chars"]
        if size >= budget:
            yield out
            out, size = [], 0
    if out:
        yield out


def _row(own: Tokenizer, conv_id, turns, whole: bool) -> dict:
    record, spans = rendered(turns)
    ids, tokens = _encoded(own, record)
    learned = spans[[role == LEARNED for role, _ in turns]]
    mask = loss_mask(tokens, learned)
    back = read_back(record)
    loss = masked_text(record, tokens, mask)
    said = "".join(f"{role}\n{text}\n" for role, text in back)
    return {
        "conv_id": conv_id,
        "n_turns": len(back),
        "formatted": record,
        "ids": ids.tolist() if whole else None,
        "mask": mask.tolist() if whole else None,
        "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
        "loss_chars": len(loss),
        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
        "formatted_chars": len(record),
    }
