"""Conversations with typed content parts, flattened into one marked text with a loss mask.

A turn becomes ``<|turn|>role<|text|>body<|end|>``. A body is made by a visitor over the turn's parts:
text is escaped, an image, audio or document part becomes a numbered placeholder such as
``<|image:1|>``, and its reference and the number of tokens it will expand to are recorded.

Escaping is reversible: a backslash is doubled, and a control string of this or another common
template is broken by a backslash after its first character, so no text can look like a mark.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that chat templates give a meaning, by their first character and what follows it.
CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>)|\[(?=/?INST\])")
MARKED = re.compile(r"\\(\\?)")
TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):\d+\|>")
PATCH, FRAMES_A_SECOND, TOKENS_A_PAGE = 28, 25, 256
SEGMENT = "conv_id bigint, seq bigint, segment string, loss_start bigint, loss_end bigint, attachments array<struct<ordinal: int, kind: string, uri: string, tokens: bigint>>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attachments bigint, attachment_tokens bigint"


def escape(text: str) -> str:
    return CONTROL.sub(lambda found: found.group() + "\\", text)


def unescape(text: str) -> str:
    return MARKED.sub(r"\1", text)


class Flatten:
    """Visitor over a turn's parts: collects the body and the attachments in order."""

    def __init__(self, first: int):
        self.body: list[str] = []
        self.attachments: list[dict] = []
        self.first = first

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escape(part.get("text") or ""))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.first + len(self.attachments)
        self.attachments.append({"ordinal": number, "kind": kind, "uri": part.get("uri"), "tokens": tokens})
        self.body.append(f"<|{kind}:{number}|>")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * FRAMES_A_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * TOKENS_A_PAGE)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each turn, in order: conv_id, seq, segment, loss_start, loss_end, attachments.

    ``turns`` has conv_id, turn, role, text and may have ``parts``, an array of structs with type ("text",
    "image", "audio", "document"; anything else is a document), text, uri, width, height, seconds, pages;
    null parts mean the text alone. Rows go by turn (null first), ties by role and text; equal
    rows are turns of their own. A null role or text is empty; null conv_id is one conversation. The formatted conversation is its segments in
    order; loss_start and loss_end are places in it (equal for a turn that is not the assistant's). Rows of a
    conversation stream through one task and are never held together; other columns are ignored.
    """
    parted = "parts" in turns.columns
    names = ["conv_id", "turn", "role", "text", *["parts"] * parted]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seq, at, ordinal = object(), 0, 0, 1
        for batch in batches:
            out = []
            rows = zip(*(batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("conv_id", "role", "text")), batch.column(batch.num_columns - 1).to_pylist() if parted else [None] * batch.num_rows, strict=True)
            for conv, role, text, parts in rows:
                if conv != current:
                    current, seq, at, ordinal = conv, 0, 0, 1
                flat = Flatten(ordinal)
                for part in parts if parts is not None else [{"type": "text", "text": text}]:
                    flat.visit(part or {})
                ordinal += len(flat.attachments)
                head, body = f"<|turn|>{escape(role or '')}<|text|>", "".join(flat.body)
                segment = f"{head}{body}<|end|>"
                first = at + len(head)
                out.append((conv, seq, segment, first, first + len(body) * (role == "assistant"), flat.attachments))
                seq, at = seq + 1, at + len(segment)
            attachment = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), attachment)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "seq", "segment", "loss_start", "loss_end", "attachments"])

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), *names[1:])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENT)


def read_turns(segments: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted segments; placeholders stand for their parts."""
    for segment in segments:
        for role, body in TURN.findall(segment):
            yield unescape(role), unescape(body)


def digest_conversations(segments: DataFrame) -> DataFrame:
    """What the formatted rows say, read back: one row for each conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())

        def row():
            return (current, state["turns"], state["all"].hexdigest(), state["loss"], state["under"].hexdigest(), state["chars"], state["attachments"], state["tokens"])

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[part.split()[0] for part in DIGEST.split(", ")])

        for batch in batches:
            out = []
            columns = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("conv_id", "segment", "loss_start", "loss_end", "attachments"))
            for conv, segment, first, last, attached in zip(*columns, strict=True):
                if state is None or conv != current:
                    if state is not None:
                        out.append(row())
                    current, state = conv, {"turns": 0, "all": hashlib.sha256(), "loss": 0, "under": hashlib.sha256(), "chars": 0, "attachments": 0, "tokens": 0}
                for role, text in read_turns([segment]):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = unescape(PLACEHOLDER.sub("", segment[first - state["chars"] : last - state["chars"]]))
                state["loss"] += len(under)
                state["under"].update(under.encode("utf-8", "surrogatepass"))
                state["chars"] += len(segment)
                state["attachments"] += len(attached or [])
                state["tokens"] += sum(item["tokens"] for item in attached or [])
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([row()])

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, DIGEST)
