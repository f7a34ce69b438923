"""Chat formatting of typed content parts.

A visitor walks the parts of a turn in order: images, audio and documents become numbered placeholders whose references
and expanded token counts are recorded; texts that follow each other are joined and escaped as one, so that no control
string can be put together from several parts. The template marks turns, and the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Every control string starts with "<|". A backslash goes between the two, and one more where some are there already.
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document)_([0-9]+)\|>")

PART = "struct<kind:string,text:string,ref:string,amount:double>"
ATTACHMENT = "struct<position:int,kind:string,ref:string,tokens:bigint>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<{m[1]}\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1][1:]}|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    """A role ends at its line's end, so its line breaks and backslashes are escaped as well."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Flattens parts into text. Placeholders are numbered in order of appearance within the turn.

    amount is the number of pixels of an image, of seconds of audio, of pages of a document (null: one unit's worth).
    """

    #: Pixels an image token stands for, tokens a second of audio, tokens a page of a document.
    PIXELS, PER_SECOND, PER_PAGE = 28 * 28, 25, 512

    def __init__(self) -> None:
        self.out: list[str] = []
        self.texts: list[str] = []  # those since the last placeholder, not escaped yet
        self.attachments: list[dict] = []

    def visit(self, part: Mapping) -> None:
        method = getattr(self, f"visit_{part['kind'] or 'text'}", None)
        if method is None:
            raise ValueError(f"unknown part kind {part['kind']!r}")
        method(part)

    def visit_text(self, part: Mapping) -> None:
        self.texts.append(part["text"] or "")

    def visit_image(self, part: Mapping) -> None:
        self._attach(part, ceil((part["amount"] or self.PIXELS) / self.PIXELS))

    def visit_audio(self, part: Mapping) -> None:
        self._attach(part, ceil((part["amount"] or 1) * self.PER_SECOND))

    def visit_document(self, part: Mapping) -> None:
        self._attach(part, ceil(part["amount"] or 1) * self.PER_PAGE)

    def flattened(self) -> str:
        self._end_text()
        return "".join(self.out)

    def _end_text(self) -> None:
        self.out.append(escape("".join(self.texts)))
        self.texts.clear()

    def _attach(self, part: Mapping, tokens: int) -> None:
        self._end_text()
        self.attachments.append({"position": len(self.attachments), "kind": part["kind"], "ref": part["ref"], "tokens": tokens})
        self.out.append(f"<|{part['kind']}_{len(self.attachments)}|>")


def format_turns(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_chars, attachments, attachment_tokens: one row per turn.

    turns: conv_id, turn, role and text, which is one text part; or parts names a column with an array of PART, which then
    stands for the text. formatted is the turn in
    the template; the formatted conversation is the concatenation of its turns. An assistant's turn is under the loss
    mask from loss_start on for loss_chars code points (its flattened content, as escaped). Null texts, parts and roles
    are empty; rows are formatted one by one, so repeated rows and ties in turn stay; an unknown kind is an error.
    Very long texts are formatted whole, an empty table gives no rows, other columns are ignored, whatever their names.
    """
    whole = parts is not None
    content = (F.col(parts).cast(f"array<{PART}>") if whole else F.col("text")).alias("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for role, content in zip(b.column("role").to_pylist(), b.column("content").to_pylist(), strict=True):
                visitor = PartVisitor()
                for part in (content or []) if whole else [{"kind": "text", "text": content}]:
                    visitor.visit(part)
                head, body = f"{START}{escape_role(role or '')}\n", visitor.flattened()
                loss = len(body) if role == "assistant" else 0
                rows.append((f"{head}{body}{END}\n", len(head), loss, visitor.attachments, sum(a["tokens"] for a in visitor.attachments)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])), pa.int64())
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([b.column("conv_id"), b.column("turn"), b.column("role"), *cols], names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_chars", "attachments", "attachment_tokens"])

    cols = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", content)
    return cols.mapInArrow(run, f"conv_id long, turn long, role string, formatted string, loss_start int, loss_chars int, attachments array<{ATTACHMENT}>, attachment_tokens bigint")


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and content of a formatted turn, with control strings as they were."""
    head, _, rest = formatted.removeprefix(START).partition("\n")
    body = rest[: rest.index(END)]
    return unescape_role(head), unescape(body)


def read_parts(formatted: str) -> list[tuple[str, str]]:
    """The content of a formatted turn as (kind, text or attachment number); neighbouring texts come back as one.

    A placeholder that a text held came out escaped, so what looks like one here is one.
    """
    body = formatted.removeprefix(START).partition("\n")[2]
    pieces = _PLACEHOLDER.split(body[: body.index(END)])
    found = [("text", unescape(pieces[0]))]
    for kind, number, text in zip(pieces[1::3], pieces[2::3], pieces[3::3], strict=True):
        found += [(kind, number), ("text", unescape(text))]
    return [p for p in found if p != ("text", "")]


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attachment_tokens of each
    conversation, read back from format_turns().

    Turns are taken in the order of turn (null first), then of the formatted text. A digest over a conversation can only be taken in
    sequence, so a conversation is streamed through one task: it holds one turn and the running digests, however long
    the conversation. Rows with a null conv_id are one conversation. Repeated rows are turns of their own, an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = None, False
        for b in batches:
            done = []
            for conv, text, start, loss, files, cost in zip(b.column("conv_id").to_pylist(), b.column("formatted"), *(b.column(c).to_pylist() for c in ("loss_start", "loss_chars", "files", "attachment_tokens")), strict=True):
                if not begun or state["conv_id"] != conv:
                    if begun:
                        done.append(state)
                    state, begun = {"conv_id": conv, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0, "n_attachments": 0, "attachment_tokens": 0}, True
                text = text.as_py()
                role, content = read_turn(text)
                masked = unescape(text[start : start + loss])
                state["n_turns"] += 1
                state["turns"].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                state["loss_chars"] += len(masked)
                state["loss"].update(masked.encode("utf-8", "surrogatepass"))
                state["formatted_chars"] += len(text)
                state["n_attachments"] += files
                state["attachment_tokens"] += cost
            yield table(done)
        if begun:
            yield table([state])

    def table(rows: list[dict]) -> pa.RecordBatch:
        one = lambda k, t: pa.array([r[k] for r in rows], t)
        text, num = pa.string(), pa.int64()
        return pa.record_batch(
            [one("conv_id", num), one("n_turns", num), pa.array([r["turns"].hexdigest() for r in rows], text), one("loss_chars", num), pa.array([r["loss"].hexdigest() for r in rows], text), one("formatted_chars", num), one("n_attachments", num), one("attachment_tokens", num)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"],
        )

    ordered = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_chars", F.size("attachments").alias("files"), "attachment_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")
