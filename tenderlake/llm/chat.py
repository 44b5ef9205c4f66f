"""Chat formatting with typed content parts.

A visitor turns the parts of a message into text with ordered placeholders,
and records what each placeholder stands for and how many tokens it expands
to. The template marks turns with control strings; control strings inside
texts are escaped, so that the formatted text reads back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
BEGIN, END = "<s>", "</s>"
OPEN, CLOSE = "[INST]", "[/INST]"
TURN = "<|turn|>"
TURN_END = "<|end|>"
#: Strings that mean something to the template, and the character that escapes them.
CONTROLS = (BEGIN, END, OPEN, CLOSE, TURN, TURN_END, "<|image|>", "<|audio|>", "<|document|>")
ESCAPE = "\\"
#: An escape character goes before each control string and each escape character of a text.
_TO_ESCAPE = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))


def escape(text: str) -> str:
    """``text`` with control strings broken up; ``unescape`` takes it back."""
    return _TO_ESCAPE.sub(lambda m: ESCAPE + (m[0] if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:]), text)


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:i])
        if text[i + 1] == ESCAPE:
            out.append(ESCAPE)
            at = i + 2
        else:  # a control string, whose first character a second escape follows
            out.append(text[i + 1])
            at = i + 3
    return "".join([*out, text[at:]])


class PartVisitor:
    """Flattens content parts; keeps text, attachments and token counts.

    Image tokens are those of square tiles and one more, audio tokens those
    of windows of sound, document tokens those of pages.
    """

    TILE, TILE_TOKENS = 512, 170
    AUDIO_SECONDS, AUDIO_TOKENS = 0.04, 1
    PAGE_TOKENS = 700

    def __init__(self):
        self.pieces: list[tuple[bool, str]] = []
        self.attachments: list[dict] = []

    def visit(self, part) -> None:
        """A part of an unknown type, and one that is no object, is the text of its JSON."""
        kind = (part.get("type") or "text") if isinstance(part, dict) else None
        handler = getattr(self, f"visit_{kind}", None) if isinstance(kind, str) else None
        if handler is None:
            self._text(part if isinstance(part, str) else json.dumps(part))
        else:
            handler(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self._text(text if isinstance(text, str) else "" if text is None else json.dumps(text))

    def visit_image(self, part: dict) -> None:
        width, height = (-(-int(_number(part.get(side), 1)) // self.TILE) for side in ("width", "height"))
        self._placeholder("image", part, width * height * self.TILE_TOKENS + 1)

    def visit_audio(self, part: dict) -> None:
        self._placeholder("audio", part, max(1, round(_number(part.get("seconds"), 0) / self.AUDIO_SECONDS)) * self.AUDIO_TOKENS)

    def visit_document(self, part: dict) -> None:
        self._placeholder("document", part, max(1, int(_number(part.get("pages"), 1))) * self.PAGE_TOKENS)

    def _text(self, text: str) -> None:
        self.pieces.append((True, text))

    def _placeholder(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"type": kind, "order": len(self.attachments), "ref": part.get("ref"), "tokens": tokens})
        self.pieces.append((False, f"<|{kind}|>"))

    def flat(self) -> str:
        """The texts, joined before they are escaped so that no control string comes of two of them, and the placeholders."""
        return "".join(escape("".join(t for _, t in run)) if text else "".join(t for _, t in run) for text, run in groupby(self.pieces, itemgetter(0)))


def _number(value, default: float) -> float:
    """A finite number of at least 0 and less than a billion, or else the default."""
    try:
        found = float(value)
    except (TypeError, ValueError, OverflowError):
        return default
    return found if 0 < found < 1e9 else default


def flatten_parts(content: str | None) -> tuple[str, list[dict]]:
    """Escaped text with placeholders, and attachments, of a JSON list of parts; null is empty.

    An object is the one part; content that is no JSON, or another value, is text as it stands.
    """
    visitor = PartVisitor()
    try:
        parts = json.loads(content) if content else []
    except (ValueError, RecursionError):
        parts = [content]
    for part in parts if isinstance(parts, list) else [parts if isinstance(parts, dict) else content]:
        visitor.visit(part)
    # JSON can name halves of surrogate pairs, which no text can hold
    return visitor.flat().encode("utf-16", "surrogatepass").decode("utf-16", "replace"), visitor.attachments


def format_turn(role: str, escaped: str, first: bool) -> tuple[str, int, int]:
    """One turn, and start and end of its part under the loss mask (equal if it has none).

    User turns stand between OPEN and CLOSE, assistant turns end with END,
    and other roles are named after TURN and the length of their name.
    """
    start = BEGIN if first else ""
    if role == "user":
        out = f"{start}{OPEN} {escaped} {CLOSE}"
        return out, 0, 0
    if role == "assistant":
        out = f"{start} {escaped}{END}"
        return out, len(start) + 1, len(out) - len(END)
    name = escape(role)
    return f"{start}{TURN}{len(name)} {name} {escaped}{TURN_END}", 0, 0


def read_turn(segment: str) -> tuple[str, str]:
    """Role and unescaped text of a formatted turn."""
    body = segment.removeprefix(BEGIN)
    if body.startswith(OPEN):
        return "user", unescape(body[len(OPEN) + 1 : -len(CLOSE) - 1])
    if body.startswith(TURN):
        size, rest = body[len(TURN) : -len(TURN_END)].split(" ", 1)
        return unescape(rest[: int(size)]), unescape(rest[int(size) + 1 :])
    return "assistant", unescape(body[1 : -len(END)])


_TURN_ENDS = re.compile("|".join(map(re.escape, (CLOSE, END, TURN_END))))


def split_turns(formatted: str) -> list[str]:
    """The turns of a formatted conversation; escaped strings can't end one."""
    out, at = [], 0
    for m in _TURN_ENDS.finditer(formatted):
        out.append(formatted[at : m.end()])
        at = m.end()
    return out


def format_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", content_col: str | None = None) -> DataFrame:
    """``conv, turn, role, escaped, attachments, tokens`` of every row, each flattened on its own.

    ``content_col`` holds JSON lists of parts; without it the text is the one
    part. Odd content has a result too: see ``flatten_parts``, ``PartVisitor.visit``
    and, for sizes that are no numbers, ``_number``. Null texts are empty and null roles are ``""``. ``attachments`` is
    a JSON list in the order of the placeholders; ``tokens`` counts what they
    expand to.
    """
    part = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))))
    rows = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        (F.col(content_col) if content_col else part).alias("content"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("conv", "turn")})  # pandas would turn integers with nulls into floats

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for role, content in zip(pdf["role"], pdf["content"], strict=True):
                escaped, attached = flatten_parts(content)
                out.append((escaped, json.dumps(attached), sum(a["tokens"] for a in attached)))
            pdf = pdf.drop(columns="content")
            pdf["escaped"], pdf["attachments"], pdf["tokens"] = zip(*out, strict=True) if out else ([], [], [])
            yield pdf

    schema = "conv string, turn string, role string, escaped string, attachments string, tokens long"
    return rows.mapInPandas(run, schema).withColumns({c: F.col(c).cast(kinds[c]) for c in ("conv", "turn")})


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, segment, loss_start, loss_end, n, attachments, tokens`` from ``format_turns``.

    The segments of a conversation, joined by n, are its formatted text; the
    loss mask covers [loss_start, loss_end) of a segment. Turns are ordered
    by (turn, role, text); rows without an id are one conversation. Rows come sorted within a partition that holds whole conversations, so a
    conversation of any length passes through as a stream.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "escaped").withColumns({c: F.col(c).cast("string") for c in ("conv", "turn")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = object(), 0
        for pdf in frames:
            out = []
            for conv, role, escaped in zip(pdf["conv"], pdf["role"], pdf["escaped"], strict=True):
                n = n + 1 if conv == last else 0
                last = conv
                out.append((*format_turn(role, escaped, n == 0), n))
            got = pdf.drop(columns="escaped")
            got["segment"], got["loss_start"], got["loss_end"], got["n"] = zip(*out, strict=True) if out else ([], [], [], [])
            yield got[["conv", "turn", "role", "segment", "loss_start", "loss_end", "n", "attachments", "tokens"]]

    schema = "conv string, turn string, role string, segment string, loss_start long, loss_end long, n long, attachments string, tokens long"
    return ordered.mapInPandas(run, schema).withColumns({c: F.col(c).cast(kinds[c]) for c in ("conv", "turn")})


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, from segments and masks alone.

    Segments are joined and split by the marks of turns, whatever the rows
    were. Digests are fed in order, so no conversation is held whole.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    ordered = formatted.select("conv", "n", "segment", "loss_start", "loss_end").repartition("conv").sortWithinPartitions("conv", "n").withColumn("conv", F.col("conv").cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, waiting = None, ""

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for pdf in frames:
            out = []
            for conv, n, segment, a, b in pdf.itertuples(index=False):
                if n == 0:
                    if state:
                        out.append(row(state))
                    state, waiting = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], ""
                waiting += segment
                for turn in split_turns(waiting):
                    role, text = read_turn(turn)
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    waiting = waiting[len(turn) :]
                lost = unescape(segment[a:b])
                state[3] += len(lost)
                state[4].update(lost.encode())
                state[5] += len(segment)
            yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame([row(state)], columns=names)

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInPandas(run, schema).withColumn("conv", F.col("conv").cast(kind))
