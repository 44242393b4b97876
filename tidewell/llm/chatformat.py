"""Conversations as training text: typed parts become text and placeholders, turns are marked, control strings escaped.

A message is a list of parts: text, image, audio or document. A visitor takes them in order; text is
escaped, every other part becomes a numbered placeholder, its reference is recorded with the place of the placeholder and the tokens it
stands for. A turn is formatted by itself, so formatting moves no row. ``read_turn`` undoes it from the formatted text alone.

Digests of whole conversations are sequential by nature. Turns are sorted in even ranges; a range digests the conversations
that lie in it whole, and only what reaches over the edge of a range is handed on, in pieces, to be digested piece after piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import BATCH_ROWS, write_and_read
from tidewell.llm.packing import Tokens

#: The marks of a turn. Every control string starts with ``<|``, which no escaped text holds.
START, END = "<|im_start|>", "<|im_end|>"
#: Role whose text the model learns.
LEARNT = "assistant"
#: Tokens: an image takes one for every PATCH x PATCH pixels and a row end, an audio part so many a second, a document so many a page.
PATCH, MOST_PATCHES, AUDIO_RATE, PAGE_TOKENS = 28, 4096, 25, 640

PART_TYPE = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
PARTS = f"array<{PART_TYPE}>"
ATTACHMENT_FIELDS = [("slot", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]
#: Bytes of text in one piece of a conversation that lies in several ranges.
PIECE_BYTES = 1 << 20
#: Rows that wait before a batch goes out while they are pieces.
OUT_PIECES = 8
#: Code points of a text that take part in finding the range of a turn.
RANGE_CHARS = 32

_ESCAPABLE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_SLOT = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    r"""Put one more backslash between ``<`` and ``|``, also where some are there already, so no ``<|`` is left."""
    return _ESCAPABLE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def role_line(role: str) -> str:
    """A role on one line without control strings."""
    return escape(role.replace("\\", r"\\").replace("\n", r"\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


@dataclass
class Flattener:
    """Visits the parts of one message in order. Texts side by side become one run, so no control string arises where they meet."""

    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0
    _run: list[str] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        part = part or {}
        getattr(self, f"visit_{part['kind']}" if part.get("kind") in ("image", "audio", "document") else "visit_text")(part)

    def visit_text(self, part: dict) -> None:
        self._run.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (-(-max(part.get(side) or 1, 1) // PATCH) for side in ("width", "height"))
        self._attach(part, min(across * down, MOST_PATCHES) + down)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        self._attach(part, max(1, int(seconds * AUDIO_RATE)) if 0 <= seconds < float("inf") else 1)

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, part.get("pages") or 1) * PAGE_TOKENS)

    def finish(self) -> str:
        """The message: escaped texts and placeholders."""
        self._end_run()
        return "".join(self.pieces)

    def _end_run(self) -> None:
        text = escape("".join(self._run))
        self._run.clear()
        if text:
            self.spans.append((self.length, self.length + len(text)))
            self._put(text)

    def _attach(self, part: dict, tokens: int) -> None:
        self._end_run()
        slot = len(self.attachments)
        self.attachments.append({"slot": slot, "kind": part["kind"], "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._put(f"<|{part['kind']}:{slot}|>")

    def _put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def format_turn(role: str, parts: list[dict | None]) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The formatted turn, the spans of its text that are learnt, and its attachments; places count code points of the formatted turn."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    message, head = flat.finish(), f"{START}{role_line(role)}\n"
    spans = [(a + len(head), b + len(head)) for a, b in flat.spans] if role == LEARNT else []
    return f"{head}{message}{END}\n", spans, [{**x, "at": x["at"] + len(head)} for x in flat.attachments]


def read_turn(formatted: str) -> tuple[str, list[tuple[str, str | int]]]:
    """Role and parts, ("text", text) or (kind, slot), of a formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    head, _, message = formatted[len(START) : -len(END) - 1].partition("\n")
    parts, at = [], 0
    for slot in _SLOT.finditer(message):
        if slot.start() > at:
            parts.append(("text", unescape(message[at : slot.start()])))
        parts.append((slot[1], int(slot[2])))
        at = slot.end()
    if at < len(message):
        parts.append(("text", unescape(message[at:])))
    return role_of(head), parts


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ATTACHMENTS = pa.list_(pa.struct(ATTACHMENT_FIELDS))
RESULT = (
    "struct<formatted:string,loss:array<struct<start:bigint,end:bigint>>,"
    "attachments:array<struct<slot:bigint,kind:string,ref:string,at:bigint,tokens:bigint>>,n_tokens:bigint>"
)
ADDED = ("formatted", "loss", "attachments", "n_tokens")


def text_parts(text: str) -> Column:
    """A message that is a plain text, as its only part."""
    return F.array(F.named_struct(F.lit("kind"), F.lit("text"), F.lit("text"), F.col(text)))


def format_turns(turns: DataFrame, role: str = "role", parts: str = "parts", ranks_path: str | None = None) -> DataFrame:
    """``turns`` with ``formatted``, ``loss``, ``attachments`` and ``n_tokens`` in place of their parts.

    ``parts`` is an array of structs with ``kind`` and any of text, ref, width, height, seconds and pages. A null role or text is empty; a part of
    another kind, or none, counts as text; a null list is an empty message; sizes that are null, negative or not finite count as the least there is. ``loss``
    holds the spans of ``formatted`` that are learnt, ``attachments`` the places of the placeholders, in code points. ``n_tokens`` are the tokens
    of the attachments expanded, and those of the texts too if a vocabulary is named. Every turn, repeated ones too, is formatted by
    itself where it lies; an empty table gives an empty table; other columns pass through, and one named like a result is refused.
    """
    clash = set(ADDED) & set(turns.columns)
    if clash:
        raise ValueError(f"columns named like results: {sorted(clash)}")

    def formatted(roles: pa.Array, messages: pa.Array) -> pa.Array:
        coder = Tokens.load(ranks_path) if ranks_path else None
        texts, losses, found, tokens = [], [], [], []
        for name, message in zip(roles.to_pylist(), messages.to_pylist()):
            text, spans, attachments = format_turn(name or "", message or [])
            texts.append(text)
            losses.append([{"start": a, "end": b} for a, b in spans])
            found.append(attachments)
            own = sum(len(coder.encode(p)) for kind, p in read_turn(text)[1] if kind == "text") if coder else 0
            tokens.append(own + sum(x["tokens"] for x in attachments))
        return pa.StructArray.from_arrays(
            [pa.array(texts, pa.string()), pa.array(losses, SPANS), pa.array(found, ATTACHMENTS), pa.array(tokens, pa.int64())], names=list(ADDED)
        )

    once = F.arrow_udf(formatted, RESULT).asNondeterministic()
    done = turns.withColumn("_tw_chat", once(F.col(role).cast("string"), F.col(parts)))
    return done.select(*(c for c in turns.columns if c != parts), *(F.col("_tw_chat")[c].alias(c) for c in ADDED))


class Digest:
    """Running digests of one conversation, fed with the bytes of its turns and of its learnt texts."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.counts = [0, 0, 0, 0]  # turns, learnt code points, formatted code points, attachments

    def add(self, turns: bytes, loss: bytes, counts) -> None:
        self.turns.update(turns)
        self.loss.update(loss)
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def row(self) -> tuple:
        n, learnt, length, attachments = self.counts
        return n, self.turns.hexdigest(), learnt, self.loss.hexdigest(), length, attachments


DIGEST_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint"
DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
DIGEST_NAMES = [x.split()[0] for x in DIGEST_DDL.split(", ")]
PIECE_DDL = "range int, seq bigint, turns binary, loss binary, counts array<bigint>"
PIECE_NAMES, PIECE_TYPES = ["range", "seq", "turns", "loss", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def turn_bytes(formatted: str, spans: list[dict]) -> tuple[bytes, bytes, tuple]:
    """What one formatted turn adds to the digests: its turn, its learnt text, and counts."""
    role, parts = read_turn(formatted)
    text = "".join(p for kind, p in parts if kind == "text")
    learnt = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
    return (
        f"{role}\n{text}\n".encode("utf-8", "surrogatepass"), learnt.encode("utf-8", "surrogatepass"),
        (1, len(learnt), len(formatted), sum(kind != "text" for kind, _ in parts)),
    )


class Reader:
    """Reads a sorted range of turns; ``out`` gets a digest of each conversation that lies in it whole, and pieces of all others."""

    def __init__(self, number: int, piece_bytes: int = PIECE_BYTES):
        self.number, self.seq, self.out, self.most = number, 0, [], piece_bytes
        self.conv, self.held, self.size = None, [], 0
        #: whether the conversation goes out in pieces: the first one may have begun in an earlier range, and long ones are not held
        self.pieced, self.started = True, False

    def turn(self, conv: int | None, formatted: str, spans: list[dict]) -> None:
        if self.started and conv != self.conv:
            self._end()
            self.pieced = False
        self.conv, self.started = conv, True
        self.held.append(turn_bytes(formatted, spans))
        self.size += len(self.held[-1][0])
        if self.size > self.most:
            self._piece()

    def finish(self) -> None:
        """The last conversation may go on in a later range."""
        if self.held:
            self._piece()

    def _end(self) -> None:
        if self.pieced:
            self.finish()
            return
        digest = Digest()
        for x in self.held:
            digest.add(*x)
        self.out.append((self.conv, *digest.row(), *[None] * len(PIECE_NAMES)))
        self.held, self.size = [], 0

    def _piece(self) -> None:
        turns, loss, counts = zip(*self.held)
        self.out.append((self.conv, *[None] * (len(DIGEST_NAMES) - 1), self.number, self.seq, b"".join(turns), b"".join(loss), [sum(c) for c in zip(*counts)]))
        self.seq += 1
        self.held, self.size, self.pieced = [], 0, True


def read_range(piece_bytes: int):
    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(TaskContext.get().partitionId(), piece_bytes)
        for frame in frames:
            for row in zip(*(frame.column(i).to_pylist() for i in range(3))):
                reader.turn(*row)
                if len(reader.out) >= (OUT_PIECES if reader.pieced else BATCH_ROWS):
                    yield _batch(reader.out, DIGEST_NAMES + PIECE_NAMES, DIGEST_TYPES + PIECE_TYPES)
                    reader.out = []
        reader.finish()
        yield _batch(reader.out, DIGEST_NAMES + PIECE_NAMES, DIGEST_TYPES + PIECE_TYPES)

    return work


def _join_pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces come in order."""
    conv, digest, out = None, None, []
    for frame in frames:
        for name, turns, loss, counts in zip(*(frame.column(i).to_pylist() for i in range(4))):
            if digest is not None and name != conv:
                out.append((conv, *digest.row()))
                digest = None
            conv, digest = name, digest or Digest()
            digest.add(turns, loss, counts)
    if digest is not None:
        out.append((conv, *digest.row()))
    yield _batch(out, DIGEST_NAMES, DIGEST_TYPES)


def conversation_digests(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """One row per conversation, read back from its formatted turns: digests of the turns and of the learnt text, and their lengths.

    Turns of a conversation follow ``turn`` (null first), then role and text (null counts as empty); repeated rows are turns each; rows
    without an id are one conversation; an empty table gives an empty table; other columns are not read. A conversation of any size is sorted in many
    tasks; only its bytes run through one, in pieces, as a digest must.
    """
    rows = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(RANGE_CHARS))).sortWithinPartitions("conv_id", "turn", "role", "text")
    formatted = format_turns(ranged.withColumn("parts", text_parts("text")).drop("text"))
    read = formatted.select("conv_id", "formatted", "loss").mapInArrow(read_range(piece_bytes), f"{DIGEST_DDL}, {PIECE_DDL}")
    read = write_and_read(read, "chats")
    whole = read.where("range IS NULL").select(*DIGEST_NAMES)
    pieces = read.where("range IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "range", "seq")
    return whole.unionByName(pieces.select("conv_id", "turns", "loss", "counts").mapInArrow(_join_pieces, DIGEST_DDL))
