"""Packing of documents into training sequences of several context sizes.

Every document is cut in full windows of the largest size and a remainder. Remainders are routed
to the smallest tier that holds them. Windows of the largest tier take one long remainder each;
their gaps are filled from the shorter tiers, largest piece first, the last one cut to fit. What is left
of the shorter tiers fills windows of their own size exactly, and windows are then dealt to step
groups of equal token counts. A task packs its own input partition, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import strings

#: Context sizes, all powers of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens of one training step.
STEP_TOKENS = 8 * 2048
END = 1
#: Text of the one special token of the vocabulary and its id (fixed values).
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Longer runs of white space are left to the slower of the two libraries: the other descends once for each of their characters.
MOST_SPACES = 10_000
_SPACES = re.compile(r"\s{%d}" % MOST_SPACES)


class Tokens:
    """Byte-level BPE ids of texts, as the library of the vocabulary gives them."""

    kept: dict[str, "Tokens"] = {}

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.library = ranks_path, None

    @classmethod
    def load(cls, path: str) -> "Tokens":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _library(self):
        """The same vocabulary as the other library reads it; its file lies beside that of the ranks."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(re.sub(r"\.tiktoken$", ".json", self.path))
        return self.library

    def encode(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            first, *rest = (self.encode(t) for t in text.split(SPECIAL))
            return np.concatenate([first, *(x for p in rest for x in (np.array([SPECIAL_ID], "<u4"), p))])
        if len(text) > MOST_SPACES and _SPACES.search(text):
            return np.array(self._library().encode(text, add_special_tokens=False).ids, "<u4")
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u4")


class Packer:
    """Packs pieces (row, start, length) of one partition; ``done`` gets (row, start, length, sequence, offset, tier)."""

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers)
        self.size = self.tiers[-1]
        #: pieces waiting in each tier, by length
        self.waiting: dict[int, dict[int, deque]] = {t: defaultdict(deque) for t in self.tiers}
        self.lengths: dict[int, list[int]] = {t: [] for t in self.tiers}
        self.tokens = {t: 0 for t in self.tiers}
        self.sequence = 0
        self.done: list[tuple] = []

    def _put(self, row, start: int, length: int) -> None:
        tier = next(t for t in self.tiers if length <= t)
        queue = self.waiting[tier]
        if not queue[length]:
            at = bisect_right(self.lengths[tier], length)
            self.lengths[tier].insert(at, length)
        queue[length].append((row, start))
        self.tokens[tier] += length

    def _take(self, most: int, tiers) -> tuple | None:
        """The longest waiting piece of these tiers of at most ``most`` tokens, or else the shortest longer one."""
        longer = None
        for t in reversed(tiers):
            lengths = self.lengths[t]
            at = bisect_right(lengths, most)
            if at:
                return self._pop(t, at - 1)
            if lengths and (longer is None or lengths[0] < self.lengths[longer][0]):
                longer = t
        return None if longer is None else self._pop(longer, 0)

    def _pop(self, tier: int, at: int) -> tuple:
        length = self.lengths[tier][at]
        queue = self.waiting[tier][length]
        row, start = queue.popleft()
        if not queue:
            del self.waiting[tier][length]
            self.lengths[tier].pop(at)
        self.tokens[tier] -= length
        return row, start, length

    def _fill(self, used: int, size: int, tier: int, tiers) -> None:
        """Fill the open sequence up to ``size``, from ``tiers`` while they last; the last piece is cut, its rest waits again."""
        while used < size:
            piece = self._take(size - used, tiers) or self._take(size - used, self.tiers)
            if piece is None:
                break
            row, start, length = piece
            fits = min(length, size - used)
            self.done.append((row, start, fits, self.sequence, used, tier))
            if fits < length:
                self._put(row, start + fits, length - fits)
            used += fits
        self.sequence += 1

    def add(self, row, length: int) -> None:
        start = 0
        while length - start >= self.size:
            self.done.append((row, start, self.size, self.sequence, 0, self.size))
            self.sequence += 1
            start += self.size
        if length > start:
            self._put(row, start, length - start)

    def pack(self, last: bool) -> None:
        """Pack what waits. Without ``last``, pieces that would leave an open sequence go on waiting."""
        size, short = self.size, self.tiers[:-1]
        while self.lengths[size] and sum(self.tokens.values()) >= (size if last else 2 * size):
            row, start, length = self._pop(size, len(self.lengths[size]) - 1)
            self.done.append((row, start, length, self.sequence, 0, size))
            self._fill(length, size, size, short)
        for t in reversed(short):
            mine = [x for x in self.tiers if x <= t]
            while self.lengths[t] and sum(self.tokens[x] for x in mine) >= t:
                self._fill(0, t, t, mine)
        if last:
            left = sum(self.tokens.values())
            for t in reversed(self.tiers):
                while left >= t:
                    self._fill(0, t, t, self.tiers)
                    left -= t
            if left:
                self._fill(0, size, size, self.tiers)


def pack_documents(
    docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", tiers=TIERS, step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where its ids lie in the document and in its sequence.

    A null or empty text is one end token; repeated rows are documents of their own; a text of any
    length is cut freely; an empty table gives an empty table; other columns are not read. Every task ends
    with at most one sequence that is neither full nor as long as a tier. ``step_group`` numbers groups of sequences of one
    context size with ``step_tokens`` tokens each; ``with_ids`` adds the ids themselves.
    """
    fields = [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("context_size", pa.int64()), ("step_group", pa.int64()),
    ] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    schema = pa.schema(fields)
    ddl = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else 'bigint'}" for f in schema)

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = Tokens.load(ranks_path), Packer(tiers)
        base = TaskContext.get().partitionId() << 32
        dealt: dict[int, int] = defaultdict(int)  # sequences so far of each tier
        group: dict[int, int] = {}
        groups = 0
        waiting: dict[int, list] = {}  # row -> [ids, doc id, tokens that are not yet out]

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal groups
            columns: list[list] = [[] for _ in schema]
            last = None
            for row, start, length, sequence, offset, tier in packer.done:
                if sequence != last:
                    if dealt[tier] % max(1, step_tokens // tier) == 0:
                        group[tier] = groups
                        groups += 1
                    dealt[tier] += 1
                    last = sequence
                entry = waiting[row]
                part = entry[0][start : start + length]
                values = [entry[1], start, length, zlib.crc32(part.tobytes()), len(entry[0]), base + sequence, offset, tier, base + group[tier]]
                for c, v in zip(columns, values + ([part.astype(np.int32)] if with_ids else [])):
                    c.append(v)
                entry[2] -= length
                if not entry[2]:
                    del waiting[row]
            packer.done.clear()
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        row = 0
        for frame in frames:
            for doc, t in zip(frame.column(0).to_pylist(), strings(frame.column(1))):
                ids = np.append(coder.encode(t), np.uint32(END)).astype("<u4")
                waiting[row] = [ids, doc, len(ids)]
                packer.add(row, len(ids))
                row += 1
            packer.pack(last=False)
            yield from out()
        packer.pack(last=True)
        yield from out()

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(pack, ddl)
