"""Postings on their way from the texts to the buckets of an index, packed in compressed blocks.

A term hashes to a unit and several units make a part. A batch of texts writes one block for each part: its terms once, sorted, with
the place and count of each in the texts. Whoever holds all blocks of a part has every posting of its terms, and so their document counts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor of the first word's checksum in the hash of a term.
MIX = 1_000_003
#: Bytes of text that are packed at once; a larger batch is halved, down to single texts.
PACK_BYTES = 1 << 22
#: Postings that are sorted at once: a term that most texts hold has one for each; and rows in a batch that is handed back.
SORTED_ROWS, OUT_ROWS = 1 << 21, 1 << 17
BLOCK_DDL = "round int, part int, size bigint, block binary"


def term_hash(term: str) -> Column:
    """Of a word or a pair of words; at least 0."""
    first, second = (F.crc32(F.split_part(term, F.lit(" "), F.lit(i))) for i in (1, 2))
    return first * F.lit(MIX).cast("bigint") + second


def _planes(a: np.ndarray, kind: type) -> bytes:
    """The bytes of numbers, all first ones, then all second ones and so on: small numbers leave planes of zeros."""
    size = np.dtype(kind).itemsize
    return a.astype(kind).view(np.uint8).reshape(len(a), size).T.tobytes()


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> memoryview:
        self.at += n
        return memoryview(self.raw)[self.at - n : self.at]

    def planes(self, n: int, kind: type) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.take(n * size), np.uint8).reshape(size, n).T.copy().view(kind).reshape(n)


def _keys_packed(keys: pa.Array, at: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as planes (kind 0); other keys, and null ones, as a dictionary in Arrow's format (kind 1)."""
    if pa.types.is_integer(keys.type) and not keys.null_count:
        return 0, _planes(keys.to_numpy(zero_copy_only=False)[at], np.int64)
    used, index = np.unique(at, return_inverse=True)
    column = pa.DictionaryArray.from_arrays(pa.array(index, pa.int32()), keys.take(pa.array(used)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", column.type)])) as out:
        out.write_batch(pa.record_batch([column], names=["key"]))
    return 1, sink.getvalue().to_pybytes()


def _keys_read(raw: memoryview, kind: int, n: int, key: pa.DataType) -> pa.Array:
    if kind == 0:
        return pa.array(_Reader(raw).planes(n, np.int64)).cast(key)
    column = pa.ipc.open_stream(pa.py_buffer(raw)).read_all().column(0).combine_chunks()
    return column.dictionary.take(column.indices).cast(key)


def _first_units(units: int, parts: int) -> list[int]:
    """The first unit of every part, and the end."""
    return [-(-p * units // parts) for p in range(parts + 1)]


def pack(keys: pa.Array, lines: pa.Array, units: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, size, block) of texts: their words, joined by blanks, and their keys."""
    n = len(lines)
    if n > 1 and lines.nbytes > PACK_BYTES:
        for a, b in ((0, n // 2), (n // 2, n)):
            yield from pack(keys.slice(a, b - a), pa.concat_arrays([lines.slice(a, b - a)]), units, parts)
        return
    split = pc.split_pattern(pc.fill_null(lines.cast(pa.large_string()), ""), " ")
    flat = split.flatten()
    text = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    given = pc.not_equal(flat, "")
    text, coded = text[given.to_numpy(zero_copy_only=False)], flat.filter(given).dictionary_encode()
    if not len(text):
        return
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    word, base = rank[coded.indices.to_numpy()], len(words) + 1
    if n > 1 and base * base * n >= 1 << 62:
        for a, b in ((0, n // 2), (n // 2, n)):
            yield from pack(keys.slice(a, b - a), lines.slice(a, b - a), units, parts)
        return
    # a term is its first word and the one behind it, counted from 1, or 0
    near = text[1:] == text[:-1]
    pairs = np.concatenate([word * base * n + text, (word[:-1] * base + word[1:] + 1)[near] * n + text[:-1][near]])
    pairs.sort()
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    tf, pairs = np.diff(np.append(starts, len(pairs))), pairs[starts]
    code, text = pairs // n, pairs % n
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    held, code = np.diff(np.append(starts, len(code))), code[starts]
    sums = np.array([0, *(zlib.crc32(w.encode()) for w in words.to_pylist())], np.int64)
    first, second = code // base, code % base
    unit = (sums[first + 1] * MIX + sums[second]) % units
    order = np.argsort(unit.astype(np.uint16) if units <= 1 << 16 else unit, kind="stable")
    unit, held, starts = unit[order], held[order], starts[order]
    blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    tails = pa.concat_arrays([pa.array([none]), pc.binary_join_element_wise(none, words, blank)])
    terms = pc.binary_join_element_wise(words.take(pa.array(first[order])), tails.take(pa.array(second[order])), none)
    letters = terms.buffers()[2]
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(terms).to_numpy())])
    after = np.cumsum(held)
    at = np.repeat(starts - (after - held), held) + np.arange(after[-1])
    tf, text, after = tf[at], text[at], np.concatenate([[0], after])
    in_unit = np.bincount(unit, minlength=units)
    begins, edges = np.concatenate([[0], np.cumsum(in_unit)]), _first_units(units, parts)
    for part, (lo, hi) in enumerate(zip(edges, edges[1:])):
        a, b = begins[lo], begins[hi]
        if a == b:
            continue
        x, y = after[a], after[b]
        kind, packed_keys = _keys_packed(keys, text[x:y])
        head = np.array([b - a, y - x, kind, len(packed_keys)], np.int64).tobytes()
        raw = b"".join((
            head, _planes(in_unit[lo:hi], np.uint32), _planes(np.diff(ends[a : b + 1]), np.uint32), _planes(held[a:b], np.uint32),
            _planes(tf[x:y], np.uint32), packed_keys, letters[ends[a] : ends[b]].to_pybytes(),
        ))
        yield part, len(raw), pa.compress(raw, "zstd", asbytes=True)


def packed(units: int, parts: int, rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (key, line): blocks as BLOCK_DDL has them. Parts are dealt out over ``rounds``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = list(pack(frame.column(0), frame.column(1), units, parts))
            part = np.array([p for p, _, _ in found], np.int32)
            sizes, blocks = pa.array([s for _, s, _ in found], pa.int64()), pa.array([b for _, _, b in found], pa.binary())
            names = ["round", "part", "size", "block"]
            yield pa.RecordBatch.from_arrays([pa.array(part % rounds, pa.int32()), pa.array(part), sizes, blocks], names=names)

    return run


class _Block:
    def __init__(self, raw: bytes, width: int, key: pa.DataType):
        read = _Reader(raw)
        terms, postings, kind, size = np.frombuffer(read.take(32), np.int64).tolist()
        in_unit = read.planes(width, np.uint32)
        self.lengths, self.held = (read.planes(terms, np.uint32).astype(np.int64) for _ in range(2))
        self.tf = read.planes(postings, np.uint32)
        self.keys = _keys_read(read.take(size), kind, postings, key)
        self.letters = read.take(len(raw) - read.at)
        self.terms = np.concatenate([[0], np.cumsum(in_unit, dtype=np.int64)])
        self.postings = np.concatenate([[0], np.cumsum(self.held)])[self.terms]
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])[self.terms]


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that together have at most SORTED_ROWS, or are single."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > SORTED_ROWS:
            yield at, i
            at, total = i, 0
        total += size
    yield at, len(sizes)


def unit_postings(blocks: list[_Block], unit: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(key, term, df, tf) of all postings of a unit, in batches, sorted by term; a unit of more than SORTED_ROWS is several sorted runs."""
    some = [b for b in blocks if b.terms[unit] < b.terms[unit + 1]]
    if not some:
        return
    letters = b"".join(b.letters[b.at[unit] : b.at[unit + 1]] for b in some)
    spans = [slice(b.terms[unit], b.terms[unit + 1]) for b in some]
    held = np.concatenate([b.held[x] for b, x in zip(some, spans)])
    ends = np.concatenate([[0], np.cumsum(np.concatenate([b.lengths[x] for b, x in zip(some, spans)]))])
    given = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
    order = pc.sort_indices(given.dictionary)
    terms = given.dictionary.take(order)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    rank = rank[given.indices.to_numpy()]
    df = np.bincount(rank, weights=held, minlength=len(order)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([x.stop - x.start for x in spans])])
    for lo, hi in _grouped([b.postings[unit + 1] - b.postings[unit] for b in some]):
        entries = slice(first[lo], first[hi])
        place = np.repeat(rank[entries], held[entries])
        sort = np.argsort(place, kind="stable")
        place = place[sort]
        keys = pa.concat_arrays([b.keys.slice(b.postings[unit], b.postings[unit + 1] - b.postings[unit]) for b in some[lo:hi]])
        tf = np.concatenate([b.tf[b.postings[unit] : b.postings[unit + 1]] for b in some[lo:hi]])
        for a in range(0, len(sort), OUT_ROWS):
            at = slice(a, a + OUT_ROWS)
            yield keys.take(pa.array(sort[at])), terms.take(pa.array(place[at])), df[place[at]], tf[sort[at]]


def unpacked(units: int, parts: int, buckets: int, key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (part, size, block), all blocks of a part in one task: (key, term, df, tf, bucket), a unit after the other, sorted by term."""
    edges = _first_units(units, parts)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = defaultdict(list)
        for frame in frames:
            for part, size, block in zip(*(frame.column(i).to_pylist() for i in range(3))):
                waiting[part].append((size, block))
        for part in sorted(waiting):
            lo, hi = edges[part], edges[part + 1]
            blocks = [_Block(pa.decompress(block, size, "zstd", asbytes=True), hi - lo, key) for size, block in waiting.pop(part)]
            if pa.types.is_integer(key):  # keys that ascend make small files
                blocks.sort(key=lambda b: b.keys[0].as_py() or 0)
            for unit in range(lo, hi):
                for keys, terms, df, tf in unit_postings(blocks, unit - lo):
                    columns = [keys, terms.cast(pa.string()), pa.array(df), pa.array(tf.astype(np.int32)), pa.array(np.full(len(df), unit % buckets, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "term", "df", "tf", "bucket"])

    return run
