"""Benchmark passages in documents: a random-walk embedding proposes places, edit distance decides.

The embedding reads a word sequence with a pointer that moves on or stays, at every step, by a random bit
of the word under it. Two sequences a few edits apart soon read the same words at the same steps again,
so their edit distance shows as Hamming distance of what was read. Each band samples three steps; windows
of a document and of a benchmark item that agree on a band of any of several independent embeddings are a
candidate. Document windows start at every fourth word and item windows at every word, so an
unchanged passage always has windows that coincide. Candidates are verified by exact edit distance.

Words that no item of a block holds are all one foreign word, and windows start only where a passage with enough
words of the items is: a place with a hit has, in some run of words around it, that many more of them than of foreign ones.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import strings, write_and_read

#: Items with fewer words are no evidence of a leak.
MIN_WORDS = 8
#: Words of an item that may be edited, in percent.
EDIT_PERCENT = 20
#: Independent embeddings, bands of each and window size, and steps sampled by a band.
EMBEDDINGS, BANDS, SAMPLES = 8, 4, 3
STRIDE = 4
#: Window sizes in words; an item takes the largest that fits it with STRIDE - 1 words to spare.
WINDOWS = (4, 8, 16, 32)
STEPS = 64
#: A bound of the windows of one item that are indexed, in even runs of STRIDE so that one of each run still coincides; None indexes all.
ITEM_WINDOWS = None
#: Words of the items whose windows are searched in one pass (an index takes about 2 kB a window), and of one item in one block.
BLOCK_WORDS = 30_000
CHUNK_WORDS = 8_192
#: A table of the low bits of the keys sifts the windows: 16 to 32 places a key, at most so many bits.
TABLE_BITS = 18
#: Value of words that no item holds. Those of items are odd, 0 is the pad.
FOREIGN = 2

_U = np.uint64


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ _U(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(29))


def _plan() -> list[dict[int, list[tuple[int, int, int]]]]:
    """For each embedding: step -> [(window size, band, factor)], one step from each third of twice the window."""
    draw = np.random.RandomState(20)
    plan = []
    for _ in range(EMBEDDINGS):
        steps: dict[int, list[tuple[int, int, int]]] = {}
        for w in WINDOWS:
            reach = min(2 * w, STEPS)
            for band in range(BANDS):
                for i in range(SAMPLES):
                    step = int(draw.randint(i * reach // SAMPLES, (i + 1) * reach // SAMPLES))
                    steps.setdefault(step, []).append((w, band, int(draw.randint(0, 1 << 62)) * 2 + 1))
        plan.append(steps)
    return plan


PLAN = _plan()


def walk(words: np.ndarray, starts: np.ndarray, sizes: set[int]):
    """Yield (window size, embedding, band, keys, valid) for walks from ``starts``; ``words`` ends with STEPS pads."""
    for e, steps in enumerate(PLAN):
        bits = _mixed(words, e)
        at = starts.copy()
        keys: dict[tuple[int, int], np.ndarray] = {}
        valid: dict[tuple[int, int], np.ndarray] = {}
        last = max(step for step, uses in steps.items() if any(w in sizes for w, _, _ in uses))
        with np.errstate(over="ignore"):
            for step in range(last + 1):
                uses = [u for u in steps.get(step, ()) if u[0] in sizes]
                if uses:
                    read = words[at]
                    seen = (read & _U(1)) != 0
                    for w, band, factor in uses:
                        if (w, band) in keys:
                            keys[w, band] += read * _U(factor)
                            valid[w, band] = valid[w, band] & seen
                        else:
                            keys[w, band] = read * _U(factor)
                            valid[w, band] = seen
                at += ((bits[at] >> _U(step)) & _U(1)).astype(at.dtype)
            for (w, band), key in keys.items():
                yield w, e, band, key ^ (key >> _U(31)), valid[w, band]


def joined_words(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences one after the other, STEPS pads after each, and where each starts."""
    pad = np.zeros(STEPS, np.uint64)
    lengths = np.array([len(p) + STEPS for p in parts], np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.concatenate([x for p in parts for x in (p, pad)]) if parts else pad, begins


class Pattern:
    """Edit distance between an item and the best place in a sequence, a bit for each item word."""

    def __init__(self, words: list[int]):
        self.n = len(words)
        self.ahead: dict[int, int] = {}
        self.back: dict[int, int] = {}
        for i, w in enumerate(words):
            self.ahead[w] = self.ahead.get(w, 0) | 1 << i
            self.back[w] = self.back.get(w, 0) | 1 << (self.n - 1 - i)

    @staticmethod
    def _scan(masks: dict[int, int], n: int, text: list[int], anchored: bool) -> tuple[int, int]:
        """Smallest distance of the whole item to a part of ``text`` that ends, first, after so many words; ``anchored``: that starts it."""
        full, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score = full, 0, n
        best, end = n, 0
        for at, word in enumerate(text, 1):
            if not best:
                break
            eq = masks.get(word, 0)
            x = eq | minus
            d = ((((eq & plus) + plus) ^ plus) | eq) & full
            hp = minus | (~(d | plus) & full)
            hn = plus & d
            score += 1 if hp & top else -1 if hn & top else 0
            hp = (hp << 1 | anchored) & full
            hn = hn << 1 & full
            plus = hn | (~(x | hp) & full)
            minus = hp & x
            if score < best:
                best, end = score, at
        return best, end

    def may_hold(self, text: list[int], least: int, length: int) -> bool:
        """Whether some ``length`` words in a row have ``least`` words of the item."""
        own = np.fromiter((w in self.ahead for w in text), np.int64, len(text))
        upto = np.concatenate([[0], np.cumsum(own)])
        return bool((upto[min(length, len(text)) :] - upto[: max(1, len(upto) - length)]).max() >= least)

    def best(self, text: list[int]) -> tuple[int, int, int]:
        """(distance, first word, word after the last) of the closest part of ``text``, the earliest to end of equals."""
        distance, end = self._scan(self.ahead, self.n, text, False)
        _, length = self._scan(self.back, self.n, text[max(0, end - self.n - distance) : end][::-1], True)
        return distance, end - length, end


def offsets(last: int) -> np.ndarray:
    """Starts of the indexed windows of an item, from 0 to ``last``."""
    runs = last // STRIDE + 1
    most = runs if ITEM_WINDOWS is None else ITEM_WINDOWS // STRIDE
    chosen = np.unique(np.linspace(0, runs - 1, min(runs, most)).astype(np.int64)) * STRIDE
    every = (chosen[:, None] + np.arange(STRIDE)[None, :]).ravel()
    return every[every <= last]


def allowed_edits(n: int) -> int:
    return n * EDIT_PERCENT // 100


def live_places(words: np.ndarray, excess: int) -> np.ndarray:
    """Whether a place lies in a run of words, within its document, with ``excess`` more words of items than foreign ones.

    A part of a text that is s replacements, d deletions and i insertions from an item of n words holds n - s - d words of it and s + i others,
    so the excess is at least n - 2 (s + d + i), and every place of the part is live.
    """
    pads = words == 0
    gain = np.where(pads, -(len(words) + 1), np.where((words & _U(1)) != 0, 1, -1)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(gain)])
    before = np.minimum.accumulate(upto[:-1])
    after = np.maximum.accumulate(upto[:0:-1])[::-1]
    return ~pads & (after - before >= excess)


class Index:
    """Band tables of a bounded block of items; sent to the tasks whole.

    An item is (id, text) or (id, text, key, chunks): of an item with chunks only the windows that start in them are indexed.
    """

    def __init__(self, items: list[tuple]):
        parts, self.ids, self.keys, self.words, chunks = [], [], [], [], []
        self.vocabulary: dict[bytes, int] = {}
        for at, (item, text, *more) in enumerate(items):
            words = split_words(text or "")
            if len(words) >= MIN_WORDS:
                for w in words:
                    if w not in self.vocabulary:
                        self.vocabulary[w] = word_hash(w)
                parts.append(self.hashes(words))
                self.ids.append(item)
                self.keys.append(more[0] if more else at)
                self.words.append(parts[-1].tolist())
                chunks.append(more[1] if more else None)
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, ...]] = {}
        self.sizes: set[int] = set()
        #: by which the words of an item exceed the foreign ones wherever it is found
        self.excess = min((len(p) - 2 * allowed_edits(len(p)) for p in parts), default=0)
        self._patterns: dict[int, Pattern] = {}
        all_words, begins = joined_words(parts)
        for w in WINDOWS:
            mine = [i for i, p in enumerate(parts) if max(x for x in WINDOWS if x + STRIDE - 1 <= len(p)) == w]
            own = []
            for i in mine:
                starts = offsets(len(parts[i]) - w)
                own.append(starts if chunks[i] is None else starts[np.isin(starts // CHUNK_WORDS, chunks[i])])
            if not sum(map(len, own)):
                continue
            self.sizes.add(w)
            item = np.concatenate([np.full(len(o), i) for i, o in zip(mine, own)])
            offset = np.concatenate(own)
            for _, e, band, key, valid in walk(all_words, begins[item] + offset, {w}):
                order = np.argsort(key[valid], kind="stable")
                keys = key[valid][order]
                seen = np.zeros(1 << min(TABLE_BITS, (16 * len(keys)).bit_length()), bool)
                seen[(keys & _U(len(seen) - 1)).astype(np.int64)] = True
                self.tables[w, e, band] = keys, item[valid][order], offset[valid][order], seen

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(FOREIGN)), np.uint64, len(words))

    def pattern(self, i: int) -> Pattern:
        if i not in self._patterns:
            self._patterns[i] = Pattern(self.words[i])
        return self._patterns[i]

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int, int]]]:
        """For each text: (item id, its words, distance, first word, word after the last, key) of every item within the edit limit."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        docs = [self.hashes(split_words(t)) for t in texts]
        if self.sizes and docs:
            for d, i, places in self._candidates(docs):
                self._verify(i, places, docs[d], found[d])
        return [[(self.ids[i], len(self.words[i]), *hit, self.keys[i]) for i, hit in sorted(hits.items())] for hits in found]

    def _candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
        """(document, item, places where the item may start) of windows that agree on a band, places in order."""
        words, begins = joined_words(docs)
        live = live_places(words, self.excess)
        inside = [np.flatnonzero(live[b : b + len(d) : STRIDE]) * STRIDE for b, d in zip(begins, docs)]
        doc = np.repeat(np.arange(len(docs)), [len(x) for x in inside])
        inside = np.concatenate(inside)
        pairs = []
        for w, e, band, key, valid in walk(words, begins[doc] + inside, self.sizes):
            if (w, e, band) not in self.tables:
                continue
            keys, item, offset, seen = self.tables[w, e, band]
            near = np.flatnonzero(seen[(key & _U(len(seen) - 1)).astype(np.int64)] & valid)
            left = np.searchsorted(keys, key[near], "left")
            count = np.searchsorted(keys, key[near], "right") - left
            if count.any():
                near, left, count = near[count > 0], left[count > 0], count[count > 0]
                row = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
                near = np.repeat(near, count)
                pairs.append(np.unique(np.stack([doc[near], item[row], inside[near] - offset[row]], 1), axis=0))
        if not pairs:
            return []
        rows = np.unique(np.concatenate(pairs), axis=0)
        edges = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        return [(int(own[0, 0]), int(own[0, 1]), own[:, 2]) for own in np.split(rows, edges)]

    def _verify(self, i: int, places: np.ndarray, words: np.ndarray, hits: dict[int, tuple[int, int, int]]) -> None:
        """The closest part near any of the places. Places whose parts of the text overlap are searched as one."""
        n, pattern = len(self.words[i]), self.pattern(i)
        most = allowed_edits(n)
        for run in np.split(places, np.flatnonzero(np.diff(places) > n + 2 * most) + 1):
            low, high = max(0, int(run[0]) - most), max(0, int(run[-1]) + n + most)
            part = words[low:high].tolist()
            if not pattern.may_hold(part, n - most, n + most):
                continue
            distance, start, end = pattern.best(part)
            if distance <= most:
                hit = (distance, low + start, low + end)
                if i not in hits or hit < hits[i]:
                    hits[i] = hit


HIT_FIELDS = ("item_id", "n_words", "distance", "start", "end", "key")
HITS = f"array<struct<{','.join(f'{n}:bigint' for n in HIT_FIELDS)}>>"


def hits_column(spark, index: Index, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(index)

    def search(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in HIT_FIELDS]))
        return pa.array([[dict(zip(HIT_FIELDS, h)) for h in hits] for hits in shared.value.search(strings(column))], kind)

    # once per text: else a filter on the hits would search anew
    return F.arrow_udf(search, HITS).asNondeterministic()(text)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``_tw_hits``: the items found in each whole text within the edit limit, and where.

    Items are searched in blocks of about ``BLOCK_WORDS`` words, so what is sent to the tasks is bounded; the windows of an item of more than ``CHUNK_WORDS`` words
    spread over blocks. Nothing is shuffled. Null or empty texts hold nothing; items of fewer than MIN_WORDS words, null ones too, are not
    searched; equal items are all reported; repeated rows are searched each; other columns pass through, but none may be named ``_tw_hits``; empty tables give no hits.
    """
    if "_tw_hits" in docs.columns:
        raise ValueError("a column named like the result: _tw_hits")
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    items = items.withColumns({"key": F.monotonically_increasing_id(), "words": F.size(F.split("text", r"[\x20\x09-\x0D]+"))})
    items = write_and_read(items, "items")
    total, longest = items.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK_WORDS))
    chunks = items.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.col("words") / CHUNK_WORDS))))
    out = docs.withColumn("_tw_hits", F.lit(None).cast(HITS)) if not total else docs
    for block in range(blocks if total else 0):
        mine = chunks.where(F.pmod(F.xxhash64("key", "chunk"), F.lit(blocks)) == block)
        own = mine.groupBy("key", "item_id", "text").agg(F.collect_list("chunk").alias("chunks")).orderBy("item_id", "text", "key").collect()
        index = Index([(r.item_id, r.text, r.key, r.chunks) for r in own])
        hits = hits_column(docs.sparkSession, index, F.col(text))
        out = out.withColumn("_tw_hits", hits if block == 0 else F.concat("_tw_hits", hits))
    if blocks > 1 and longest >= CHUNK_WORDS:  # an item whose windows lie in several blocks was searched in each
        hits = F.col("_tw_hits")
        keys = F.array_distinct(F.transform(hits, lambda h: h["key"]))
        out = out.withColumn("_tw_hits", F.transform(keys, lambda k: F.array_min(F.filter(hits, lambda h: h["key"] == k))))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item found in it."""
    rows = with_hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark)
    return rows.select("doc_id", F.inline("_tw_hits")).select(
        "doc_id", "item_id", "n_words", "distance", F.col("start").alias("start_word"), F.col("end").alias("end_word")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their columns unchanged."""
    rows = with_hits(docs, benchmark, text)
    return rows.where(F.coalesce(F.size("_tw_hits"), F.lit(0)) <= 0).select(*(F.col(c) for c in docs.columns))
