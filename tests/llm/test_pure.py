"""The parts that work on one text, page or sequence, against brute force."""

import base64
import hashlib
import io
import random
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import decontam, htmltext, linededup, neardup, packing, quality, warc


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pattern_finds_the_closest_part():
    draw = random.Random(1)
    for _ in range(300):
        item = [draw.randint(1, 4) for _ in range(draw.randint(1, 9))]
        text = [draw.randint(1, 4) for _ in range(draw.randint(0, 14))]
        want = min(edit(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        distance, start, end = decontam.Pattern(item).best(text)
        assert distance == want
        assert edit(item, text[start:end]) == distance


def prose(draw, n):
    return [draw.choice(["the", "of", "and", "in"]) if draw.random() < 0.3 else f"w{draw.randint(1, 3000)}" for _ in range(n)]


@pytest.mark.parametrize("edits,least", [(0.0, 1.0), (0.05, 0.98), (0.1, 0.95), (0.2, 0.9)])
def test_recall_of_the_embedding(edits, least):
    """Planted copies with so many random edits that stay within the limit."""
    draw = random.Random(2)
    items = [(i, " ".join(prose(draw, draw.randint(15, 60)))) for i in range(150)]
    index, found, planted = decontam.Index(items), 0, 0
    for i, text in items:
        words = text.split()
        copy = list(words)
        for _ in range(int(len(words) * edits)):
            at = draw.randrange(len(copy))
            kind = draw.random()
            if kind < 0.5:
                copy[at] = f"x{draw.randint(1, 999)}"
            elif kind < 0.75:
                del copy[at]
            else:
                copy.insert(at, f"x{draw.randint(1, 999)}")
        doc = prose(draw, draw.randint(0, 90)) + copy + prose(draw, draw.randint(0, 90))
        hits = {h[0]: h for h in index.search([" ".join(doc)])[0]}
        planted += 1
        found += i in hits
        if edits == 0:
            assert hits[i][2] == 0 and doc[hits[i][3] : hits[i][4]] == words
    assert found >= least * planted


def test_search_agrees_with_brute_force():
    draw = random.Random(3)
    items = [(i, " ".join(prose(draw, n))) for i, n in enumerate([3, 8, 9, 11, 20, 40, 70])] + [(50, ""), (51, None)]
    texts = []
    for i, text in items[1:7]:
        w = text.split()
        texts.append(" ".join(prose(draw, 7) + w + prose(draw, 5)))
        texts.append(" ".join(w[: len(w) // 2]))  # half an item is none
        texts.append(" ".join(w))
    texts += ["", "the of and in " * 60, items[0][1]]
    got = decontam.Index(items).search(texts)
    for text, hits in zip(texts, got):
        words = text.split()
        want = {}
        for i, item in items:
            w = (item or "").split()
            if len(w) < decontam.MIN_WORDS:
                continue
            distance = decontam.Pattern(w).best(words)[0]
            if distance <= len(w) * decontam.EDIT_PERCENT // 100:
                want[i] = distance
        assert {h[0]: h[2] for h in hits} == want


def test_long_items_are_found_with_fewer_windows(monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_WINDOWS", 24)
    assert decontam.offsets(1000).tolist()[:5] == [0, 1, 2, 3, 200] and len(decontam.offsets(1000)) <= 24
    assert decontam.offsets(9).tolist() == list(range(10))
    draw = random.Random(21)
    items = [(i, " ".join(prose(draw, n))) for i, n in enumerate([400, 90, 2000])]
    index = decontam.Index(items)
    for i, text in items:
        for lead in range(9):
            doc = prose(draw, lead) + text.split() + prose(draw, 5)
            assert [h[0] for h in index.search([" ".join(doc)])[0]] == [i]


def test_minimal_perfect_hash():
    draw = np.random.RandomState(4)
    for n in (0, 1, 2, 500, 20_000):
        keys = np.unique(draw.randint(0, 1 << 62, n, np.uint64))
        levels = linededup.build_mph(keys)
        slots = linededup.probe_mph(levels, linededup.level_ranks(levels), keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 28, 6])
def test_alignment_is_longest(cells, monkeypatch):
    monkeypatch.setattr(htmltext, "LCS_CELLS", cells)
    draw = random.Random(5)
    for _ in range(500):
        a = [draw.randint(1, 5) for _ in range(draw.randint(0, 12))]
        b = [draw.randint(1, 5) for _ in range(draw.randint(0, 12))]
        at = htmltext.aligned(a, b)
        assert at == sorted(set(at)) and len(at) == lcs(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in at))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="single-post">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First <b>bold<br>line &eacute;&#33;<p>Second
   one<div class="ad">Buy</div><ul><li>one<li>two</ul><aside>See also</aside><form><p>Mail?</p></form>
<table><tr><td>a<td>b<tr><td>c</table><pre>x
  y</pre></article><section id="comments"><article class="comment"><p>Nice</p></article></section></main>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_lines_of_a_page():
    got = [line for zone, line in htmltext.page_lines(PAGE) if zone == htmltext.ARTICLE]
    assert got == ["Title & more", "First bold line é!", "Second one", "one", "two", "a", "b", "c", "x y"]
    assert htmltext.page_lines("") == []
    assert [x[1] for x in htmltext.page_lines("plain <b>text")] == ["plain text"]
    assert [x[1] for x in htmltext.page_lines("<p>cut &am")] == ["cut &am"]


def repeats(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(covered)


def test_text_features():
    draw = random.Random(6)
    for _ in range(200):
        words = [draw.choice(["a", "bé", "c#", "日本"]) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.7:
            words = words + words[3:20] + words[:5]
        text = ""
        for w in words:
            text += w + draw.choice([" ", "\n", "\t ", "\x0b", " ", "\n\n"])
        own = text.encode().split()
        lines = [line for line in text.split("\n") if line.encode().split()]
        n, chars, symbols, n_lines, dup, rep, stutter = quality.text_features(text)
        assert (n, chars) == (len(own), sum(len(w.decode()) for w in own))
        assert symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert n_lines == len(lines) and dup == len(lines) - len(set(lines))
        assert rep == repeats(own) and stutter == sum(x == y for x, y in zip(own, own[1:]))


def test_minhash_follows_similarity():
    draw = random.Random(7)
    for share in (0.95, 0.8, 0.5):
        n = 400
        common = [draw.getrandbits(64) for _ in range(int(n * share))]
        a = np.unique(np.array(common + [draw.getrandbits(64) for _ in range((n - len(common)) // 2)], np.uint64))
        b = np.unique(np.array(common + [draw.getrandbits(64) for _ in range((n - len(common)) // 2)], np.uint64))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = neardup.minhash(a), neardup.minhash(b)
        assert abs((x == y).mean() - true) < 0.12
        z = sum(int(v).bit_count() for v in (neardup.odd_sketch(x) ^ neardup.odd_sketch(y)).view(np.uint64))
        estimate = 1 + neardup.BITS / (4 * neardup.SAMPLES) * np.log(max(1e-9, 1 - 2 * z / neardup.BITS))
        if true > 0.7:
            assert abs(estimate - true) < 0.15 and z <= neardup.most_bits_apart(neardup.LEAST_ESTIMATE)
            assert (neardup.band_keys(x) == neardup.band_keys(y)).any()


def test_shingle_sets():
    assert len(neardup.shingle_set("", 2)) == 0 and len(neardup.shingle_set(" \t", 2)) == 0
    assert len(neardup.shingle_set("One", 2)) == 1
    assert neardup.shingle_set("A b\nC", 2).tolist() == neardup.shingle_set("a B c", 2).tolist()
    assert len(neardup.shingle_set("a b a b a b", 2)) == 2
    assert len(neardup.shingle_set("a b c", 5)) == 1
    assert neardup.shingle_set("É x", 2).tolist() != neardup.shingle_set("é x", 2).tolist()


def test_archive_round_trip():
    draw = random.Random(8)
    for n in (1, 2, 300):
        records = [
            warc.build_record(i, f"http://h/{i}\r\nä", ("<p>" + " ".join(prose(draw, draw.randint(0, 400)))).encode(), None, True) for i in range(n)
        ]
        records.append(warc.build_record(None, None, b"", 3, False))
        stream = io.BytesIO()
        stream.close, data = (lambda: None), stream
        writer = warc.ArchiveWriter(stream)
        for r in records:
            writer.add(r)
        writer.close()
        assert int.from_bytes(data.getvalue()[:4], "little") == 0x184D2A5D
        for chunk in (1 << 20, 7):
            assert list(warc.read_archive(io.BytesIO(data.getvalue()), chunk)) == records
    fields, block = warc.parse_record(records[0])
    payload = block.partition(b"\r\n\r\n")[2]
    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields, block = warc.parse_record(records[-1])
    assert fields["WARC-Type"] == "revisit" and block.endswith(b"\r\n\r\n") and fields["WARC-Refers-To"] == warc.record_uri(3, warc.base32_digest(b""))


def test_packer_keeps_every_token_once():
    draw = random.Random(9)
    for trial in range(60):
        packer, lengths, out = packing.Packer(), [], []
        for row in range(draw.choice([1, 5, 200])):
            n = draw.choice([1, draw.randint(1, 300), draw.randint(1, 9000), 2048, 1024])
            lengths.append(n)
            packer.add(row, n)
            if draw.random() < 0.3:
                packer.pack(False)
        packer.pack(True)
        out = packer.done
        for row, n in enumerate(lengths):
            at = 0
            for start, length in sorted((s, k) for r, s, k, *_ in out if r == row):
                assert start == at
                at += length
            assert at == n
        sequences = {}
        for _, _, length, sequence, offset, tier in out:
            used = sequences.setdefault(sequence, [0, tier])
            assert used[0] == offset and used[1] == tier
            used[0] += length
        assert all(used <= tier for used, tier in sequences.values())
        assert sum(used != tier for used, tier in sequences.values()) <= 1


SPACES = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\xa0", "\x85", " ", "　", "\x1c", "​", "  "]


def test_ids_around_any_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewell.llm.queries import ranks_path

    library, tokens, draw = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), packing.Tokens(ranks_path()), random.Random(1)
    texts = ["a\n\xa0\xa0b", "\xa0", "x \xa0y\n z", " " * 30_000 + "b", "a" + "\n" * 20_000, "a" + " \n" * 9_000 + " b<|endoftext|> "]
    for _ in range(8000):
        texts.append("".join(draw.choice(SPACES) if draw.random() < 0.45 else draw.choice(["a", "é", "b1", "'s", "x.", "漢", "<|endoftext|>"]) for _ in range(draw.randint(0, 12))))
    for text in texts:
        assert tokens.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_very_long_run_of_spaces_packs():
    from tidewell.llm.queries import ranks_path

    ids = packing.Tokens(ranks_path()).encode("a" + " " * 3_000_000 + "b")
    assert len(ids) == 3_000_001


def live_by_force(words, excess):
    out = np.zeros(len(words), bool)
    for a in range(len(words)):
        total = 0
        for b in range(a, len(words)):
            if not words[b]:
                break
            total += 1 if words[b] & 1 else -1
            if total >= excess:
                out[a : b + 1] = True
    return out


def test_live_places():
    draw = np.random.RandomState(6)
    for _ in range(200):
        words = draw.choice([0, decontam.FOREIGN, 3, 5], draw.randint(1, 60), p=[0.05, 0.4, 0.3, 0.25]).astype(np.uint64)
        excess = int(draw.randint(1, 6))
        assert (decontam.live_places(words, excess) == live_by_force(words.tolist(), excess)).all()


def test_long_edited_items_are_found():
    """Items of 6,000 words, all windows of which are indexed, and copies with edits in up to 18 % of the words."""
    draw = random.Random(8)
    items = [(i, " ".join(prose(draw, 6000))) for i in range(4)]
    index, found, planted = decontam.Index(items), 0, 0
    for edits in (0.05, 0.18):
        for i, text in items:
            copy = text.split()
            for _ in range(int(6000 * edits)):
                at, kind = draw.randrange(len(copy)), draw.random()
                if kind < 0.5:
                    copy[at] = f"x{draw.randint(1, 999)}"
                elif kind < 0.75:
                    del copy[at]
                else:
                    copy.insert(at, f"x{draw.randint(1, 999)}")
            hits = index.search([" ".join(prose(draw, 300) + copy + prose(draw, 300))])[0]
            planted += 1
            found += i in [h[0] for h in hits]
    assert found >= 0.9 * planted
