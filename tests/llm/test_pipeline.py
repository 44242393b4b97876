"""The pipeline: every stage against brute force on its own input, and the run as a whole."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from test_operators import groups_by_force, without_shared_lines
from tidewell.llm import decontam, linededup, quality
from tidewell.llm.common import write_and_read
from tidewell.tables import load


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output of every stage, as rows."""
    docs, out = load(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = write_and_read(stage(spark, docs, folder), "stage")
        out.append((name, docs, done))
        docs = done
    return {name: (before.collect(), after.collect(), before.columns, after.columns) for name, before, after in out}


def test_order_and_columns(stages):
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    for name, (_, after, columns, kept) in stages.items():
        assert after
        if name != "packing":
            assert columns == kept == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(stages):
    before, after, *_ = stages["quality rules"]
    kept = {r.doc_id for r in after}
    assert Counter(after) <= Counter(before) and 0 < len(after) < len(before)
    for r in before:
        n, _, symbols, _, _, repeat, stutter = quality.text_features(r.text or "")
        if n < 20 or 100 * repeat > 30 * n or symbols * 4 > n or stutter * 2 > n:
            assert r.doc_id not in kept
    plain = [r.doc_id for r in before if (lambda f: f[0] >= 40 and not (f[2] or f[4] or f[5] or f[6]))(quality.text_features(r.text or ""))]
    assert len(set(plain) - kept) <= len(plain) // 50


def test_line_stage(stages):
    before, after, *_ = stages["line dedup"]
    want = without_shared_lines([(r.doc_id, r.text) for r in before])
    assert sum(dropped for _, _, dropped, _ in want.elements()) > 0
    left = defaultdict(int)
    for doc, lines, dropped, _ in want:
        left[doc] = lines - dropped
    for r in after:
        assert r.n_chars == len(r.text) and len(r.text.split("\n")) == max(1, left[r.doc_id])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)


def test_near_stage(stages):
    before, after, *_ = stages["near dedup"]
    want = {doc for doc, _, _, kept in groups_by_force([(r.doc_id, r.text) for r in before], 5) if kept}
    assert sorted(r.doc_id for r in after) == sorted(want)
    assert Counter(after) <= Counter(before)


def test_decontamination_stage(spark, folder, stages):
    before, after, *_ = stages["decontamination"]
    items = [decontam.Pattern(w) for w in (r.text.lower().split() for r in load(spark, folder, "benchmark").collect()) if len(w) >= decontam.MIN_WORDS]

    def leaks(text):
        words = [w.decode() for w in (text or "").encode().lower().split()]
        return any(p.best(words)[0] <= p.n * decontam.EDIT_PERCENT // 100 for p in items)

    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not leaks(r.text))


def test_packing_stage(stages):
    before, after, *_ = stages["packing"]
    tokens = {r.doc_id: r.doc_tokens for r in after}
    assert set(tokens) == {r.doc_id for r in before}
    assert sum(r.length for r in after) == sum(tokens.values())


def test_run(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).collect()
    tokens = Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({r.doc_id: r.doc_tokens for r in stages["packing"][1]})
    assert corpus_pipeline.ORACLE_SQL is None and linededup.MIN_KEY == 10
