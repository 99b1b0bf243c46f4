"""What the Python workers hold: slices by bytes, and memory given back after a task."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from lossledger.llm import langid
from lossledger.llm.common import portions, trimmed
from lossledger.llm.sentencepiece_codec import forgetting


def own_mb():
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_portions_keep_all_rows_in_order_and_follow_bytes():
    texts = ["a" * 30, None, "", "é" * 40, "b" * 500, "", "c"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "text"])
    got = list(portions(iter([batch, batch.slice(0, 0), batch.slice(3, 4)]), 1, most=100))
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist() + batch.slice(3, 4).to_pylist()
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 100 for b in got)
    assert len(got) < len(texts)
    twice = pa.RecordBatch.from_arrays([pa.array([b"x" * 60, b"y"]), pa.array([b"z" * 60, None])], names=["a", "b"])
    assert [b.num_rows for b in portions(iter([twice]), 0, 1, most=100)] == [1, 1]


@pytest.mark.parametrize("wrap", [trimmed, lambda rows: forgetting(type("Model", (), {"words": {}, "atoms": {}}), rows)])
def test_a_task_gives_back_what_it_does_not_use(wrap):
    kept = []

    def rows():
        texts = [str(k) * 300 for k in range(100_000)]
        kept.extend(texts[::100])  # what stays lies between what goes
        yield pa.RecordBatch.from_arrays([pa.array([len(texts)])], names=["n"])

    before = own_mb()
    assert [b.column(0)[0].as_py() for b in wrap(rows())] == [100_000]
    assert own_mb() - before < 40  # without: the whole 150 MB stay


def test_texts_are_read_by_slices(spark, monkeypatch):
    """A worker turns no more than some megabytes of a batch into Python's texts at once."""
    most = []
    scores = langid.Scorer.scores
    monkeypatch.setattr(langid.Scorer, "scores", lambda self, texts: most.append(sum(map(len, texts))) or scores(self, texts))
    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text " * 500] * 2_000)], names=["text"])

    class Frame:
        columns, schema = ["text"], "text string"

        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    model = type("Broadcast", (), {"value": ("slices", ("en",), {p: (0.1,) for p in ("\u2581", "some", "words")})})
    monkeypatch.setattr(langid, "fitted", lambda *a: model)
    out = langid.keep_identified(Frame(), "model")
    assert sum(b.num_rows for b in out) == 2_000 and sum(most) == 2_000 * 10_500
    assert max(most) <= 1 << 22 and max(b.nbytes for b in out) <= 5 << 20
