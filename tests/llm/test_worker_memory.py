"""What a worker holds is bounded by a piece of text, not by a batch of rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from daygrid.llm import bpe, shingles
from daygrid.llm.shingles import shingle_sets


def _texts(n, words=250):
    draw = np.random.default_rng(5).integers(0, 10_000_000, (n, words)).astype(str)
    return pa.array([" ".join(row) for row in draw])


def test_sets_of_a_large_batch_take_little_memory():
    texts = _texts(4000)  # 8 MB
    shingles._POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))  # as in a new worker
    tracemalloc.start()
    try:
        assert sum(len(s) for s in shingle_sets(texts, 5)) == 4000 * 246
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 8e6 and peak < 32e6  # 42 and 86 MB with chunks of 2 MB


def test_pieces_hold_all_rows_in_order():
    texts = ["", None, "a b", "x " * 400, None, "ü" * 30, "c"] * 9
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(t))), pa.array(t, pa.string())], ["doc_id", "text"])
               for k, t in ((0, texts[:20]), (20, texts[20:21]), (21, []), (21, texts[21:]))]
    pieces = list(shingles.text_pieces(batches, 1, 64))
    assert [r for p in pieces for r in p.column(0).to_pylist()] == list(range(63))
    assert [r for p in pieces for r in p.column(1).to_pylist()] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 64 for p in pieces)


def test_sets_do_not_depend_on_the_cut():
    texts = _texts(40, 30).to_pylist() + [None, "", "one", "w " * 900]
    whole = [s.tolist() for s in shingle_sets(pa.array(texts), 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert whole == [s.tolist() for p in shingles.text_pieces([batch], 0, 300) for s in shingle_sets(p.column(0), 5)]


def test_remembered_words_are_bounded(tmp_path, monkeypatch):
    pytest.importorskip("public_tokenizers")
    texts = [f"the cat {i} word{i} the{i}x" for i in range(300)]
    path = f"{tmp_path}/lexicon.bin"
    bpe.write_lexicon(path, [b"the", b" cat", b" the"], bpe.Merges(bpe.tokenizer_path()))
    free = bpe.Lexicon(path)
    ids = free.encode(texts)
    monkeypatch.setattr(bpe, "CACHED", 40)
    tight = bpe.Lexicon(path)
    for at in range(0, 300, 5):
        assert tight.encode(texts[at:at + 5]) == ids[at:at + 5]
        assert len(tight.known) <= 40 and {"the", " cat"} <= set(tight.known)  # words of the lexicon are not looked up again
    assert len(free.known) > 600
