import tracemalloc

import numpy as np
import pyarrow as pa

from codequarry.llm import words


def test_memory_of_hashing_is_bounded_and_pieces_change_nothing(monkeypatch):
    texts = pa.array([" ".join(f"w{i * j % 977}é" for j in range(300)) for i in range(1500)] + ["x y\tz " * 100_000, None, "", " "])
    tracemalloc.start()
    got = [(r, int(h.sum()) if len(h) else 0, len(h), int(e.sum())) for r, h, _, e in words.hashed_words(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    monkeypatch.setattr(words, "SEGMENT", 1 << 16)
    assert got == [(r, int(h.sum()) if len(h) else 0, len(h), int(e.sum())) for r, h, _, e in words.hashed_words(texts)]
    assert peak < 24 << 20, peak
    assert [r for r, *_ in got] == list(range(len(texts))) and np.unique([r for r, *_ in got]).size == len(texts)
