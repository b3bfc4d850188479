"""Memory of the Python side of tasks: it is bounded by a block of bytes and of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from weftline.llm import quality, words


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts(n: int, size: int) -> list[str]:
    rng = np.random.default_rng(3)
    return [" ".join(f"w{x}" for x in rng.integers(0, 30_000, size)) for _ in range(n)]


def test_blocks_of_quality_hold_few_texts_however_short():
    many = pa.array(["ab cd"] * 10_000)  # 50 kB were one block and 400 MB of terms
    assert peak_mb(lambda: [None for _ in quality.term_rows(many)]) < 60
    spans = [(first, end) for first, end, _ in quality.term_rows(many)]
    assert spans[0][0] == 0 and spans[-1][1] == 10_000
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_a_batch_of_long_texts_is_read_in_small_blocks():
    column = pa.array(texts(40, 20_000))
    assert column.nbytes > 4 << 20
    assert peak_mb(lambda: [None for _ in quality.term_rows(column)]) < 45


def test_terms_do_not_depend_on_the_blocks_they_are_read_in(monkeypatch):
    column = pa.array([*texts(300, 300), "", None, *texts(3, 90_000)])
    small = np.concatenate([rows for *_, rows in quality.term_rows(column)])
    monkeypatch.setattr(words.text_blocks, "__defaults__", (1 << 30,))
    assert np.array_equal(np.concatenate([rows for *_, rows in quality.term_rows(column)]), small)
