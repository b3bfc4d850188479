"""Memory of the context tree in tasks: bounded by a block of texts and a piece of grams."""

import tracemalloc

import numpy as np
import pyarrow as pa

from weftline.llm import ctw, words


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


def test_counts_of_words_and_grams_take_little_memory():
    column = pa.array(texts(600, 3_000))
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    assert column.nbytes > 9 << 20  # words of 12 MB were counted at once, in 500 MB
    for of, name in ((ctw.text_words, "word"), (ctw.text_grams, "gram")):
        assert peak_mb(lambda: [None for _ in ctw._counter(of, name)(iter([batch]))]) < 80
    plain = np.unique(ctw.text_words(*next(words.text_blocks(column, 1 << 30))[2:])[0], return_counts=True)
    got = pa.Table.from_batches(ctw._counter(ctw.text_words, "word")(iter([batch])))
    assert np.array_equal(got["word"].to_numpy(), plain[0]) and np.array_equal(got["n"].to_numpy(), plain[1])


def test_grams_in_pieces_weigh_the_same():
    data = np.frombuffer(" ".join(texts(3, 3_000)).encode(), np.uint8)
    grams, n = np.unique(ctw.text_grams(data, np.array([0, len(data)]))[0], return_counts=True)
    known = np.where(np.arange(len(grams)) % 3 > 0, n, 0)
    sure, rest = np.zeros((1, 255)), np.ones((1, 255))
    top = np.zeros(len(grams), np.int64)
    whole = ctw.predict(grams, known, sure, rest, top)
    cuts = list(ctw.pieces(grams))
    assert len(cuts) > 2 and sum(c.stop - c.start for c in cuts) == len(grams)
    parts = [ctw.predict(grams[c], known[c], sure, rest, top[c]) for c in cuts]
    assert np.array_equal(np.concatenate(parts), whole)
    nodes = [ctw.up(grams[c], n[c])[ctw.NEAR] for c in cuts]
    keys, _, _, weights, counts = ctw.up(grams, n)[ctw.NEAR]
    assert np.array_equal(np.concatenate([x[0] for x in nodes]), keys)
    assert np.array_equal(np.concatenate([x[3] for x in nodes]), weights)
    assert np.array_equal(np.concatenate([x[4] for x in nodes]), counts)
