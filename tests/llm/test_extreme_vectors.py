"""Vectors of huge or tiny components take part in the search."""

import numpy as np

from weftline.llm import multi_index


def test_evened_rows_keep_cosines_bit_by_bit():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 16))
    y = multi_index.evened(x)
    cosine = lambda v: (v[0] * v).sum(1) / (np.sqrt((v * v).sum(1))[0] * np.sqrt((v * v).sum(1)))
    assert (cosine(x) == cosine(y)).all()
    for scale in (1e200, 1e-200, 1e300, 1e-300):
        z = multi_index.evened(x * scale)
        assert np.allclose(cosine(z), cosine(x), rtol=1e-12)
        assert np.isfinite(z).all() and (np.abs(z).max(1) >= 0.5).all() and (np.abs(z).max(1) < 1).all()
