"""Probes follow the lists: recall of random pairs at the threshold, the worst case, where lists are many."""

import numpy as np
import pytest

from causeway.llm import pq


@pytest.mark.parametrize("lists", [25, 100, 1_000, 3_000, 30_000])
def test_recall_holds_however_many_lists_there_are(lists):
    rng = np.random.default_rng(lists)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(8_000, 64)))
    k = round(lists**0.5)
    q = pq.Quantiser([pq.k_means(part, k, 5, h) for h, part in enumerate((x[:, :32], x[:, 32:]))], [], [])
    a = unit(rng.normal(size=(2_000, 64)))
    away = rng.normal(size=a.shape)
    away = unit(away - (away * a).sum(1, keepdims=True) * a)
    b = 0.951 * a + (1 - 0.951**2) ** 0.5 * away
    probes = pq.probes_for(k * k)
    of_a, of_b = q.probe(a, probes), q.probe(b, probes)
    found = (of_a == of_b[:, :1]).any(1) | (of_b == of_a[:, :1]).any(1)
    assert found.mean() >= 0.985
    assert pq.probes_for(4 * k * k) >= probes
