"""The label model, as it runs in production, on mixes of faults."""

import numpy as np
import pytest

from causeway.llm import quality

RULES, FAULTS = len(quality.RULES), len(quality.FAULTS)


def one_fault(shares):
    """Vote patterns of a million texts: each rule's bad votes alone, in the given shares, and texts that all rules find good."""
    v = np.ones((len(shares) + 1, RULES), np.int8)
    v[range(len(shares)), range(len(shares))] = -1
    return v, np.array([*shares, 1 - sum(shares)]) * 1e6


@pytest.mark.parametrize("shares", [[0.005], [0.3, 0.005], [0.1, 0.002], [1 / 3, 0.02, 0.005, 0.001, 0.0003], [0.5, 0.0001, 0.01], [0.001] * FAULTS, [0.05] * FAULTS])
def test_rare_faults_are_rejected_beside_a_common_one(shares):
    v, counts = one_fault(shares)
    q = quality.fit_label_model(v, counts, faults=FAULTS).posterior(v)
    assert (q[:-1] < 0.5).all() and q[-1] > 0.9


def test_a_rule_that_errs_on_good_texts_is_found_out():
    """Texts with the second fault mostly have the first too; alone, the second rule's bad votes are mistakes."""
    rng = np.random.default_rng(8)
    n = 200_000
    bad = rng.random(n) < 0.2
    v = np.ones((n, RULES), np.int8)
    for j, (hit, error) in enumerate([(0.98, 0.0), (0.97, 0.0), (0.96, 0.0), (0.9, 0.02)]):
        v[rng.random(n) < np.where(bad, hit, error), j] = -1
    code, counts = np.unique(quality.encode(v), return_counts=True)
    m = quality.fit_label_model(quality.decode(code, RULES), counts.astype(float), faults=FAULTS)
    alone = np.ones((1, RULES), np.int8)
    alone[0, 3] = -1
    assert m.posterior(alone)[0] > 0.5 and abs(m.rates[3, 3, 1, 0] - 0.02) < 0.012
    assert m.posterior(-np.ones((1, RULES), np.int8))[0] < 0.01


def test_silent_rules_guess_no_fault():
    v, counts = one_fault([0.06])
    v[-1, 0] = 0
    q = quality.fit_label_model(v, counts, faults=FAULTS).posterior(v)
    assert q[0] < 0.5 and q[1] > 0.9


def test_witnesses_reject_nothing_alone_but_bear_out_a_fault():
    """The letters witness errs on a fifth of the good texts; the symbols rule on two in a hundred; together they are right."""
    rng = np.random.default_rng(4)
    n = 200_000
    names = list(quality.RULES)
    symbols, letters = names.index("symbols"), names.index("letters")
    bad = rng.random(n) < 0.1
    v = np.ones((n, RULES), np.int8)
    v[rng.random(n) < np.where(bad, 0.98, 0.02), symbols] = -1
    v[rng.random(n) < np.where(bad, 0.97, 0.2), letters] = -1
    code, counts = np.unique(quality.encode(v), return_counts=True)
    m = quality.fit_label_model(quality.decode(code, RULES), counts.astype(float), faults=FAULTS)
    kept = m.posterior(v) >= 0.5
    assert (kept != (v == 1).all(1)).mean() > 0.1  # far from all-must-pass
    assert kept[(v[:, letters] == -1) & (v[:, symbols] == 1)].all()
    assert not kept[(v[:, letters] == -1) & (v[:, symbols] == -1)].any()
    assert kept[~bad].mean() > 0.97 and (~kept)[bad].mean() > 0.9
