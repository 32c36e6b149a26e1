"""Noisy labelling functions combined by an expectation-maximization label model."""

from __future__ import annotations

import numpy as np

#: Votes of a labelling function: it is a case, it is none, it has nothing to say.
YES, NO, PASS = "1", "0", "-"

ROUNDS = 200


def posteriors(patterns: dict[str, int], prior: float, trust: list[float]) -> dict[str, float]:
    """Probability that a row with these votes is a case, for each pattern of votes.

    ``patterns`` maps the votes of all functions (one character each) to the number of rows; there
    are at most 3 ** functions of them, so this runs on the driver whatever the number of rows.
    ``prior`` is the first guess of the share of cases and ``trust`` of how often a function
    that votes is right; both are refitted: each function's rate of each vote among cases and
    among others, given the others' votes.  A function that passes says nothing: its rates are taken
    among the rows it votes on.  One that only ever votes yes has no such rates; its yes counts
    by its trust throughout.  A function keeps the direction of its trust: its votes never count for the opposite of what they say.
    """
    if not patterns:
        return {}
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    votes = np.array([[{YES: 1, NO: 0, PASS: -1}[c] for c in k] for k in keys])
    f = votes.shape[1]
    yes, no = votes == 1, votes == 0
    one_sided = ~no.any(axis=0)
    voted = (votes >= 0) & ~one_sided
    trust_ = np.array(trust[:f])
    rate = np.stack([1 - trust_, trust_])  # of a yes, among others and among cases
    share = prior
    post = np.full(len(keys), prior)
    for _ in range(ROUNDS):
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        log = []
        for k, c in ((0, 1 - share), (1, share)):
            log.append(np.log(c) + (yes * np.log(rate[k])).sum(axis=1) + (no * np.log(1 - rate[k])).sum(axis=1))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        moved = np.abs(new - post).max()
        post = new
        share = float(np.clip((post * n).sum() / n.sum(), 1e-5, 0.5))
        for k, w in ((0, (1 - post) * n), (1, post * n)):
            of = (w[:, None] * voted).sum(axis=0)
            refit = ((w[:, None] * (yes & voted)).sum(axis=0) + 2 * rate[k]) / (of + 2)
            rate[k] = np.where(one_sided, rate[k], refit)
        # Keep directions: among cases a function says yes at least as readily as among others.
        turned = rate[1] < rate[0]
        rate[:, turned] = rate[:, turned].mean(axis=0)
        if moved < 1e-6:
            break
    return {k: float(p) for k, p in zip(keys, post)}
