"""The fit against a slow one: risk written out, gradient by differences, both branches of the bound at zero."""

import numpy as np

from riskcard.llm import toxicity as T


def slow_fit(docs, positive, prior, seed, branches):
    known = np.unique(np.concatenate([x for x, _ in docs]))
    rows = np.zeros((len(docs), len(known)))
    for i, (x, share) in enumerate(docs):
        rows[i, np.searchsorted(known, x)] = T.SCALE * share
    w = np.r_[np.zeros(len(known)), np.log(prior / (1 - prior))]
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    rng = np.random.Generator(np.random.PCG64(seed))
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    batches = max(1, min(T.BATCHES, len(pos)))
    loss = lambda z: np.mean(np.log1p(np.exp(-z)))
    for epoch in range(T.EPOCHS):
        rate = T.RATE * 0.5 * (1 + np.cos(np.pi * epoch / T.EPOCHS))
        for p, u in zip(np.array_split(rng.permutation(pos), batches), np.array_split(rng.permutation(unl), batches)):
            score = lambda w, at: rows[at] @ w[:-1] + w[-1]
            clean = lambda w: loss(-score(w, u)) - prior * loss(-score(w, p))
            sound = clean(w) >= 0
            branches.add(bool(sound))

            def goal(w):
                risk = prior * loss(score(w, p)) + clean(w) if sound else -clean(w)
                return risk + T.DECAY / 2 * (w[:-1] ** 2).sum()

            grad = np.array([(goal(w + e) - goal(w - e)) / 2e-5 for e in 1e-5 * np.eye(len(w))])
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return known, w


def test_fit_equals_the_slow_one(monkeypatch):
    monkeypatch.setattr(T, "EPOCHS", 6)
    monkeypatch.setattr(T, "BATCHES", 2)
    branches = set()
    for seed, prior in ((1, 0.2), (2, 0.8), (3, 0.95)):
        rng = np.random.default_rng(seed)
        docs = []
        for _ in range(30):
            x = np.sort(rng.choice(9, rng.integers(1, 6), replace=False)).astype(np.int64) * 1000 + 7
            docs.append((x, rng.uniform(0.001, 0.03, len(x))))
        positive = np.arange(30) % 3 == 0
        known, want = slow_fit(docs, positive, prior, seed, branches)
        weights, constant = T.fit(docs, positive, prior, seed)
        assert abs(constant - want[-1]) < 1e-3 and np.abs(weights[known] - want[:-1]).max() < 1e-3
        assert np.count_nonzero(weights) <= len(known)
    assert branches == {True, False}
