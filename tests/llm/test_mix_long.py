"""Budgets that only documents of about 20 million words and more can fill."""

import numpy as np
import pytest

from riskcard.llm import mix


@pytest.mark.parametrize("lengths,counts,budget,want", [
    ([24_950_000, 30_000_000], [1, 1], 25_000_000, [1, 0]),
    ([24_950_000, 24_990_000], [2, 2], 25_000_000, [0, 1]),      # the longest that fits
    ([10, 24_950_000, 30_000_000], [4, 1, 1], 25_000_000, [4, 1, 0]),
    ([30_000_000], [3], 25_000_000, [0]),                        # none fits
])
def test_long_documents_fill_the_rest(lengths, counts, budget, want):
    take = mix.subset(np.array(lengths, np.int64), np.array(counts, np.int64), budget)
    assert take.tolist() == want
