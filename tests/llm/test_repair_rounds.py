import numpy as np
import pytest

from quillon.llm import repair


@pytest.mark.parametrize("ids", [np.zeros(1 << 16, np.uint32), np.tile(np.random.default_rng(1).integers(0, 1000, 300), 500)])
def test_no_frequent_pair_is_left(ids):
    seq, rules, lengths = repair.compress(ids, 1000)
    assert np.unique(seq[:-1].astype(np.int64) << 16 | seq[1:], return_counts=True)[1].max(initial=0) < repair.LEAST
    spans = np.concatenate([np.ones(1000, np.int64), lengths])
    assert spans[seq].sum() == len(ids)
