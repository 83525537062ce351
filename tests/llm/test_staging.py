from types import SimpleNamespace

import numpy as np
import pytest

from tessera.llm import staging, suffix_dedup


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda name, default=None: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        staging.shared_dir(cluster)


def test_windows_are_equal_only_if_both_hashes_are():
    a, b = np.array([7, 7, 7, 2, 7], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    first, group = suffix_dedup._pair_groups(a, b)
    assert sorted(first.tolist()) == [0, 1, 3] and group.tolist() == [1, 2, 1, 0, 2]
    assert [x.tolist() for x in suffix_dedup._pair_groups(a[:0], b[:0])] == [[], []]
