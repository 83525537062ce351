import math

import numpy as np

from tessera.functions.algebra import t_quantile
from tessera.operators import process, resample

BLOCKS = "grp string, block int, gain double, w double"


def test_shared_draws_need_the_same_blocks_in_each_group(spark):
    rows = [(g, b + (g == "b" and b == 9), 1.0 + 0.01 * b, 1.0) for g in "ab" for b in range(10)]  # b has block 10 for 9
    for shared, expected in ((True, {"unavailable"}), (False, {"robust_positive"})):
        got = resample.bootstrap_t(resample.block_table(spark.createDataFrame(rows, BLOCKS), "grp", "block", "gain", "w"), 100, 1, shared=shared)
        assert {r.status for r in got.collect()} == expected
    same = spark.createDataFrame([(g, b, 1.0 + 0.01 * b, 1.0) for g in "ab" for b in range(10)], BLOCKS)
    assert {r.status for r in resample.bootstrap_t(resample.block_table(same, "grp", "block", "gain", "w"), 100, 1, shared=True).collect()} == {"robust_positive"}


def test_source_process_averages_inner_refits_first(spark):
    x = np.random.default_rng(4).normal(1, 0.1, (8, 8, 9))
    schema = "source int, inner int, grp string, block int, num double, w double"
    cells = spark.createDataFrame([(s, i, "g", b, float(x[s, i, b]), 1.0) for s in range(8) for i in range(8) for b in range(9)], schema)
    m = x.mean(axis=1)
    leave = lambda a: sum((np.delete(m, i, axis=a).mean() - m.mean()) ** 2 for i in range(m.shape[a])) * (m.shape[a] - 1) / m.shape[a]
    got = process.source_bounds(cells).first()
    assert math.isclose(got.variance, leave(0) + leave(1)) and got.df == 7 and got.status == "robust_positive"
    assert math.isclose(got.lower, m.mean() - t_quantile(0.95, 7) * math.sqrt(leave(0) + leave(1)))
    assert process.source_bounds(cells.filter("inner < 7")).first().status == "unavailable"
