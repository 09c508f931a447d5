import numpy as np
from pyspark.sql import functions as F

from lociflow.functions.distribution import distribution, medians, quantiles


def test_quantiles_match_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    hot = np.round(rng.normal(0, 1, 6000), 2)
    rows = [(1, float(v)) for v in hot] + [(1, 0.0)] * 3000 + [(2, float(v)) for v in rng.normal(5, 2, 7)] + [(3, 4.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.995}).collect()}
    for g in (1, 2, 3):
        vals = [v for k, v in rows if k == g]
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.995)):
            assert abs(got[g][name] - np.quantile(vals, p)) < 1e-9
    d = distribution(df, ["g"], "v").where("g = 1").orderBy("value").collect()
    assert d[0].n_below == 0 and d[-1].n_below + d[-1].n_equal == 9000 == d[0].n_total


def test_medians_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 3.0, 2.0), (1, None, 8.0)], "g int, a double, b double")
    r = medians(df, ["g"], {"ma": "a", "mb": F.col("b") * 2}).first()
    assert (r.ma, r.mb) == (2.0, 10.0)
