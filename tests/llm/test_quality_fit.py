"""The ranking learns from every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm.quality_ranking import FEATURES, fit_ranking


def test_all_labelled_rows_count(spark):
    draw = np.random.default_rng(11)
    n = 9_000
    good = draw.random(n) < 0.45
    x = draw.normal(size=(n, 3)) + good[:, None] * [1.0, 0.5, 0.0]
    rows = spark.createDataFrame([(i, bool(y), v) for i, (y, v) in enumerate(zip(good, x.tolist()))], "id long, y boolean, f array<double>")
    rest = F.array_repeat(F.lit(0.0), FEATURES - 3)
    model = fit_ranking(rows.select("id", "y", F.concat("f", rest).alias("f")).repartition(5))
    full = np.hstack([x, np.zeros((n, FEATURES - 3))])
    assert np.allclose(model.mean, full.mean(0)) and np.allclose(model.scale, np.maximum(full.std(0), 1e-6))
    s = np.clip((full - model.mean) / model.scale, -8, 8) @ model.weights
    assert (s < model.cut).sum() == (~good).sum()  # the quantile of all rows, not of some
    assert np.isclose(model.unit, s.std() / 4)
    weights = model.weights[:3] / model.scale[:3]  # the log odds of a pair are 1.0 and 0.5 a unit, before the shrinking
    assert 0.85 < weights[0] < 1.1 and 0.4 < weights[1] < 0.6 and abs(weights[2]) < 0.1 and not model.weights[3:].any()
