"""Published versions, retention, committed models, keyed run log."""

import os

import pytest
from pyspark.sql import functions as F

from loanrisk.operators import models, woe
from loanrisk.operators.calibration import Knots
from loanrisk.sources import io


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "t")
    first = io.publish_table(spark.range(10), root)
    reader = io.published(spark, root)
    bad = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("half-way"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="half-way"):
        io.publish_table(bad, root)
    assert io.versions(spark, root) == [first] and io.published(spark, root).count() == 10
    second = io.publish_table(spark.range(20), root)
    assert io.published(spark, root).count() == 20 and reader.count() == 10      # a reader stays on its version
    assert io.published(spark, root, first).count() == 10 and io.versions(spark, root) == [second, first]
    third = io.publish_table(spark.range(30), root)
    assert io.retire(spark, root, keep=2) == [first] and not os.path.exists(f"{root}/{first}")
    assert io.versions(spark, root) == [third, second] and io.retire(spark, root, keep=2) == []
    with pytest.raises(FileNotFoundError):
        io.published(spark, root, first)
    with pytest.raises(FileNotFoundError):
        io.published(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        io.retire(spark, root, keep=0)


def test_intermediate_results_are_released(spark):
    from loanrisk.operators import metrics
    before = len(io.staged_paths(spark))
    df = spark.range(200).select((F.col("id") % 7 / 7).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    rows = metrics.rank_metrics(metrics.score_ladder(df)).collect()
    mine = io.staged_paths(spark)[before:]
    assert rows and mine and all(os.path.exists(p) for p in mine)
    assert io.release_staged(spark, before) == len(mine)
    assert not any(os.path.exists(p) for p in mine) and len(io.staged_paths(spark)) == before


def test_a_model_broken_off_is_never_loaded(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "model")

    def scorer(p):
        return models.Scorer("scorecard", [], Knots.of_lists(spark, [0.0], [p]), {"x": woe.FeatureBins("x", [], None, 1, 1)}, intercept=1.0)

    def score(**options):
        return models.Scorer.load(spark, path, **options).score(spark.range(1)).first()["p"]

    first = scorer(0.25).save(spark, path)
    with monkeypatch.context() as m:
        m.setattr(woe, "bin_table", lambda *a: 1 / 0)     # after the knots, before the rest
        with pytest.raises(ZeroDivisionError):
            scorer(0.5).save(spark, path)
    assert score() == 0.25
    scorer(0.75).save(spark, path)
    assert score() == 0.75 and score(version=first) == 0.25


def test_appending_a_log_again_changes_nothing(spark, tmp_path):
    path, log = str(tmp_path / "log"), models.RunLog()
    log.start("a", 1.0)
    log.tags("a", {"champion": "true"})
    log.metrics("a", {"gini": 0.5})
    for _ in range(2):
        log.append_to(spark, path)
    assert models.read_log(spark, path).count() == 2
    log.start("b", 2.0)
    log.tags("b", {"champion": "true"})
    log.metrics("b", {"gini": 0.3})
    log.start("c", 3.0)
    log.metrics("c", {"gini": 0.31})
    for _ in range(2):
        log.append_to(spark, path)
    stored = models.read_log(spark, path)
    assert sorted(map(tuple, stored.collect())) == sorted(log.rows)
    # two champions: the latest one's name with its own Gini
    got = {r.challenger: (r.champion, r.champion_gini, r.promotion_eligible) for r in models.promotion(stored).collect()}
    assert got == {"a": ("b", 0.3, True), "c": ("b", 0.3, False)} and log.champion() == "b"
    assert {r.run: r.is_champion for r in models.comparison(stored).collect()} == {"a": False, "b": True, "c": False}
