"""WoE binning, split, class weights, run log / promotion, dispatcher."""

import math

import pytest
from pyspark.sql import functions as F

from loanrisk.operators import models, split, woe
from tests.conftest import SMALL


def one_feature(spark, counts, edges, **options):
    rows = spark.createDataFrame([("x", *c) for c in counts], "feature string, prebin int, good long, bad long")
    return woe.merged(rows, {"x": edges}, ["x"], **options)["x"]


def test_woe_hand_value(spark):
    fb = one_feature(spark, [(0, 90, 10), (1, 50, 50)], [0.5], min_bin_size=0.01)
    G, B = 140, 60
    w1 = math.log((90 / G) / (10 / B))
    w2 = math.log((50 / G) / (50 / B))
    assert len(fb.bins) == 2
    assert fb.woe == pytest.approx([w1, w2])
    assert fb.iv == pytest.approx((90 / G - 10 / B) * w1 + (50 / G - 50 / B) * w2)
    assert fb.woe[0] > fb.woe[1]          # higher WoE = safer


def test_only_empty_cells_are_smoothed(spark):
    fb = one_feature(spark, [(0, 40, 0), (1, 60, 20)], [0.5], min_bin_size=0.01)
    assert fb.woe == pytest.approx([math.log((40 / 100) / (0.5 / 20)), math.log((60 / 100) / (20 / 20))])


def test_bins_survive_their_spec(spark):
    fitted = {"x": one_feature(spark, [(-1, 3, 4), (0, 90, 10), (1, 50, 50)], [0.5], min_bin_size=0.01)}
    assert woe.from_spec(woe.to_spec(fitted)) == fitted


def test_woe_merges_to_monotone_and_min_size(spark):
    counts = [(0, 100, 5), (1, 10, 30), (2, 100, 8), (3, 2, 1), (4, 100, 40), (5, 100, 60)]
    fb = one_feature(spark, counts, [1, 2, 3, 4, 5])
    rates = [b.bad / (b.good + b.bad) for b in fb.bins]
    assert rates == sorted(rates) or rates == sorted(rates, reverse=True)
    total = sum(g + b for _, g, b in counts)
    assert all(b.good + b.bad >= 0.05 * total for b in fb.bins) or len(fb.bins) == 1
    assert len(fb.bins) <= woe.MAX_BINS


def best_of_all_cuts(counts, max_bins, min_bin_size):
    """IV units and cuts by trying every way to join neighbours."""
    import itertools
    G, B = (max(sum(c[k] for c in counts), 1) for k in (1, 2))
    pre = [c for c in counts if c[0] >= 0]
    best = None
    for n in range(1, max_bins + 1):
        for inner in itertools.combinations(range(1, len(pre)), n - 1):
            cuts = [*inner, len(pre)]
            parts = [pre[a:b] for a, b in zip([0, *inner], cuts)]
            sums = [(sum(p[1] for p in part), sum(p[2] for p in part)) for part in parts]
            rates = [b / (g + b) for g, b in sums]
            if n > 1 and min(g + b for g, b in sums) < min_bin_size * (G + B):
                continue
            if rates not in (sorted(rates), sorted(rates, reverse=True)):
                continue
            units = sum(round((g / G - b / B) * woe._woe(g, b, G, B) * woe.IV_UNITS) for g, b in sums)
            if best is None or (units, -n) >= (best[0], -len(best[1])):
                best = units, cuts
    return best


@pytest.mark.parametrize("seed", range(4))
def test_optimal_bins_are_the_best_of_all(spark, seed):
    """Twelve pre-bins a feature, with trends up, down and both, empty cells, ties,
    small pre-bins and missing values."""
    import random
    rng = random.Random(seed)
    rows, want = [], {}
    for k in range(12):
        slope = rng.choice([-0.03, 0.0, 0.02, 0.05])
        counts = []
        for p in range(rng.choice([1, 2, 12])):
            n = rng.choice([3, 40, 100, 100])
            bad = min(n, max(0, round(n * (0.3 + slope * p + rng.uniform(-0.1, 0.1)))))
            counts.append((2 * p, n - bad, bad))   # every other pre-bin is empty
        if k % 3 == 0:
            counts.append((-1, 30, 20 * k))
        if k == 5:
            counts = [(p, 50, 50) for p in range(12)]
        rows += [(f"f{k}", *c) for c in counts]
        want[f"f{k}"] = best_of_all_cuts(counts, 2 + k % 4, 0.05), counts
    df = spark.createDataFrame(rows, "feature string, prebin int, good long, bad long")
    for most in range(2, 6):
        got = woe.optimal_bins(df, most, 0.05).collect()
        for f, ((units, cuts), counts) in want.items():
            if 2 + int(f[1:]) % 4 != most:
                continue
            pre = [c for c in counts if c[0] >= 0]
            mine = sorted((r.bin, r.last_prebin, r.good, r.bad) for r in got if r.feature == f and r.bin >= 0)
            value = sum(round((g / r_G - b / r_B) * woe._woe(g, b, r_G, r_B) * woe.IV_UNITS) for _, _, g, b in mine
                        for r_G, r_B in [(max(sum(c[1] for c in counts), 1), max(sum(c[2] for c in counts), 1))])
            assert abs(value - units) <= len(mine) and len(mine) == len(cuts)
            assert [p for _, p, _, _ in mine] == [pre[c - 1][0] for c in cuts]
            assert [(r.good, r.bad) for r in got if r.feature == f and r.bin == -1] == [c[1:] for c in counts if c[0] == -1]


def test_woe_fit_transform_on_tables(spark):
    from loanrisk.plans.modelling import SCORECARD_FEATURES, split_rows
    from loanrisk.plans.tables import tables
    t = tables(spark, SMALL)
    train = split_rows(t, "train")
    fitted = woe.fit(train, SCORECARD_FEATURES[:6])
    for fb in fitted.values():
        rates = [b.bad / max(b.good + b.bad, 1) for b in fb.bins]
        assert rates == sorted(rates) or rates == sorted(rates, reverse=True)
        assert len(fb.bins) <= woe.MAX_BINS
    out = woe.transform(train, fitted, keep=["loan_id"])
    assert out.count() == train.count()
    assert out.where(F.col("int_rate_woe").isNull()).count() == 0
    with pytest.raises(ValueError):
        woe.transform(train, fitted, ["not_a_feature"])
    summary = [r.iv for r in woe.iv_summary(spark, fitted).collect()]
    assert summary == sorted(summary, reverse=True)


def test_split_has_exact_shares_per_class(spark):
    """Every class is cut at its exact shares, in hash order, whatever the partitions."""
    import hashlib
    rows = [(str(i), 1 if i % 7 == 0 else 0) for i in range(5000)] + [("x", None)]
    df = spark.createDataFrame(rows, "loan_id string, default_flag int")
    got = {r.loan_id: r.split for r in split.with_split(df).collect()}
    assert got.pop("x") is None
    for c in (0, 1):
        mine = sorted((hashlib.md5(f"{i}42".encode()).hexdigest(), i) for i, y in rows if y == c)
        test, cal = split.sizes(len(mine))
        want = ["test"] * test + ["cal"] * cal + ["train"] * (len(mine) - test - cal)
        assert [got[i] for _, i in mine] == want
        assert abs(test / len(mine) - 0.20) < 1e-3 and abs(cal / len(mine) - 0.12) < 1e-3
    again = split.with_split(df.repartition(5)).where("loan_id <> 'x'").collect()
    assert {r.loan_id: r.split for r in again} == got


def test_split_of_few_loans(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "loan_id string, default_flag int")
    assert {r.split for r in split.with_split(df).collect()} == {"train"}
    assert split.with_split(df.limit(0)).count() == 0


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 25 + [(0,)] * 75, "default_flag int")
    w = {r.default_flag: r for r in split.class_weights(df).collect()}
    assert w[1].class_weight == 2.0 and w[0].class_weight == pytest.approx(100 / 150)
    assert w[0].scale_pos_weight == 3.0


def test_promotion_rule_reads_champion_from_log(spark):
    log = models.RunLog()
    log.log("champ", "tag", "champion", "true")
    log.metrics("champ", {"gini": 0.75})
    log.log("a", "tag", "champion", "false")
    log.metrics("a", {"gini": 0.77})           # not above 0.77: strict rule
    log.log("b", "tag", "champion", "false")
    log.metrics("b", {"gini": 0.7701})
    got = {r.challenger: r.promotion_eligible for r in models.promotion(log.frame(spark)).collect()}
    assert got == {"a": False, "b": True}
    comp = models.comparison(log.frame(spark)).collect()
    assert [r.run for r in comp] == ["b", "a", "champ"]


def test_dispatcher_rejects_unknown(spark):
    with pytest.raises(ValueError):
        models.train("random_forest", spark.range(1))


def test_oversample_positives(spark):
    df = spark.createDataFrame([(str(i), 1 if i < 100 else 0) for i in range(500)],
                               "loan_id string, default_flag int")
    o = models.oversample_positives(df, 2.5)
    pos = o.where("default_flag = 1").count()
    assert 200 <= pos <= 300 and o.where("default_flag = 0").count() == 400


def test_latest_run_of_a_name_wins(spark, tmp_path):
    log = models.RunLog()
    for at, champ, chall in ((1.0, 0.5, 0.6), (2.0, 0.55, 0.4)):
        log.start("champ", at)
        log.tags("champ", {"champion": "true"})
        log.metrics("champ", {"gini": champ})
        log.start("chall", at)
        log.tags("chall", {"champion": "false"})
        log.metrics("chall", {"gini": chall})
    log.append_to(spark, str(tmp_path / "log"))
    stored = models.read_log(spark, str(tmp_path / "log"))
    assert stored.count() == len(log.rows)
    rows = models.promotion(stored).collect()
    assert [(r.challenger, r.challenger_gini, r.champion_gini, r.promotion_eligible) for r in rows] == [("chall", 0.4, 0.55, False)]
    assert len(models.comparison(stored).collect()) == 2


def test_isotonic_on_groups_equals_the_fit_on_rows(spark):
    from pyspark.ml.regression import IsotonicRegression
    rows = [(float(i % 9) / 4, 1 if (i * 7919) % 100 < 8 * (i % 9) else 0) for i in range(900)]
    df = spark.createDataFrame(rows, "s double, default_flag int")
    knots = models.isotonic(df, "s")
    plain = IsotonicRegression(featuresCol="s", labelCol="default_flag", isotonic=True).fit(df.withColumn("default_flag", F.col("default_flag").cast("double")))
    x = spark.createDataFrame([(v / 10,) for v in range(-5, 30)] + [(None,)], "s double")
    got = {r.s: r.p for r in knots.apply(x, "s", "p").collect()}
    assert got.pop(None) is None
    for r in plain.transform(x.where("s IS NOT NULL")).collect():
        assert got[r.s] == pytest.approx(r.prediction, abs=1e-12)


SMALL_MODELS = [
    ("scorecard", {}),
    ("boosted_trees", {"maxIter": 3, "maxDepth": 2}),
    ("neural_net", {"epochs": 5, "hidden": [4]}),
]


@pytest.mark.parametrize("name, options", SMALL_MODELS)
def test_train_score_save_load(spark, tmp_path, name, options):
    """Hold-out metrics in range; a saved and loaded scorer gives the same scores on
    any frame; the log holds every entry."""
    import os

    from loanrisk.plans.tables import tables
    mf = tables(spark, SMALL).model_features
    log = models.RunLog()
    log.start("champ", 0.0)
    log.tags("champ", {"champion": "true"})
    log.metrics("champ", {"gini": 0.1})
    art = str(tmp_path / "artifacts")
    t = models.train(name, mf, log=log, artifacts=art, **options)
    m = t.metrics
    assert -1 <= m["gini"] <= 1 and 0 <= m["ks"] <= 1 and 0 <= m["calibration_error"] <= 1
    assert all(0 <= r.p <= 1 for r in t.scored.collect())
    book = mf.withColumn("extra", F.lit(1))                  # all years, with a column of its own
    a = t.scorer.score(book)
    b = models.Scorer.load(spark, f"{art}/model").score(book)
    assert a.columns == [*book.columns, "p", *(["margin", "points"] if name == "scorecard" else [])] == b.columns
    key = lambda df: sorted(tuple(r) for r in df.select("loan_id", *a.columns[len(book.columns):]).collect())
    assert key(a) == key(b) and a.count() == mf.count()
    entries = {(r.kind, r.key) for r in log.frame(spark).where(F.col("run") == t.name).collect()}
    want = {("metric", "train_size"), ("metric", "test_size"), ("param", "train_vintages"), ("tag", "champion"), ("tag", "artifacts")}
    if name != "scorecard":
        want |= {("metric", "champion_gini"), ("metric", "promotion_threshold"), ("tag", "promotion_eligible"), ("tag", "challenger"),
                 ("metric", "gini_overall")}
    assert want <= entries
    if name == "scorecard":
        assert any(f.endswith(".csv") for f in os.listdir(os.path.join(art, "iv_summary")))
    else:
        again = models.train(name, mf, **options)
        assert key(again.scorer.score(book)) == key(a)        # deterministic
    if name == "neural_net":
        h = t.extra["loss_history"]
        assert len(h) > 1 and h[-1] < h[0]
    if name == "boosted_trees":
        imp = t.extra["importance"]
        assert abs(sum(v for _, v in imp) - 1) < 1e-6 and [v for _, v in imp] == sorted((v for _, v in imp), reverse=True)


def test_no_feature_with_information_raises(spark):
    from loanrisk.plans.tables import tables
    with pytest.raises(ValueError, match="information value"):
        models.train_scorecard(tables(spark, SMALL).model_features, ["total_acc"], min_iv=5.0)


def test_gradient_is_zero_at_the_fit_alone(spark):
    from dataclasses import replace

    from loanrisk.plans.modelling import split_rows
    from loanrisk.plans.tables import tables
    t = tables(spark, SMALL)
    train = split_rows(t, "train")
    scorer = models.train("scorecard", t.model_features, min_iv=0.05).scorer
    at_fit = {r.feature: r.gradient for r in models.scorecard_gradient(scorer, train).collect()}
    assert set(at_fit) == {*scorer.features, "intercept"} and all(abs(g) < 1e-4 for g in at_fit.values())
    off = replace(scorer, coefficients=[c + 0.1 for c in scorer.coefficients])
    assert any(abs(r.gradient) > 1e-3 for r in models.scorecard_gradient(off, train).collect())


def test_trees_are_grown_on_few_partitions_whatever_the_tables_have(spark, monkeypatch):
    """Each of the 1,200 passes of 300 trees pays for its tasks."""
    from pyspark.ml import Pipeline

    from loanrisk.plans.tables import tables
    assert [models.fit_partitions(n) for n in (0, 1, 40_000, 4_000_000, 24 * 524_288 + 1, 10 ** 9)] == [1, 1, 2, 24, 25, 1908]
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    mf = tables(spark, SMALL).model_features
    fits = [models.train_boosted_trees(x, maxIter=2, maxDepth=2) for x in (mf.repartition(60), mf)]
    assert seen == [1, 1]
    assert fits[0].extra["importance"] == fits[1].extra["importance"]


def test_prebin_search_counts_the_edges_below(spark):
    """Every value of every feature passes the search: a few steps, no pass over its edges."""
    nan = float("nan")
    for edges in ([], [2.0], [1.0, 2.0, 4.0], [float(i) for i in range(19)], [1.0, float("inf")], [1.0, nan]):
        values = [None, nan, float("inf"), -float("inf"), -0.0, *[i / 2 for i in range(-1, 40)]]
        d = spark.createDataFrame([("x", v, 1, edges) for v in values], "feature string, value double, y int, edges array<double>")
        got = woe.with_prebin(d, 19)
        below = F.when(F.col("value").isNull(), F.lit(woe.MISSING)).otherwise(F.size(F.filter("edges", lambda e: e < F.col("value"))))
        assert got.where(F.col("prebin") != below).count() == 0 and got.where("prebin is null").count() == 0
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_prebin_edges_are_filled_up_before_the_join(spark):
    """once a feature, not once a value."""
    long = spark.range(50).select(F.lit("x").alias("feature"), F.col("id").cast("double").alias("value"), (F.col("id") % 2).alias("y"))
    edges = long.groupBy("feature").agg(F.array_sort(F.collect_set(F.col("value") - F.col("value") % 10)).alias("edges"))
    counts = woe.prebin_counts(long, edges)
    assert {r["prebin"]: (r["good"], r["bad"]) for r in counts.collect()} == {0: (1, 0), 1: (5, 5), 2: (5, 5), 3: (5, 5), 4: (5, 5), 5: (4, 5)}
    assert "array_repeat" not in counts._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_scorecard_keeps_only_the_columns_it_passes_over(spark, monkeypatch):
    """the cached training rows are the label and the selected features."""
    from loanrisk.plans.tables import tables
    mf = tables(spark, SMALL).model_features
    fitted = woe.fit(models.splits(mf)[0], ["int_rate", "dti"])
    kept, cache = [], type(mf).cache
    monkeypatch.setattr(type(mf), "cache", lambda self: kept.append(self.columns) or cache(self))
    models.train_scorecard(mf, ["int_rate", "dti"], min_iv=0.0, fitted=fitted)
    assert kept[0] == ["default_flag", "int_rate", "dti"]
