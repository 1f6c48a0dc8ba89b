"""Train / calibration / test split and class weights.

Loans are ordered by md5(loan_id || seed) within their class, and cut at exact
shares: the first 20% of a class (rounded to whole loans) are ``test``, the first
15% of the rest ``cal``, the others ``train``. So every split holds the classes in
the proportion of the whole. The cuts are found from counts per hash prefix and
one ranked prefix (``stratified_cuts``); assigning a loan is then a comparison of
its hash with its class's cuts: no shuffle, no sampling state, identical after a
task retry, and reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanrisk.functions.num import dround

# --- fixed values -----------------------------------------------------------
SEED = "42"
TEST_PERCENT = 20
CAL_PERCENT_OF_REST = 15
MATURE_LAST_YEAR = 2016      # vintages after this are right-censored
# ---------------------------------------------------------------------------

PREFIX_DIGITS = 4


def sizes(n: int) -> tuple[int, int]:
    """Loans of a class of ``n`` in test and in cal, rounded half up."""
    test = (n * TEST_PERCENT + 50) // 100
    return test, ((n - test) * CAL_PERCENT_OF_REST + 50) // 100


def split_hash(key: str = "loan_id", seed: str = SEED) -> F.Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def stratified_cuts(df: DataFrame, label: str = "default_flag", key: str = "loan_id") -> dict[int, list[str]]:
    """Per class: the hashes at which cal and train begin.

    Rows are counted per (class, hash prefix), at most 65,536 numbers a class;
    only the prefixes that hold a cut are ranked, by their hashes (a 65,536th of a
    class each)."""
    h = df.select(F.col(label).alias("c"), split_hash(key).alias("h")).where(F.col("c").isNotNull())
    prefix = F.substring("h", 1, PREFIX_DIGITS)
    counts: dict[int, dict[str, int]] = {}
    for r in h.groupBy("c", prefix.alias("p")).count().collect():
        counts.setdefault(r["c"], {})[r["p"]] = r["count"]
    wanted: list[tuple[int, str, int, int]] = []   # class, prefix, rank in the prefix, which cut
    for c, by_prefix in counts.items():
        test, cal = sizes(sum(by_prefix.values()))
        for which, rank in enumerate((test, test + cal)):
            before = 0
            for p in sorted(by_prefix):
                if before + by_prefix[p] > rank:
                    wanted.append((c, p, rank - before, which))
                    break
                before += by_prefix[p]
    cuts = {c: ["g", "g"] for c in counts}   # beyond every hash
    if wanted:
        mine = F.lit(False)
        for c, p, _, _ in wanted:
            mine = mine | ((F.col("c") == c) & (prefix == p))
        place = F.row_number().over(Window.partitionBy("c", "p").orderBy("h")) - 1
        ranked = h.where(mine).withColumn("p", prefix).withColumn("place", place)
        asked = F.lit(False)
        for c, p, rank, _ in wanted:
            asked = asked | ((F.col("c") == c) & (F.col("p") == p) & (F.col("place") == rank))
        found = {(r["c"], r["p"], r["place"]): r["h"] for r in ranked.where(asked).collect()}   # two rows a class
        for c, p, rank, which in wanted:
            cuts[c][which] = found[c, p, rank]
    return cuts


def split_expr(cuts: dict[int, list[str]], label: str = "default_flag", key: str = "loan_id") -> F.Column:
    h = split_hash(key)
    out = F.lit(None).cast("string")
    for c, (cal, train) in cuts.items():
        mine = F.when(h < F.lit(cal), "test").when(h < F.lit(train), "cal").otherwise("train")
        out = F.when(F.col(label) == c, mine).otherwise(out)
    return out


def with_split(df: DataFrame, cuts: dict[int, list[str]] | None = None) -> DataFrame:
    """Adds ``split``; without ``cuts`` they are taken from ``df`` itself."""
    return df.withColumn("split", split_expr(stratified_cuts(df) if cuts is None else cuts))


def mature(df: DataFrame, year_col: str = "issue_year") -> DataFrame:
    """P10: keep vintages up to MATURE_LAST_YEAR."""
    return df.where(F.col(year_col) <= MATURE_LAST_YEAR)


def split_audit(mf: DataFrame, cuts: dict[int, list[str]] | None = None) -> DataFrame:
    """Size and default rate per split, plus the held-out (censored) count."""
    cuts = stratified_cuts(mature(mf)) if cuts is None else cuts
    s = with_split(mf, cuts).withColumn(
        "split", F.when(F.col("issue_year") > MATURE_LAST_YEAR, F.lit("held_out"))
        .otherwise(F.col("split")))
    return (s.groupBy("split")
            .agg(F.count(F.lit(1)).alias("loans"),
                 F.sum("default_flag").cast("long").alias("defaults"),
                 dround(F.avg("default_flag"), 4).alias("default_rate"))
            .orderBy("split"))


def class_weights(train: DataFrame, label: str = "default_flag") -> DataFrame:
    """M7: balanced weight n / (2 n_class) per class, and neg/pos ratio.

    Two rows (one per class): safe to broadcast back onto the training rows.
    """
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.partitionBy()   # over the two class rows only
    n = F.sum("n_class").over(every)
    neg = F.sum(F.when(F.col(label) == 0, F.col("n_class"))).over(every)
    pos = F.sum(F.when(F.col(label) == 1, F.col("n_class"))).over(every)
    return c.select(F.col(label), "n_class",
                    (n / (F.col("n_class") * 2.0)).alias("class_weight"),
                    (neg / pos).alias("scale_pos_weight"))


def with_class_weight(train: DataFrame, label: str = "default_flag",
                      out: str = "weight") -> DataFrame:
    w = class_weights(train, label).select(label, F.col("class_weight").alias(out))
    return train.join(F.broadcast(w), label)
