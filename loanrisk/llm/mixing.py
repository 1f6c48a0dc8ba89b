"""Mixing sources to target weights by temperature (operator 8, native).

1. *Shares.* Tokens (words ``[^\\x20\\x09-\\x0D]+``) per source over all rows.
2. *Weights.* Weight of a source is its share to the power ``t``, normalised: 1
   keeps the mixture, 0 makes sources equal. ``t`` is found by bisection in
   ``[0, 1]``: the largest at which the entropy of the weights reaches
   ``entropy_share`` of its maximum ``ln(sources)``, and then, if some source would
   be repeated more than ``max_epochs`` times for the budget, the smallest above it
   at which none is. Both quantities are monotone in ``t``.
3. *Quota.* ``floor(weight * budget)`` tokens of each source.
4. *Block permutations.* A source is read in epochs; each is a permutation of all
   its rows, by the MD5 of seed, epoch and id (where ids are null or repeat: id and place in the files). A copy
   is taken if the tokens before it, over all epochs, are less than the quota. The
   budget makes ``ceil(budget / block_tokens)`` blocks; block ``k`` takes from each
   source the copies that begin in the ``k``-th equal part of its quota, so every
   block holds the sources in their weights, and is itself a permutation: its
   copies are in the order of a second seeded hash.

The running count of tokens in a permutation is a sum in two levels: rows fall by
the leading digits of their hash into cells of about ``CELL_ROWS`` rows, cells are
summed (a small table), and the running sum inside a cell is a window over the
cell. A source with a third of all rows is spread over many tasks. Nothing goes
to the driver; the bisection is a fold over the array of source shares, one row.
All this runs on a narrow table; the texts are joined back by place.

Defined results: a null source is a source of its own; rows without words count
no tokens and are taken where the permutation has them; sources without any token
have no weight and yield no rows; rows with equal or null ids are told apart by
place; an empty table gives no rows; all input columns are carried, and a name
that the operator adds raises ``ValueError`` if it is in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanrisk.llm.common import SPACES, ids_are_unique, text_or_empty, written
from loanrisk.llm.exact_dedup import located

ENTROPY_SHARE, MAX_EPOCHS, BLOCK_TOKENS, SEED = 0.98, 4.0, 1_000_000, 42
BISECTIONS = 50
#: Rows that a cell of the permutation holds on average, at most.
CELL_ROWS = 4096
ADDED = ("tokens", "weight", "epoch", "token_start", "block", "block_order")


def n_words(text: Column) -> Column:
    """Words of a text: places where one begins."""
    plain = F.translate(text, SPACES, " " * len(SPACES))
    words = F.size(F.filter(F.split(plain, " "), lambda w: w != ""))
    return words.cast("long")


def _bisect(low: Column, high: Column, go_up) -> Column:
    """After ``BISECTIONS`` halvings of [low, high]: (low, high); ``go_up(t)`` moves low."""
    def step(acc, _):
        mid = (acc["low"] + acc["high"]) / 2
        up = go_up(mid)
        return F.struct(F.when(up, mid).otherwise(acc["low"]).alias("low"), F.when(up, acc["high"]).otherwise(mid).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), F.struct(low.alias("low"), high.alias("high")), step)


def _total(shares: Column, term) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda acc, q: acc + term(q))


def _entropy(t: Column, shares: Column) -> Column:
    """-sum w ln w with w = q^t / Z is ln Z - t * (sum q^t ln q) / Z."""
    z = _total(shares, lambda q: F.pow(q, t))
    return F.log(z) - t * _total(shares, lambda q: F.pow(q, t) * F.log(q)) / z


def _most_epochs(t: Column, shares: Column, budget_share: Column) -> Column:
    """Times the most repeated source is read: max of w / q, times budget / total."""
    z = _total(shares, lambda q: F.pow(q, t))
    return budget_share * F.aggregate(shares, F.lit(0.0), lambda acc, q: F.greatest(acc, F.pow(q, t - 1))) / z


def source_weights(counts: DataFrame, source_col: str, budget_tokens: int | None = None,
                   entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """From ``source, source_tokens``: adds ``exponent, weight, quota``. The budget
    defaults to all tokens. If even exponent 1 repeats too often, the exponent is 1."""
    counts = counts.filter("source_tokens > 0")
    # sums of doubles run over a sorted array: the same bits at each run
    whole = counts.agg(F.sum("source_tokens").alias("all_tokens"), F.array_sort(F.collect_list("source_tokens")).alias("each"))
    whole = whole.withColumn("shares", F.transform("each", lambda n: n / F.col("all_tokens")))
    whole = whole.withColumn("budget", F.lit(budget_tokens).cast("long") if budget_tokens else F.col("all_tokens"))
    q, least = F.col("shares"), F.lit(entropy_share) * F.log(F.size("shares").cast("double")) - 1e-12
    # entropy falls with t: the largest t at which it is still reached
    flat = F.when(_entropy(F.lit(1.0), q) >= least, 1.0).otherwise(
        _bisect(F.lit(0.0), F.lit(1.0), lambda t: _entropy(t, q) >= least)["low"])
    whole = whole.withColumn("flat", flat)
    ratio = F.col("budget") / F.col("all_tokens")
    # repetition falls with t too: the smallest t from there on that keeps the limit
    whole = whole.withColumn("exponent", F.when(_most_epochs(F.col("flat"), q, ratio) <= max_epochs, F.col("flat")).otherwise(
        _bisect(F.col("flat"), F.lit(1.0), lambda t: _most_epochs(t, q, ratio) > max_epochs)["high"]))
    whole = whole.withColumn("z", _total(q, lambda x: F.pow(x, F.col("exponent"))))
    weight = F.pow(F.col("source_tokens") / F.col("all_tokens"), F.col("exponent")) / F.col("z")
    return (counts.crossJoin(F.broadcast(whole.select("all_tokens", "budget", "exponent", "z")))  # one row
            .select(source_col, "source_tokens", "exponent", weight.alias("weight"),
                    F.floor(weight * F.col("budget")).alias("quota"), "budget"))


def plan_copies(df: DataFrame, budget_tokens: int | None = None, entropy_share: float = ENTROPY_SHARE,
                max_epochs: float = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The copies that make the mixture: ``at`` (place of the row), ``doc_id, source,
    tokens`` (of the row), ``exponent, weight`` (of its source), ``epoch``,
    ``token_start`` (tokens of the source's stream before it), ``block`` and
    ``block_order`` (hash that orders a block)."""
    rows = written(located(df).select(F.col("_at").alias("at"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                      n_words(text_or_empty(text_col)).alias("tokens")), "mix-rows")
    unique = ids_are_unique(rows, "doc_id")

    def name(*before) -> Column:
        """Seed, the given parts, and what tells the row from all others."""
        place = [] if unique else [F.col("at.file"), F.col("at.row").cast("string")]
        return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *before, "doc_id", *place))

    counts = rows.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_rows"))
    weights = source_weights(counts.select("source", "source_tokens"), "source", budget_tokens, entropy_share, max_epochs)
    sources = written(weights.join(counts.select(F.col("source").alias("s"), "source_rows"), F.col("source").eqNullSafe(F.col("s")))
                      .drop("s"), "mix-sources")
    s = sources.withColumnRenamed("source", "s")
    # the epochs that the quota touches; a hash for each
    last = F.expr("(quota + source_tokens - 1) div source_tokens - 1")
    copies = (rows.join(s, rows["source"].eqNullSafe(s["s"])).filter("quota > 0")
              .select("at", "doc_id", "source", "tokens", "source_tokens", "source_rows", "quota", "exponent", "weight", "budget",
                      F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("epoch"))
              .withColumn("hash", name("epoch")))
    leading = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    n_cells = F.ceil(F.col("source_rows") / F.lit(CELL_ROWS)).cast("long")
    copies = copies.withColumn("cell", F.shiftright(leading * n_cells, 32))
    cells = copies.groupBy("source", "epoch", "cell").agg(F.sum("tokens").alias("cell_tokens"))
    before = W.partitionBy("source", "epoch").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("cell").alias("c"),
                         F.coalesce(F.sum("cell_tokens").over(before), F.lit(0)).alias("cell_start"))
    placed = copies.join(cells, copies["source"].eqNullSafe(cells["s"]) & (F.col("epoch") == F.col("e")) & (F.col("cell") == F.col("c")))
    # cells that begin beyond the quota have no copy in the mixture
    placed = placed.filter(F.col("epoch") * F.col("source_tokens") + F.col("cell_start") < F.col("quota"))
    inside = W.partitionBy("source", "epoch", "cell").orderBy("hash", "at").rowsBetween(W.unboundedPreceding, -1)
    start = (F.col("epoch") * F.col("source_tokens") + F.col("cell_start")
             + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    n_blocks = f"((budget + {block_tokens - 1}) div {block_tokens})"
    return (placed.withColumn("token_start", start).filter("token_start < quota")
            .withColumn("block", F.expr(f"CAST(token_start AS DECIMAL(38, 0)) * {n_blocks} div quota"))
            .withColumn("block_order", name(F.lit("block"), "block", "epoch"))
            .select("at", "doc_id", "source", "tokens", "exponent", "weight", "epoch", "token_start", "block", "block_order"))


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixture: a row of ``df`` for each of its copies, with all columns of
    ``df`` and those of ``ADDED``; options as for ``plan_copies``."""
    if taken := set(ADDED) & set(df.columns):
        raise ValueError(f"columns in use: {sorted(taken)}")
    rows = located(df)
    copies = plan_copies(rows, **options).select(F.col("at").alias("_copy_at"), *ADDED)
    return rows.join(copies, rows["_at"] == copies["_copy_at"]).drop("_at", "_copy_at")
