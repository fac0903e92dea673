"""Metrics over model scores: best-of-N, ties, multiple choice, runs, vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wagerframe.operators import ranking

TIE_EPSILON = 1e-6
# Weights of the ties score.
TIES_WEIGHTS = {
    "tied_accuracy": 0.30,
    "ref_accuracy": 0.30,
    "correctness_preferred": 0.20,
    "correctness_preferred_hard": 0.20,
    "correctness_margin_score": 0.01,
}


def best_of_rows(items: DataFrame, keys: list[str], tie_epsilon: float = TIE_EPSILON) -> DataFrame:
    """Per row: chosen score against each rejected one, without forming the pairs.

    The chosen score is the same for all pairs of a row, so wins follow from the
    rejected scores' maximum, and counts from one pass that carries the chosen
    score to its rivals through a join on the row.
    """
    chosen = items.filter(F.col("kind") == "chosen").groupBy(*keys).agg(F.max("score").alias("_chosen"), F.max("truncated").alias("_cut_c"))
    rivals = items.filter(F.col("kind") == "rejected").join(chosen, keys)
    margin = F.col("_chosen") - F.col("score")
    return rivals.groupBy(*keys).agg(
        F.count_if(margin > tie_epsilon).alias("pairs_correct"),
        F.count("*").alias("pairs"),
        F.sum(margin).alias("margin_sum"),
        (F.max(F.col("truncated")) | F.max("_cut_c")).alias("truncated"),
    ).withColumn("all_pairs_win", F.col("pairs_correct") == F.col("pairs"))


def best_of_metrics(rows: DataFrame, subset: str) -> DataFrame:
    """Per subset and over all (subset null)."""
    return rows.rollup(subset).agg(
        F.avg(F.col("all_pairs_win").cast("int")).alias("all_pairs_win_accuracy"),
        (F.sum("pairs_correct") / F.sum("pairs")).alias("pairwise_accuracy"),
        (F.sum("margin_sum") / F.sum("pairs")).alias("mean_margin"),
        F.count("*").alias("n_examples"),
        F.sum("pairs").alias("n_pairs"),
        F.avg(F.col("truncated").cast("int")).alias("truncated_example_rate"),
    )


def ties_rows(items: DataFrame) -> DataFrame:
    """Per row: worst correct against best incorrect, and the spread of the correct ones."""
    correct = F.col("is_correct")
    stats = items.groupBy("row_id", "sample_type", "prompt_id").agg(
        F.max(F.when(correct, F.col("score"))).alias("best_correct"),
        F.min(F.when(correct, F.col("score"))).alias("worst_correct"),
        F.max(F.when(~correct, F.col("score"))).alias("best_incorrect"),
        F.count_if(correct).alias("_n_correct"),
        F.max("truncated").alias("truncated"),
    )
    return stats.filter(F.col("best_correct").isNotNull() & F.col("best_incorrect").isNotNull()).select(
        "row_id",
        "sample_type",
        "prompt_id",
        F.when(F.col("_n_correct") > 1, F.col("best_correct") - F.col("worst_correct")).alias("diff_correct_margin"),
        (F.col("worst_correct") - F.col("best_incorrect")).alias("correct_incorrect_margin"),
        (F.col("worst_correct") > F.col("best_incorrect")).alias("accurate"),
        "truncated",
    )


def ties_metrics(rows: DataFrame) -> DataFrame:
    """Reference and tied accuracy, preference over the spread, and the weighted score."""
    is_ref = F.col("sample_type") == "ref"
    by_prompt = rows.groupBy("prompt_id").agg(
        F.max_by(F.when(is_ref, F.struct("accurate", "correct_incorrect_margin")), F.when(is_ref, F.col("row_id"))).alias("ref"),
        F.max_by(
            F.when(~is_ref, F.struct("accurate", "correct_incorrect_margin", "diff_correct_margin")),
            F.when(~is_ref, F.col("row_id")),
        ).alias("tied"),
    )
    shared = F.col("ref").isNotNull() & F.col("tied").isNotNull()
    spread = F.col("tied.diff_correct_margin")
    usable = shared & spread.isNotNull()
    gap = F.col("tied.correct_incorrect_margin")
    least = F.least(F.col("ref.correct_incorrect_margin"), gap)
    term = F.when(spread == 0, 0.0).otherwise(F.tanh(F.try_divide(least, spread) - 1))

    def rate(flag: Column, among: Column) -> Column:
        return F.coalesce(F.avg(F.when(among, F.when(flag, 1.0).otherwise(0.0))), F.lit(0.0))

    sums = by_prompt.agg(
        F.count("ref").alias("n_ref_rows"),
        F.count("tied").alias("n_tied_rows"),
        F.count_if(shared).alias("n_shared_prompts"),
        F.count_if(usable).alias("n_shared_prompts_usable"),
        rate(F.col("ref.accurate"), F.col("ref").isNotNull()).alias("ref_accuracy"),
        rate(F.col("tied.accurate"), F.col("tied").isNotNull()).alias("tied_accuracy"),
        rate(gap > spread, usable).alias("correctness_preferred"),
        rate(least > spread, usable).alias("correctness_preferred_hard"),
        F.coalesce(F.avg(F.when(usable, term)), F.lit(0.0)).alias("correctness_margin_score"),
    )
    score = F.lit(0.0)
    for name, weight in TIES_WEIGHTS.items():
        score = score + F.col(name) * weight
    return sums.withColumn("overall_score", score)


def combined_score(components: DataFrame, column: str) -> DataFrame:
    """Mean of the component scores that exist; null without any."""
    return components.agg(F.avg(column).alias("combined_score"))


def accuracy_by_subject(graded: DataFrame, categories: DataFrame) -> DataFrame:
    """Accuracy per subject, per category and overall; unknown subjects count as ``other``.

    ``categories`` is the small subject dimension of the benchmark.
    """
    per_subject = graded.groupBy("subject").agg(
        F.count_if(F.col("correct")).alias("correct"),
        F.count("*").alias("total"),
        F.count_if(F.col("predicted_answer").isNull()).alias("parse_failures"),
    )
    known = per_subject.join(categories, "subject", "left").withColumn("category", F.coalesce("category", F.lit("other")))
    return (
        known.rollup("category", "subject")
        .agg(*[F.sum(c).alias(c) for c in ("correct", "total", "parse_failures")], F.grouping_id().alias("_g"))
        .withColumn("level", F.when(F.col("_g") == 0, "subject").when(F.col("_g") == 1, "category").otherwise("overall"))
        .withColumn("accuracy", F.bround(F.col("correct") / F.col("total"), 4))
        .drop("_g")
    )


def by_accuracy(accuracy: DataFrame, level: str = "subject", parts: int | None = None) -> DataFrame:
    """The rows of one level with their place from the lowest accuracy up; ties follow the name."""
    rows = accuracy.filter(F.col("level") == level)
    return ranking.dense_index(rows, [F.col("accuracy"), F.col(level)], "place", parts=parts)


def grade(items: DataFrame, predicted: Column) -> DataFrame:
    return items.withColumn("predicted_answer", predicted).withColumn(
        "correct", F.coalesce(F.upper("predicted_answer") == F.upper("correct_answer"), F.lit(False))
    )


def seed_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (null for one run) and number of runs."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_seeds")
    )


def best_rate(runs: DataFrame) -> DataFrame:
    """Best learning rate: highest accuracy, then highest margin, over succeeded first-seed runs."""
    usable = runs.filter((F.col("status") == "succeeded") & (F.col("seed") == 1) & F.col("accuracy").isNotNull())
    return usable.agg(F.max_by("lr", F.struct("accuracy", F.coalesce("margin", F.lit(0.0)), -F.col("lr"))).alias("best_lr"))


def best_checkpoint(records: DataFrame, metric: str, floor: float) -> DataFrame:
    """Best record above the parse floor, else the best by parse rate."""
    zero = F.lit(0.0)

    def value(name: str) -> Column:
        return F.coalesce(F.col(name), zero)

    passes = value("parse_rate") >= floor
    rest = [value("cooperate_rate").alias("c"), value("best_cara_rate").alias("d"), F.col("step").alias("e")]
    first, second = value(metric), value("parse_rate")
    order = F.struct(
        passes.alias("p"),
        F.when(passes, first).otherwise(second).alias("a"),
        F.when(passes, second).otherwise(first).alias("b"),
        *rest,
    )
    return records.agg(F.max_by(F.struct("checkpoint", passes.alias("passes")), order).alias("_b")).select(
        F.col("_b.checkpoint").alias("checkpoint"),
        F.when(F.col("_b.passes"), "parse_floor_satisfied").otherwise("parse_floor_unmet_fallback").alias("reason"),
    )


def find_runs(ledger: DataFrame, wanted: DataFrame, keys: list[str], sequence: list[str], state: str = "status") -> DataFrame:
    """The newest state of every wanted run, ``missing`` where the ledger has none; keys may be null."""
    newest = ranking.latest(ledger.select(*keys, *sequence, state), keys, sequence)
    found = newest.select(*[F.col(k).alias("_l_" + k) for k in keys], state)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_l_" + k))
    return wanted.select(*keys).distinct().join(found, same, "left").select(*keys, F.coalesce(state, F.lit("missing")).alias(state))


def mean_difference(contrasts: DataFrame, keys: list[str]) -> DataFrame:
    """Steering direction per key: mean of ``chosen - rejected``, its norm and unit vector.

    Vectors are summed whole by a partial aggregate, so one vector per key leaves
    each task. Vectors of one key must have the same length; null ones, and those
    with a null element, are left out.
    """

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))

    chosen, rejected = (F.col(c).cast("array<double>") for c in ("chosen", "rejected"))
    whole = F.coalesce(F.forall(F.concat(chosen, rejected), lambda x: x.isNotNull()), F.lit(False))
    gap = F.zip_with(chosen, rejected, lambda a, b: a - b)
    pairs = contrasts.filter(whole).select(*keys, gap.alias("gap"), norm(gap).alias("gap_norm"), norm(chosen).alias("chosen_norm"))
    out = pairs.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector("gap"))).alias("direction"),
        F.avg("gap_norm").alias("mean_gap_norm"),
        F.avg("chosen_norm").alias("mean_chosen_norm"),
        F.count("*").alias("n_pairs"),
    )
    out = out.withColumn("norm", norm(F.col("direction")))
    return out.withColumn("unit", F.transform("direction", lambda v: F.try_divide(v, F.col("norm"))))
