"""Queries over preference pairs, score items, multiple choice, runs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from wagerframe.functions import checks, draws, lottery, text
from wagerframe.operators import pairs as op
from wagerframe.operators import ranking, scores
from wagerframe.operators import situations as sit
from wagerframe.plans.option_queries import six
from wagerframe.plans.registry import query, table
from wagerframe.plans.views import ITEMS_SQL, OPTIONS_SQL, PAIRS_SQL, RUNS_SQL, pairs, runs, score_items, situations
from wagerframe.sources import readers

SLIM = [
    "row_idx", "situation_id", "subset_type", "rejected_type", "length_relation", "accepted_score", "rejected_score",
    "score_margin", "predicted_preference", "is_correct", "accepted_truncated", "rejected_truncated",
]


def judged(spark, folder):
    return op.judge(op.normalise_pairs(pairs(spark, folder)))


def with_pairs(body):
    return f"WITH {PAIRS_SQL} {body}"


@query(
    "pair_outcomes",
    with_pairs(
        """SELECT row_idx, subset_type, length_relation, round(score_margin, 6) AS score_margin, predicted_preference,
        predicted_preference = 'accepted' AS is_correct, round(greatest(-score_margin, 0.0) + ln(1 + exp(-abs(score_margin))), 6) AS loss FROM pr"""
    ),
)
def pair_outcomes(spark, folder):
    return judged(spark, folder).select(
        "row_idx", "subset_type", "length_relation", six("score_margin").alias("score_margin"), "predicted_preference",
        "is_correct", six(lottery.logistic_loss(F.col("score_margin"))).alias("loss"),
    )


_C = "predicted_preference = 'accepted'"
BUNDLE = f"""round(avg(({_C})::INT), 6) AS pairwise_accuracy,
  round(avg(CASE WHEN {_C} THEN 1.0 WHEN predicted_preference = 'tie' THEN 0.5 ELSE 0.0 END), 6) AS pairwise_accuracy_ties_half_credit,
  round(avg((predicted_preference = 'tie')::INT), 6) AS tie_rate,
  round(avg(greatest(-score_margin, 0.0) + ln(1 + exp(-abs(score_margin)))), 6) AS preference_log_loss,
  round(avg(score_margin), 6) AS mean_score_margin, round(avg(abs(score_margin)), 6) AS mean_abs_score_margin,
  round(avg(accepted_score), 6) AS mean_accepted_score, round(avg(rejected_score), 6) AS mean_rejected_score,
  round(avg(accepted_truncated::INT), 6) AS accepted_truncated_rate, round(avg(rejected_truncated::INT), 6) AS rejected_truncated_rate,
  round(avg((accepted_truncated OR rejected_truncated)::INT), 6) AS truncated_pair_rate,
  round(coalesce(avg(({_C})::INT) FILTER (length_relation = 'accepted_longer'), 0.0), 6) AS pairwise_accuracy_when_accepted_longer,
  round(coalesce(avg(({_C})::INT) FILTER (length_relation = 'rejected_longer'), 0.0), 6) AS pairwise_accuracy_when_rejected_longer,
  round(coalesce(avg(({_C})::INT) FILTER (length_relation = 'same_length'), 0.0), 6) AS pairwise_accuracy_when_same_length,
  count(*)::BIGINT AS num_total, count(*) FILTER ({_C})::BIGINT AS num_correct,
  count(*) FILTER (predicted_preference = 'rejected')::BIGINT AS num_incorrect,
  count(*) FILTER (predicted_preference = 'tie')::BIGINT AS num_ties,
  count(*) FILTER (accepted_truncated OR rejected_truncated)::BIGINT AS num_truncated_pairs,
  count(length_relation)::BIGINT AS num_pairs_with_length_data, round(median(score_margin), 6) AS median_score_margin"""


def _rounded(df):
    kinds = dict(df.dtypes)
    return df.select(*[six(c).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@query("pair_metrics", with_pairs(f"SELECT {BUNDLE} FROM pr"))
def pair_metrics(spark, folder):
    return _rounded(op.pair_metrics(judged(spark, folder).select(*SLIM)))


@query(
    "pair_metrics_by_subset",
    with_pairs(
        f"SELECT subset_type, CASE subset_type WHEN 'rebels_only' THEN 1 WHEN 'steals_only' THEN 2 ELSE 3 END AS place, {BUNDLE} FROM pr GROUP BY subset_type"
    ),
)
def pair_metrics_by_subset(spark, folder):
    by_subset = op.pair_metrics(judged(spark, folder).select(*SLIM), ["subset_type"])
    return _rounded(op.dominant_order(by_subset, "subset_type", list(op.KINDS))).withColumn("place", F.col("place").cast("int"))


@query(
    "select_unique_pairs",
    with_pairs(
        "SELECT min(row_idx) AS row_idx FROM pr WHERE row_idx >= 10 GROUP BY prompt_text, chosen_full, rejected_full"
    ),
)
def select_unique_pairs(spark, folder):
    return op.select_pairs(pairs(spark, folder), "row_idx", start=10).select("row_idx")


@query(
    "pair_selection_counters",
    with_pairs(
        """SELECT sum(n)::BIGINT AS raw_pair_rows_in_slice, count(*)::BIGINT AS selected_unique_rows, sum(n - 1)::BIGINT AS exact_duplicate_rows_skipped
        FROM (SELECT count(*) AS n FROM pr GROUP BY prompt_text, chosen_full, rejected_full)"""
    ),
)
def pair_selection_counters(spark, folder):
    return op.selection_counters(pairs(spark, folder), "row_idx")


@query("keep_first_document", "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang")
def keep_first_document(spark, folder):
    return ranking.keep_first(table(spark, folder, "documents"), ["text", "lang"], "doc_id").select("doc_id", "lang")


_ALTERNATED = """, ranked AS (
  SELECT row_idx, subset_type, row_number() OVER (PARTITION BY subset_type ORDER BY row_idx) AS k FROM pr WHERE subset_type <> 'unknown'),
lead AS (SELECT CASE WHEN arg_min(subset_type, row_idx) = 'steals_only' THEN 'steals_only' ELSE 'rebels_only' END AS first_kind FROM pr),
alt AS (SELECT row_idx, subset_type, row_number() OVER (ORDER BY k, CASE WHEN subset_type = first_kind THEN 0 ELSE 1 END) AS position FROM ranked, lead)
"""


@query("alternate_subsets", with_pairs(_ALTERNATED + "SELECT row_idx, subset_type, position FROM alt"))
def alternate_subsets(spark, folder):
    typed = op.normalise_pairs(pairs(spark, folder)).select("row_idx", "subset_type")
    return ranking.alternate(typed, "subset_type", "row_idx", op.KINDS)


@query("alternate_dropped_rows", with_pairs("SELECT count(*) FILTER (subset_type = 'unknown')::BIGINT AS dropped_rows FROM pr"))
def alternate_dropped_rows(spark, folder):
    return ranking.dropped_kinds(op.normalise_pairs(pairs(spark, folder)), "subset_type", op.KINDS)


@query(
    "verb_rotation",
    with_pairs(
        """, seen AS (SELECT prompt_text, row_number() OVER (ORDER BY min(row_idx)) AS n FROM pr GROUP BY prompt_text)
        SELECT row_idx, (['select', 'choose', 'pick'])[1 + (n - 1) % 3] AS verb FROM pr JOIN seen USING (prompt_text)"""
    ),
)
def verb_rotation(spark, folder):
    rows = pairs(spark, folder).select("row_idx", "prompt_text")
    return ranking.verb_rotation(rows, "prompt_text", "row_idx", op.VERBS).select("row_idx", "verb")


@query(
    "held_out_preparation",
    with_pairs(
        """, kept AS (SELECT *, row_number() OVER (PARTITION BY replace(replace(replace(prompt_text, '\\r\\n', chr(10)), '\\n', chr(10)), '\\r', chr(10)), chosen_full, rejected_full, rejected_type ORDER BY row_idx) AS copy FROM pr),
        ranked AS (SELECT row_idx, prompt_text, subset_type, row_number() OVER (PARTITION BY subset_type ORDER BY row_idx) AS k FROM kept WHERE copy = 1),
        facts AS (SELECT arg_min(subset_type, row_idx) AS lead FROM kept WHERE copy = 1),
        alt AS (SELECT row_idx, replace(replace(replace(prompt_text, '\\r\\n', chr(10)), '\\n', chr(10)), '\\r', chr(10)) AS prompt_text, subset_type,
          row_number() OVER (ORDER BY k, CASE WHEN subset_type = CASE WHEN lead = 'steals_only' THEN 'steals_only' ELSE 'rebels_only' END THEN 0 ELSE 1 END) AS position
          FROM ranked, facts WHERE subset_type <> 'unknown'),
        seen AS (SELECT prompt_text, row_number() OVER (ORDER BY min(position)) AS n FROM alt GROUP BY prompt_text)
        SELECT row_idx, position, subset_type, (['select', 'choose', 'pick'])[1 + (n - 1) % 3] AS verb,
        md5(CASE n % 3 WHEN 1 THEN prompt_text WHEN 2 THEN regexp_replace(prompt_text, '\\bselect\\b', 'choose', 'g')
          ELSE regexp_replace(prompt_text, '\\bselect\\b', 'pick', 'g') END) AS prompt_md5 FROM alt JOIN seen USING (prompt_text)"""
    ),
)
def held_out_preparation(spark, folder):
    out = op.prepare_held_out(pairs(spark, folder))
    return out.select("row_idx", "position", "subset_type", "verb", F.md5("prompt_text").alias("prompt_md5"))


_UNIFORM = "('0x' || substr(md5('{seed}|' || {key} || '|{stream}'), 1, 13))::BIGINT / 4503599627370496.0"


def uniform_sql(seed, key, stream):
    return _UNIFORM.format(seed=seed, key=key, stream=stream)


@query(
    "representative_pairs",
    with_pairs(
        f""", q0 AS (SELECT count(*) FILTER (rejected_type = 'lin') AS lin, count(*) FILTER (rejected_type = 'too_risk') AS risk FROM pr),
        q AS (SELECT least(w, lin) AS q_lin, least(20 - w, risk) AS q_risk FROM (SELECT *, round_even(20.0 * lin / (lin + risk), 0)::INT AS w FROM q0)),
        u AS (SELECT row_idx, situation_id, rejected_type, {uniform_sql(7, 'row_idx', 'pick')} AS u FROM pr WHERE rejected_type IN ('lin', 'too_risk')),
        s AS (SELECT *, row_number() OVER (PARTITION BY rejected_type, situation_id ORDER BY u) AS seen FROM u),
        r AS (SELECT *, row_number() OVER (PARTITION BY rejected_type ORDER BY seen + u) AS r FROM s)
        SELECT row_idx, rejected_type FROM r, q WHERE r.r <= CASE rejected_type WHEN 'lin' THEN q_lin ELSE q_risk END"""
    ),
)
def representative_pairs(spark, folder):
    rows = pairs(spark, folder).select("row_idx", "situation_id", "rejected_type")
    return op.representative_sample(rows, 20, 7, F.col("row_idx")).select("row_idx", "rejected_type")


def prompted_pairs(spark, folder):
    """Pairs whose prompt lists two options computed from the document."""
    n = F.col("chosen_output_tokens")
    amount = F.coalesce(n, F.lit(100))
    prompt = F.concat(
        F.lit("Suppose so. You have the following options.\n\n(a) 20% probability of $"), F.format_number(amount, 0),
        F.lit(", 80% probability of -$5\n(b) Likely to give $"), (F.col("row_idx") % 90).cast("string"),
        F.lit(", Unlikely to give -$3\n\nYou have complete freedom to choose."),
    )
    expected = F.when(F.col("row_idx") % 10 == 0, "a").otherwise("b")
    answered = F.when(F.col("row_idx") % 14 == 0, "a").otherwise("b")
    return pairs(spark, folder).select(
        "row_idx", "situation_id",
        F.when(F.col("row_idx") % 17 != 0, prompt).otherwise("No options here.").alias("prompt_text"),
        F.concat(F.lit('<think>I weigh both.</think>{"answer":"'), expected, F.lit('"}')).alias("chosen_full"),
        "rejected_full",
        expected.alias("chosen_expected"),
        F.lit("z").alias("rejected_expected"),
        answered.alias("chosen_answer"),
        F.lit("z").alias("rejected_answer"),
        "chosen_ok", "rejected_ok",
    )


_AUDIT = """, au AS (
  SELECT row_idx, situation_id, row_idx % 17 = 0 AS unparsed,
    CASE WHEN row_idx % 10 = 0 THEN 'a' ELSE 'b' END AS ce, CASE WHEN row_idx % 14 = 0 THEN 'a' ELSE 'b' END AS ca, coalesce(chosen_ok, true) AS cok, coalesce(rejected_ok, true) AS rok,
    ln(0.2 * exp(-0.01 * least(coalesce(chosen_output_tokens, 100), 20000)) + 0.8 * exp(0.05)) AS sa,
    ln(0.8 * exp(-0.01 * (row_idx % 90)) + 0.2 * exp(0.03)) AS sb FROM pr),
flags AS (
  SELECT *, CASE WHEN abs(sa - least(sa, sb)) < 1e-10 AND abs(sb - least(sa, sb)) < 1e-10 THEN ['a', 'b'] WHEN sa < sb THEN ['a'] ELSE ['b'] END AS best FROM au),
reasons AS (
  SELECT row_idx, situation_id, list_filter([CASE WHEN unparsed THEN 'parse_failed' END,
    CASE WHEN NOT unparsed AND NOT list_contains(best, ce) THEN 'chosen_label_mismatch' END,
    CASE WHEN ca <> ce OR NOT cok THEN 'chosen_response_mismatch' END,
    CASE WHEN NOT rok THEN 'rejected_response_mismatch' END], lambda v: v IS NOT NULL) AS excluded_reason_codes FROM flags)
"""


@query("pair_audit", with_pairs(_AUDIT + "SELECT row_idx, excluded_reason_codes FROM reasons"))
def pair_audit(spark, folder):
    return op.audit(prompted_pairs(spark, folder)).select("row_idx", "excluded_reason_codes")


@query(
    "pair_audit_report",
    with_pairs(
        _AUDIT
        + """SELECT reason, count(DISTINCT situation_id)::BIGINT AS ids FROM (
        SELECT situation_id, unnest(excluded_reason_codes) AS reason FROM reasons
        UNION ALL SELECT situation_id, 'any' FROM reasons WHERE len(excluded_reason_codes) > 0) GROUP BY reason"""
    ),
)
def pair_audit_report(spark, folder):
    return op.audit_report(op.audit(prompted_pairs(spark, folder)))


@query(
    "clean_pairs",
    with_pairs(
        _AUDIT
        + """SELECT min(row_idx) AS row_idx FROM reasons WHERE situation_id NOT IN (
        SELECT situation_id FROM reasons WHERE len(excluded_reason_codes) > 0) GROUP BY situation_id"""
    ),
)
def clean_pairs(spark, folder):
    return op.clean_pairs(op.audit(prompted_pairs(spark, folder)), one_per_id=True).select("row_idx")


@query(
    "prompt_option_outcomes",
    with_pairs(
        """SELECT row_idx, 'a' AS label, 0.2 AS p, coalesce(chosen_output_tokens, 100)::DOUBLE AS x FROM pr WHERE row_idx % 17 <> 0
        UNION ALL SELECT row_idx, 'a', 0.8, -5.0 FROM pr WHERE row_idx % 17 <> 0
        UNION ALL SELECT row_idx, 'b', 0.8, (row_idx % 90)::DOUBLE FROM pr WHERE row_idx % 17 <> 0
        UNION ALL SELECT row_idx, 'b', 0.2, -3.0 FROM pr WHERE row_idx % 17 <> 0"""
    ),
)
def prompt_option_outcomes(spark, folder):
    parsed = prompted_pairs(spark, folder).select("row_idx", F.explode_outer(checks.prompt_options(F.col("prompt_text"))).alias("o"))
    flat = parsed.select("row_idx", F.col("o.label").alias("label"), F.explode_outer("o.outcomes").alias("v"))
    return flat.filter(F.col("v").isNotNull()).select("row_idx", "label", "v.p", "v.x")


@query(
    "dpo_lines",
    with_pairs(
        """SELECT row_idx, length(trim(prompt_text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS prompt_chars, rejected_type FROM pr
        WHERE trim(prompt_text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) <> ''"""
    ),
)
def dpo_lines(spark, folder):
    lines = op.dpo_lines(pairs(spark, folder), ["row_idx", "rejected_type"])
    back = lines.select(F.from_json("value", "prompt string, row_idx long, rejected_type string").alias("j"))
    return back.select("j.row_idx", F.length("j.prompt").cast("long").alias("prompt_chars"), "j.rejected_type")


def _labelled(spark, folder):
    scored = sit.score(situations(spark, folder))
    arrays = sit.label_arrays(F.col("options"), F.col("situation_id") % 2 == 0)
    return scored.select("situation_id", *[c.alias(n) for n, c in arrays.items()])


_LABEL_SQL = f"""WITH {OPTIONS_SQL}, lab AS (SELECT *, CASE WHEN situation_id % 2 = 0 THEN chr(97 + option_index) ELSE (option_index + 1)::VARCHAR END AS label FROM scored)"""


@query(
    "cooperate_pairs",
    _LABEL_SQL
    + """, c AS (SELECT situation_id, min(label) AS chosen_label FROM lab WHERE option_type = 'Cooperate' GROUP BY situation_id)
    SELECT situation_id, chosen_label, label AS rejected_label, CASE WHEN best_linear THEN 'lin' ELSE 'too_risk' END AS rejected_type
    FROM lab JOIN c USING (situation_id) WHERE option_type <> 'Cooperate' AND (best_linear OR best_high)""",
)
def cooperate_pairs(spark, folder):
    return op.preference_pairs(_labelled(spark, folder), "cooperate")


def _mode_sql(flag, kind):
    return (
        _LABEL_SQL
        + f""", s AS (SELECT situation_id, list(label ORDER BY label) FILTER (best_low) AS a, list(label ORDER BY label) FILTER ({flag}) AS b FROM lab GROUP BY situation_id),
    p AS (SELECT situation_id, a[1 + floor({uniform_sql(42, 'situation_id', 'chosen')} * len(a))::INT] AS chosen_label,
      b[1 + floor({uniform_sql(42, 'situation_id', 'rejected')} * len(b))::INT] AS rejected_label, '{kind}' AS rejected_type FROM s)
    SELECT * FROM p WHERE chosen_label <> rejected_label"""
    )


@query("cara_vs_high_pairs", _mode_sql("best_high", "too_risk"))
def cara_vs_high_pairs(spark, folder):
    return op.preference_pairs(_labelled(spark, folder), "cara_vs_high")


@query("cara_vs_linear_pairs", _mode_sql("best_linear", "lin"))
def cara_vs_linear_pairs(spark, folder):
    return op.preference_pairs(_labelled(spark, folder), "cara_vs_linear")


# --- score items -------------------------------------------------------------


def with_items(body):
    return f"WITH {ITEMS_SQL} {body}"


@query(
    "score_items",
    with_items("SELECT row_id, candidate_idx, candidate_idx < num_correct AS is_correct, length(candidate) AS chars, round(score, 4) AS score FROM item"),
)
def score_items_query(spark, folder):
    return score_items(spark, folder).select(
        "row_id", "candidate_idx", (F.col("candidate_idx") < F.col("num_correct")).alias("is_correct"),
        F.length("candidate").cast("long").alias("chars"), F.round("score", 4).alias("score"),
    )


def _best_of_items(spark, folder):
    kind = F.when(F.col("candidate_idx") == 0, "chosen").otherwise("rejected")
    return score_items(spark, folder).select("row_id", "subset", "truncated", "score", kind.alias("kind"))


_BEST = """, c AS (SELECT row_id, score AS chosen FROM item WHERE candidate_idx = 0),
  r AS (SELECT i.row_id, any_value(subset) AS subset, count(*) AS pairs, count(*) FILTER (chosen - score > 1e-6) AS wins, sum(chosen - score) AS margin_sum,
    bool_or(truncated) AS truncated FROM item i JOIN c USING (row_id) WHERE candidate_idx > 0 GROUP BY i.row_id)"""


@query(
    "best_of_n_rows",
    with_items(_BEST + "SELECT row_id, wins = pairs AS all_pairs_win, wins::BIGINT AS pairs_correct, pairs::BIGINT AS pairs, round(margin_sum, 4) AS margin_sum FROM r"),
)
def best_of_n_rows(spark, folder):
    rows = scores.best_of_rows(_best_of_items(spark, folder), ["row_id", "subset"])
    return rows.select("row_id", "all_pairs_win", "pairs_correct", "pairs", F.round("margin_sum", 4).alias("margin_sum"))


_BEST_BUNDLE = """round(avg((wins = pairs)::INT), 6) AS all_pairs_win_accuracy, round(sum(wins) / sum(pairs), 6) AS pairwise_accuracy,
  round(sum(margin_sum) / sum(pairs), 6) AS mean_margin, count(*)::BIGINT AS n_examples, sum(pairs)::BIGINT AS n_pairs, round(avg(truncated::INT), 6) AS truncated_example_rate"""


@query(
    "best_of_n_metrics",
    with_items(_BEST + f"SELECT subset, {_BEST_BUNDLE} FROM r GROUP BY subset UNION ALL SELECT NULL, {_BEST_BUNDLE} FROM r"),
)
def best_of_n_metrics(spark, folder):
    return _rounded(scores.best_of_metrics(scores.best_of_rows(_best_of_items(spark, folder), ["row_id", "subset"]), "subset"))


def _ties_items(spark, folder):
    items = score_items(spark, folder)
    return items.withColumn("is_correct", F.col("candidate_idx") < F.col("num_correct"))


_TIES = """, t AS (SELECT row_id, any_value(sample_type) AS sample_type, any_value(prompt_id) AS prompt_id,
    max(score) FILTER (candidate_idx < num_correct) AS bc, min(score) FILTER (candidate_idx < num_correct) AS wc,
    max(score) FILTER (candidate_idx >= num_correct) AS bi, count(*) FILTER (candidate_idx < num_correct) AS nc FROM item GROUP BY row_id),
  tr AS (SELECT row_id, sample_type, prompt_id, CASE WHEN nc > 1 THEN bc - wc END AS d, wc - bi AS m, wc > bi AS ok FROM t WHERE bc IS NOT NULL AND bi IS NOT NULL)"""


@query(
    "ties_rows",
    with_items(_TIES + "SELECT row_id, sample_type, round(d, 6) AS diff_correct_margin, round(m, 6) AS correct_incorrect_margin, ok AS accurate FROM tr"),
)
def ties_rows(spark, folder):
    return _rounded(scores.ties_rows(_ties_items(spark, folder)).drop("prompt_id", "truncated"))


@query(
    "ties_metrics",
    with_items(
        _TIES
        + """, s AS (SELECT r.m AS rm, t.m AS tm, t.d AS d FROM tr r JOIN tr t ON r.prompt_id = t.prompt_id AND r.sample_type = 'ref' AND t.sample_type = 'tied'),
        k AS (SELECT count(*)::BIGINT AS n_shared_prompts, count(d)::BIGINT AS n_shared_prompts_usable, coalesce(avg((tm > d)::INT) FILTER (d IS NOT NULL), 0.0) AS cp,
          coalesce(avg((least(rm, tm) > d)::INT) FILTER (d IS NOT NULL), 0.0) AS ch,
          coalesce(avg(CASE WHEN d = 0 THEN 0.0 ELSE (1 - exp(-2 * (least(rm, tm) / d - 1))) / (1 + exp(-2 * (least(rm, tm) / d - 1))) END) FILTER (d IS NOT NULL), 0.0) AS cm FROM s),
        a AS (SELECT count(*) FILTER (sample_type = 'ref')::BIGINT AS n_ref_rows, count(*) FILTER (sample_type = 'tied')::BIGINT AS n_tied_rows,
          coalesce(avg(ok::INT) FILTER (sample_type = 'ref'), 0.0) AS ra, coalesce(avg(ok::INT) FILTER (sample_type = 'tied'), 0.0) AS ta FROM tr)
        SELECT n_ref_rows, n_tied_rows, n_shared_prompts, n_shared_prompts_usable, round(ra, 6) AS ref_accuracy, round(ta, 6) AS tied_accuracy,
          round(cp, 6) AS correctness_preferred, round(ch, 6) AS correctness_preferred_hard, round(cm, 6) AS correctness_margin_score,
          round(0.3 * ta + 0.3 * ra + 0.2 * cp + 0.2 * ch + 0.01 * cm, 6) AS overall_score FROM a, k"""
    ),
)
def ties_metrics(spark, folder):
    return _rounded(scores.ties_metrics(scores.ties_rows(_ties_items(spark, folder))))


@query(
    "combined_score",
    with_items(_BEST + "SELECT round(avg(s), 6) AS combined_score FROM (SELECT avg((wins = pairs)::INT) AS s FROM r GROUP BY subset)"),
)
def combined_score(spark, folder):
    by_subset = scores.best_of_metrics(scores.best_of_rows(_best_of_items(spark, folder), ["row_id", "subset"]), "subset")
    return _rounded(scores.combined_score(by_subset.filter(F.col("subset").isNotNull()), "all_pairs_win_accuracy"))


# --- multiple choice ---------------------------------------------------------


def _mcq(spark, folder):
    p = table(spark, folder, "part")
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    given = F.get(letters, (F.col("p_partkey") % 4).cast("int"))
    form = F.col("p_partkey") % 5
    answer = (
        F.when(form == 0, F.concat(F.lit("<think>B or C?</think>\nAnswer: "), given))
        .when(form == 1, F.concat(F.lit("The final answer - ("), F.lower(given), F.lit(")")))
        .when(form == 2, F.concat(F.lit("My pick:\n("), given, F.lit(")\n")))
        .when(form == 3, F.concat(F.lit("I take "), given, F.lit(" here")))
        .otherwise(F.lit("no idea"))
    )
    return p.select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("subject"), F.col("p_name").alias("question"),
        F.col("p_type").alias("kind"), F.get(letters, F.col("p_size") % 4).alias("correct_answer"), answer.alias("response"),
    )


_MCQ = """WITH mcq AS (SELECT p_partkey AS item_id, p_brand AS subject, p_name AS question, (['A', 'B', 'C', 'D'])[1 + p_size % 4] AS correct_answer,
  CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 1 THEN (['a', 'b', 'c', 'd'])[1 + p_partkey % 4] ELSE (['A', 'B', 'C', 'D'])[1 + p_partkey % 4] END AS predicted FROM part),
  g AS (SELECT *, coalesce(upper(predicted) = correct_answer, false) AS ok,
    CASE substr(subject, length(subject), 1) WHEN '1' THEN 'stem' WHEN '2' THEN 'humanities' WHEN '3' THEN 'social_sciences' ELSE 'other' END AS category FROM mcq) """


@query("mcq_answers", _MCQ + "SELECT item_id, predicted AS predicted_answer, ok AS correct FROM g")
def mcq_answers(spark, folder):
    graded = scores.grade(_mcq(spark, folder), checks.mcq_answer(F.col("response")))
    return graded.select("item_id", "predicted_answer", "correct")


_ACC = "round_even(count(*) FILTER (ok) / count(*), 4) AS accuracy, count(*) FILTER (ok)::BIGINT AS correct, count(*)::BIGINT AS total, count(*) FILTER (predicted IS NULL)::BIGINT AS parse_failures"


_CATEGORY = {"1": "stem", "2": "humanities", "3": "social_sciences"}


def _categories(spark, folder):
    last = F.substring("p_brand", -1, 1)
    name = F.coalesce(*[F.when(last == digit, category) for digit, category in _CATEGORY.items()])
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("subject")).agg(F.min(name).alias("category"))


@query(
    "subjects_by_accuracy",
    _MCQ
    + f"""SELECT subject, accuracy, row_number() OVER (ORDER BY accuracy, subject)::BIGINT AS place
    FROM (SELECT subject, {_ACC} FROM g GROUP BY subject)""",
)
def subjects_by_accuracy(spark, folder):
    graded = scores.grade(_mcq(spark, folder), checks.mcq_answer(F.col("response")))
    found = scores.accuracy_by_subject(graded.select("subject", "correct", "predicted_answer"), _categories(spark, folder))
    return scores.by_accuracy(found).select("subject", "accuracy", "place")


_SUBJECTS = ["Brand#31", "Brand#12", "Brand#54", "Brand#23"]


@query(
    "mcq_of_subjects",
    f"""SELECT p_partkey AS item_id, p_brand AS subject, p_name AS question, list_position({_SUBJECTS}, p_brand)::INT AS subject_place
    FROM part WHERE p_brand IN {tuple(_SUBJECTS)}""",
)
def mcq_of_subjects(spark, folder):
    """The multiple-choice items of a list of subjects."""
    return readers.read_subjects(_mcq(spark, folder), _SUBJECTS).select("item_id", "subject", "question", "subject_place")


@query(
    "mcq_accuracy",
    _MCQ
    + f"""SELECT 'subject' AS level, category, subject, {_ACC} FROM g GROUP BY category, subject UNION ALL
    SELECT 'category', category, NULL, {_ACC} FROM g GROUP BY category UNION ALL SELECT 'overall', NULL, NULL, {_ACC} FROM g""",
)
def mcq_accuracy(spark, folder):
    graded = scores.grade(_mcq(spark, folder), checks.mcq_answer(F.col("response")))
    return scores.accuracy_by_subject(graded.select("subject", "correct", "predicted_answer"), _categories(spark, folder))


@query(
    "mcq_few_shot_items",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
    pre AS (SELECT p_brand, string_agg(trim(p_name) || chr(10) || 'Answer: ' || (['A', 'B', 'C', 'D'])[1 + p_size % 4] || chr(10) || chr(10), '' ORDER BY k) AS prefix FROM r WHERE k <= 2 GROUP BY p_brand)
    SELECT p_partkey AS item_id, p_brand AS subject, prefix || trim(p_name) AS prompt,
      row_number() OVER (ORDER BY p_partkey) AS item_index FROM r JOIN pre USING (p_brand) WHERE k > 2""",
)
def mcq_few_shot_items(spark, folder):
    """First two rows of a subject make its examples; the others are its items."""
    ranked = ranking.rank_within(_mcq(spark, folder), ["subject"], [F.col("item_id")], "k")
    shot = F.concat(F.trim("question"), F.lit("\nAnswer: "), "correct_answer", F.lit("\n\n"))
    examples = ranked.filter(F.col("k") <= 2).groupBy("subject").agg(  # two rows per subject
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", shot.alias("shot")))), lambda s: s["shot"]), "").alias("prefix")
    )
    items = ranked.filter(F.col("k") > 2).join(examples, "subject")
    prompts = items.select("item_id", "subject", F.concat("prefix", F.trim("question")).alias("prompt"))
    return ranking.dense_index(prompts, [F.col("item_id")], "item_index")


# --- runs --------------------------------------------------------------------


def with_runs(body):
    return f"WITH {RUNS_SQL} {body}"


@query("seed_summary", with_runs("SELECT phase, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value)::BIGINT AS n_seeds FROM runs GROUP BY phase, metric"))
def seed_summary(spark, folder):
    return _rounded(scores.seed_summary(runs(spark, folder), ["phase", "metric"], "value"))


@query(
    "run_status_counts",
    with_runs(
        """SELECT status, count(*)::BIGINT AS runs FROM (
        SELECT phase, lr, seed, arg_max(status, (ts, seq)) AS status FROM runs GROUP BY phase, lr, seed) GROUP BY status"""
    ),
)
def run_status_counts(spark, folder):
    """Latest state per (phase, rate tag, seed), counted by status."""
    ledger = runs(spark, folder).withColumn("lr_tag", text.rate_tag(F.col("lr")))
    newest = ranking.latest(ledger.select("phase", "lr_tag", "seed", "ts", "seq", "status"), ["phase", "lr_tag", "seed"], ["ts", "seq"])
    return newest.groupBy("status").agg(F.count("*").alias("runs"))


@query(
    "run_lookup",
    with_runs(
        """, newest AS (SELECT phase, lr, seed, arg_max(status, (ts, seq)) AS status FROM runs GROUP BY phase, lr, seed),
        wanted AS (SELECT DISTINCT phase, lr, unnest([1, 2, 3, 4]) AS seed FROM runs)
        SELECT phase, lr, seed, coalesce(status, 'missing') AS status FROM wanted LEFT JOIN newest USING (phase, lr, seed)"""
    ),
)
def run_lookup(spark, folder):
    """State of every phase and rate with four seeds, of which one was never run."""
    ledger = runs(spark, folder)
    seeds = F.explode(F.array(*[F.lit(s) for s in (1, 2, 3, 4)])).alias("seed")
    wanted = ledger.select("phase", "lr").distinct().select("phase", "lr", seeds)
    return scores.find_runs(ledger, wanted, ["phase", "lr", "seed"], ["ts", "seq"])


@query(
    "run_ledger_overlay",
    with_runs(
        """, prior AS (SELECT phase, lr, seed, arg_max(status, seq) AS status FROM runs WHERE k < 50 AND phase = 'validation' GROUP BY ALL),
        plan AS (SELECT DISTINCT phase, lr, seed FROM runs)
        SELECT coalesce(p.phase, q.phase) AS phase, coalesce(p.lr, q.lr) AS lr, coalesce(p.seed, q.seed) AS seed, coalesce(q.status, 'pending') AS status
        FROM plan p FULL JOIN prior q ON p.phase = q.phase AND p.lr = q.lr AND p.seed = q.seed"""
    ),
)
def run_ledger_overlay(spark, folder):
    """Planned runs under the state of an earlier ledger; earlier unplanned runs stay."""
    ledger = runs(spark, folder)
    keys = ["phase", "lr", "seed"]
    prior = ranking.latest(
        ledger.filter((F.col("k") < 50) & (F.col("phase") == "validation")).select(*keys, "seq", "status"), keys, ["seq"]
    ).drop("seq")
    planned = ledger.select(*keys).distinct()
    return planned.join(prior, keys, "full").withColumn("status", F.coalesce("status", F.lit("pending")))


@query(
    "best_learning_rate",
    with_runs(
        """, s AS (SELECT lr, avg(value) FILTER (metric = 'click') AS accuracy, avg(value) FILTER (metric = 'view') AS margin FROM runs WHERE seed = 1 GROUP BY lr)
        SELECT lr AS best_lr FROM s WHERE accuracy IS NOT NULL ORDER BY accuracy DESC, margin DESC, lr LIMIT 1"""
    ),
)
def best_learning_rate(spark, folder):
    first = runs(spark, folder).filter(F.col("seed") == 1)
    by_rate = first.groupBy("lr").agg(
        F.avg(F.when(F.col("metric") == "click", F.col("value"))).alias("accuracy"),
        F.avg(F.when(F.col("metric") == "view", F.col("value"))).alias("margin"),
    )
    return scores.best_rate(by_rate.withColumn("seed", F.lit(1)).withColumn("status", F.lit("succeeded")))


@query(
    "best_checkpoint",
    with_runs(
        """, c AS (SELECT run AS checkpoint, avg((metric <> 'error')::INT) AS parse_rate, avg(value) AS score FROM runs GROUP BY run)
        SELECT checkpoint, CASE WHEN parse_rate >= 0.8 THEN 'parse_floor_satisfied' ELSE 'parse_floor_unmet_fallback' END AS reason FROM c
        ORDER BY parse_rate >= 0.8 DESC, CASE WHEN parse_rate >= 0.8 THEN score ELSE parse_rate END DESC, CASE WHEN parse_rate >= 0.8 THEN parse_rate ELSE score END DESC, checkpoint DESC LIMIT 1"""
    ),
)
def best_checkpoint(spark, folder):
    records = runs(spark, folder).groupBy(F.col("run").alias("checkpoint")).agg(
        F.avg((F.col("metric") != "error").cast("int")).alias("parse_rate"), F.avg("value").alias("score")
    )
    full = records.select("*", F.lit(0.0).alias("cooperate_rate"), F.lit(0.0).alias("best_cara_rate"), F.col("checkpoint").alias("step"))
    return scores.best_checkpoint(full, "score", 0.8)


@query(
    "ok_rate_and_retries",
    with_runs("SELECT phase, k % 5 AS retries, count(*)::BIGINT AS answers, round(avg((status = 'succeeded')::INT), 6) AS ok_rate FROM runs GROUP BY phase, k % 5"),
)
def ok_rate_and_retries(spark, folder):
    return _rounded(
        runs(spark, folder).groupBy("phase", (F.col("k") % 5).alias("retries")).agg(
            F.count("*").alias("answers"), F.avg((F.col("status") == "succeeded").cast("int")).alias("ok_rate")
        )
    )


@query(
    "candidate_runs",
    "SELECT r_regionkey AS rung, unnest([1, 2, 3]) AS seed FROM region",
)
def candidate_runs(spark, folder):
    """Each candidate rate with each planned seed."""
    seeds = F.array(*[F.lit(s) for s in (1, 2, 3)])
    return table(spark, folder, "region").select(F.col("r_regionkey").alias("rung"), F.explode(seeds).alias("seed"))


@query(
    "ladder_neighbours",
    "SELECT r_regionkey AS rung, lag(r_regionkey) OVER (ORDER BY r_regionkey) AS below, lead(r_regionkey) OVER (ORDER BY r_regionkey) AS above FROM region",
)
def ladder_neighbours(spark, folder):
    """Rungs next to each rung of a short ladder, as a join on the rung number."""
    rungs = ranking.dense_index(table(spark, folder, "region").select(F.col("r_regionkey").alias("rung")), [F.col("rung")], "at")
    below = rungs.select(F.col("rung").alias("below"), (F.col("at") + 1).alias("at"))
    above = rungs.select(F.col("rung").alias("above"), (F.col("at") - 1).alias("at"))
    return rungs.join(below, "at", "left").join(above, "at", "left").select("rung", "below", "above")


# --- vectors -----------------------------------------------------------------

_VECTORS = """WITH v AS (SELECT a.label AS layer, a.embedding AS ch, b.embedding AS re FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
  c AS (SELECT layer, unnest(range(len(ch))) AS pos, ch, re FROM v),
  m AS (SELECT layer, pos, avg(ch[pos + 1]::DOUBLE - re[pos + 1]::DOUBLE) AS mean, count(*) AS n FROM c GROUP BY layer, pos)"""


@query(
    "mean_difference_vectors",
    _VECTORS
    + """, w AS (SELECT layer, sqrt(sum(mean * mean)) AS norm, max(n)::BIGINT AS n_pairs, list(round(mean, 5) ORDER BY pos) AS direction FROM m GROUP BY layer),
    u AS (SELECT layer, list(round(mean / norm, 5) ORDER BY pos) AS unit FROM m JOIN w USING (layer) GROUP BY layer),
    p AS (SELECT layer, a.vec_id, sqrt(sum(pow(x::DOUBLE - y::DOUBLE, 2))) AS gap, sqrt(sum(pow(x::DOUBLE, 2))) AS chosen
      FROM (SELECT a.label AS layer, a.vec_id, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) a
      GROUP BY layer, a.vec_id),
    q AS (SELECT layer, round(avg(gap), 5) AS mean_gap_norm, round(avg(chosen), 5) AS mean_chosen_norm FROM p GROUP BY layer)
    SELECT layer, round(norm, 5) AS norm, n_pairs, direction, unit, mean_gap_norm, mean_chosen_norm FROM w JOIN u USING (layer) JOIN q USING (layer)""",
)
def mean_difference_vectors(spark, folder):
    e = table(spark, folder, "embeddings")
    chosen = e.filter(F.col("vec_id") % 2 == 0).select("vec_id", F.col("label").alias("layer"), F.col("embedding").alias("chosen"))
    rejected = e.filter(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("rejected"))
    out = scores.mean_difference(chosen.join(rejected, "vec_id"), ["layer"])
    return out.select(
        "layer",
        F.round("norm", 5).alias("norm"),
        "n_pairs",
        *[F.transform(c, lambda v: F.round(v, 5)).alias(c) for c in ("direction", "unit")],
        *[F.round(c, 5).alias(c) for c in ("mean_gap_norm", "mean_chosen_norm")],
    )


@query(
    "steering_contrasts",
    f"SELECT vec_id, label FROM embeddings WHERE label = 0 ORDER BY {uniform_sql(11, 'vec_id', 'contrast')} LIMIT 100",
)
def steering_contrasts(spark, folder):
    """A seeded top-n of non-null contrasts."""
    e = table(spark, folder, "embeddings").filter((F.col("label") == 0) & F.col("embedding").isNotNull())
    return ranking.smallest(e, 100, draws.uniform(11, F.col("vec_id"), "contrast"), [F.col("vec_id")]).select("vec_id", "label")
