"""Queries over options and situations (lottery mathematics, labels, guards)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wagerframe.functions import formats, lottery, text
from wagerframe.operators import situations as sit
from wagerframe.plans.registry import query, table
from wagerframe.plans.views import cents_sql, drafts, exact_prizes, options, rsig, situations, with_options

KEY = ["situation_id", "option_index"]


def six(column):
    return F.round(column, 6)


@query(
    "explode_options_json",
    with_options(
        "SELECT situation_id, option_index, option_type, num_options, list_sum(xs) AS prize_total, list_sum(ps)::BIGINT AS percent_total FROM opt"
    ),
)
def explode_options_json(spark, folder):
    wide = situations(spark, folder).select(
        "situation_id",
        F.to_json(
            F.transform(
                "options",
                lambda o: F.struct(
                    o["option_type"].alias("option_type"), o["prizes"].alias("prizes"), o["probs"].alias("probabilities_percent")
                ),
            )
        ).alias("options_json"),
    )
    flat = sit.explode_options(wide)
    return flat.select(
        *KEY, "option_type", "num_options",
        lottery.sum_of(F.col("prizes")).alias("prize_total"),
        lottery.sum_of(F.col("probabilities_percent"), 0).cast("long").alias("percent_total"),
    )


@query(
    "nest_options",
    with_options("SELECT situation_id, any_value(num_options) AS num_options, list(option_type ORDER BY option_index) AS types FROM opt GROUP BY situation_id"),
)
def nest_options(spark, folder):
    flat = options(spark, folder)
    nested = sit.nest(flat, "situation_id", "option_index", ["num_options"], ["option_type", "prizes", "probs"])
    return nested.select("situation_id", "num_options", F.transform("options", lambda o: o["option_type"]).alias("types"))


@query(
    "options_with_prompts",
    with_options(
        """SELECT situation_id, option_index, option_type, raw_subset, length(text)::INT AS prompt_chars, text IS NOT NULL AS has_prompt
        FROM opt LEFT JOIN (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rebel-cooperate' WHEN 1 THEN 'steals_only' END AS s, text FROM documents)
        ON situation_id = doc_id AND raw_subset IS NOT DISTINCT FROM s"""
    ),
)
def options_with_prompts(spark, folder):
    """Option rows joined to the prompts of their situation and subset."""
    kind = F.col("doc_id") % 3
    prompts = table(spark, folder, "documents").select(
        F.col("doc_id").alias("situation_id"),
        F.when(kind == 0, "rebel-cooperate").when(kind == 1, "steals_only").alias("raw_subset"),
        F.col("text").alias("prompt_text"),
    )
    joined = sit.attach_prompts(options(spark, folder), prompts, ["situation_id", "raw_subset"])
    return joined.select(
        *KEY, "option_type", "raw_subset", F.char_length("prompt_text").alias("prompt_chars"), F.col("prompt_text").isNotNull().alias("has_prompt")
    )


@query(
    "lottery_merge",
    with_options(
        "SELECT situation_id, option_index, x, round(sum(p) / 100.0, 6) AS p FROM outc GROUP BY situation_id, option_index, x"
    ),
)
def lottery_merge(spark, folder):
    flat = options(spark, folder)
    return flat.select(*KEY, F.inline_outer(lottery.merged(F.col("prizes"), F.col("probs")))).select(*KEY, "x", six("p").alias("p"))


@query("expected_value", with_options("SELECT situation_id, option_index, round(ev, 4) AS expected_value FROM opt"))
def expected_value(spark, folder):
    return options(spark, folder).select(*KEY, F.round(lottery.expected_value(F.col("prizes"), F.col("probs")), 4).alias("expected_value"))


@query(
    "expected_utility",
    with_options(
        "SELECT situation_id, option_index, round(ev, 4) AS linear, ln(1 + abs(low)).round(6) AS low_alpha, ln(1 + abs(high)).round(6) AS high_alpha FROM opt"
    ),
)
def expected_utility(spark, folder):
    x, p = F.col("prizes"), F.col("probs")

    def squeezed(alpha):
        return six(F.ln(1 + F.abs(lottery.expected_utility(x, p, lottery.cara(alpha)))))

    return options(spark, folder).select(
        *KEY,
        F.round(lottery.expected_utility(x, p), 4).alias("linear"),
        squeezed(lottery.LOW_ALPHA).alias("low_alpha"),
        squeezed(lottery.HIGH_ALPHA).alias("high_alpha"),
    )


@query(
    "cara_rank_score",
    with_options(
        """, terms AS (SELECT situation_id, option_index, ln(p) - 0.01 * x AS t FROM outc WHERE p > 0),
        tops AS (SELECT *, max(t) OVER (PARTITION BY situation_id, option_index) AS top FROM terms)
        SELECT situation_id, option_index, round(any_value(top) + ln(sum(exp(t - top))), 6) AS score
        FROM tops GROUP BY situation_id, option_index"""
    ),
)
def cara_rank_score(spark, folder):
    return options(spark, folder).select(*KEY, six(lottery.cara_rank_score(F.col("prizes"), F.col("probs"))).alias("score"))


@query(
    "best_sets",
    with_options("SELECT situation_id, option_index, best_linear, best_low, best_high, worst_linear FROM scored"),
)
def best_sets(spark, folder):
    return (
        sit.score(situations(spark, folder))
        .select("situation_id", F.inline_outer("options"))
        .select(*KEY, "best_linear", "best_low", "best_high", "worst_linear")
    )


@query(
    "best_sets_exact",
    with_options(
        """SELECT situation_id, option_index, abs(ev - max(ev) OVER s) < 1e-12 AS best_linear,
        abs(low - max(low) OVER s) < 1e-12 AS best_low FROM opt WINDOW s AS (PARTITION BY situation_id)"""
    ),
)
def best_sets_exact(spark, folder):
    return (
        sit.score(situations(spark, folder), "exact")
        .select("situation_id", F.inline_outer("options"))
        .select(*KEY, "best_linear", "best_low")
    )


@query(
    "display_rounding",
    with_options(
        f"""SELECT situation_id, option_index, i AS outcome, {rsig('x_exact', '2')} + 0.0 AS two, {rsig('x_exact', '3')} + 0.0 AS three,
        {cents_sql(rsig('x_exact', '4'))} + 0.0 AS four_cents, {cents_sql('x_exact')} + 0.0 AS plain_cents FROM outc"""
    ),
)
def display_rounding(spark, folder):
    flat = drafts(spark, folder).select("situation_id", "price", F.inline_outer("drafts"))
    flat = flat.select(*KEY, F.posexplode_outer(exact_prizes(F.col("h"), F.col("price"))).alias("outcome", "x"))
    x = F.col("x")
    return flat.select(
        *KEY, "outcome",
        (lottery.round_significant(x, 2) + 0.0).alias("two"),
        (lottery.round_significant(x, 3) + 0.0).alias("three"),
        (lottery.display_round(x, F.lit("4sf")) + 0.0).alias("four_cents"),
        (lottery.display_round(x, F.lit("none")) + 0.0).alias("plain_cents"),
    )


@query("percent_normalise", with_options("SELECT situation_id, option_index, i AS outcome, p::INT AS p FROM outc"))
def percent_normalise(spark, folder):
    flat = options(spark, folder)
    return flat.select(*KEY, F.posexplode_outer("probs").alias("outcome", "p"))


@query(
    "merge_shown_prizes",
    with_options(
        """SELECT situation_id, option_index, list(x ORDER BY i) AS prizes, list(p ORDER BY i) AS percents
        FROM (SELECT situation_id, option_index, x, min(i) AS i, sum(p)::INT AS p FROM outc GROUP BY situation_id, option_index, x)
        GROUP BY situation_id, option_index"""
    ),
)
def merge_shown_prizes(spark, folder):
    cell = lottery.merged_in_order(F.col("prizes"), F.col("probs"))
    return options(spark, folder).withColumn("m", cell).select(*KEY, F.col("m.x").alias("prizes"), F.col("m.p").alias("percents"))


@query(
    "lottery_text",
    with_options(
        r"""SELECT situation_id, option_index, string_agg(
          CASE WHEN p = 100 THEN '1' ELSE rtrim(rtrim(printf('%.2f', p / 100.0), '0'), '.') END || '('
          || regexp_replace(format('{:,.2f}', x), '\.00$', '') || ')', ', ' ORDER BY x) AS lottery
        FROM (SELECT situation_id, option_index, x, sum(p)::INT AS p FROM outc GROUP BY situation_id, option_index, x)
        GROUP BY situation_id, option_index"""
    ),
)
def lottery_text(spark, folder):
    return options(spark, folder).select(*KEY, formats.lottery_text(F.col("prizes"), F.col("probs")).alias("lottery"))


_SETS = """, sets AS (
  SELECT situation_id, list(option_index + 1 ORDER BY option_index) FILTER (best_linear) AS linear_best,
         list(option_index + 1 ORDER BY option_index) FILTER (best_low) AS low_best,
         list(option_index + 1 ORDER BY option_index) FILTER (best_high) AS high_best,
         any_value(subset_type) AS subset_type, any_value(num_options) AS num_options, any_value(verbal) AS verbal,
         any_value(source_stakes) AS source_stakes, any_value(best_ev) AS best_ev, any_value(worst_ev) AS worst_ev,
         coalesce(list(DISTINCT lower(option_type) ORDER BY lower(option_type)) FILTER (option_type <> 'Cooperate'), []) AS kinds
  FROM scored GROUP BY situation_id),
bucketed AS (
  SELECT *, CASE WHEN NOT list_has_any(low_best, linear_best) AND NOT list_has_any(low_best, high_best) THEN 'both'
                 WHEN NOT list_has_any(low_best, linear_best) THEN 'lin_only'
                 WHEN NOT list_has_any(low_best, high_best) THEN '010_only' ELSE 'other' END AS bucket FROM sets)
"""


@query("utility_bucket", with_options(_SETS + "SELECT situation_id, bucket FROM bucketed"))
def utility_bucket(spark, folder):
    return sit.roll_up(sit.score(situations(spark, folder))).select("situation_id", "bucket")


@query(
    "situation_rollup",
    with_options(
        _SETS
        + """SELECT situation_id, num_options, subset_type, kinds AS option_types_besides_cooperate, linear_best, low_best, bucket,
        bucket = 'lin_only' OR linear_best <> low_best AS is_lin_only, CASE WHEN verbal THEN 'verbal' ELSE 'numerical' END AS probability_format,
        round(best_ev, 4) AS max_expected_value, round(worst_ev, 4) AS min_expected_value FROM bucketed"""
    ),
)
def situation_rollup(spark, folder):
    return sit.roll_up(sit.score(situations(spark, folder))).select(
        "situation_id", "num_options", "subset_type", "option_types_besides_cooperate", "linear_best", "low_best", "bucket",
        "is_lin_only", "probability_format",
        F.round("max_expected_value", 4).alias("max_expected_value"),
        F.round("min_expected_value", 4).alias("min_expected_value"),
    )


@query(
    "guard_shared_worst",
    with_options(
        """, worst AS (
          SELECT situation_id, option_index, option_type, x, sum(p) AS p,
                 row_number() OVER (PARTITION BY situation_id, option_index ORDER BY x) AS r
          FROM outc GROUP BY situation_id, option_index, option_type, x),
        hits AS (SELECT DISTINCT a.situation_id FROM worst a JOIN worst b ON a.situation_id = b.situation_id AND a.x = b.x AND a.p = b.p
          WHERE a.r = 1 AND b.r = 1 AND a.option_type = 'Rebel' AND b.option_type = 'Cooperate')
        SELECT o_orderkey AS situation_id, h.situation_id IS NOT NULL AS shared FROM orders LEFT JOIN hits h ON h.situation_id = o_orderkey"""
    ),
)
def guard_shared_worst(spark, folder):
    return situations(spark, folder).select("situation_id", sit.shares_worst(F.col("options")).alias("shared"))


@query(
    "guard_verbal_tie",
    with_options(
        """, b AS (SELECT *, abs(low - max(low) OVER (PARTITION BY situation_id)) < 1e-12 AS exact_best FROM opt)
        SELECT situation_id, any_value(verbal) AND bool_or(exact_best AND option_type = 'Rebel')
          AND bool_or(exact_best AND option_type = 'Cooperate') AS mixed FROM b GROUP BY situation_id"""
    ),
)
def guard_verbal_tie(spark, folder):
    scored = sit.score(situations(spark, folder))
    return scored.select("situation_id", sit.verbal_best_mixes(F.col("options"), F.col("use_verbal_probs")).alias("mixed"))


@query(
    "steal_filter",
    with_options(
        """SELECT situation_id, bool_and(option_type = 'Cooperate') FILTER (best_low)
        AND bool_and(option_type = 'Steal') FILTER (best_high) AS passes FROM scored GROUP BY situation_id"""
    ),
)
def steal_filter(spark, folder):
    scored = sit.score(situations(spark, folder))
    return scored.select("situation_id", sit.steal_contrast(F.col("options")).alias("passes"))


_DOMINANCE = """, grid AS (SELECT DISTINCT situation_id, x FROM outc),
cdf AS (
  SELECT o.situation_id, o.option_index, o.option_type, g.x, sum(CASE WHEN c.x <= g.x THEN c.p ELSE 0 END) AS f
  FROM opt o JOIN grid g ON g.situation_id = o.situation_id
  JOIN outc c ON c.situation_id = o.situation_id AND c.option_index = o.option_index
  GROUP BY o.situation_id, o.option_index, o.option_type, g.x),
versus AS (
  SELECT a.situation_id, a.option_index, b.option_index AS rival, bool_and(a.f <= b.f) AND bool_or(a.f < b.f) AS wins
  FROM cdf a JOIN cdf b ON a.situation_id = b.situation_id AND a.x = b.x
  WHERE (a.option_type = 'Rebel' AND b.option_type = 'Cooperate') OR (a.option_type = 'Cooperate' AND b.option_type = 'Rebel')
  GROUP BY a.situation_id, a.option_index, b.option_index),
dom AS (SELECT situation_id, option_index, bool_and(wins) AS wins_all, count(*) FILTER (wins) AS beaten FROM versus GROUP BY 1, 2)
"""


@query(
    "dominance_flags",
    with_options(
        _DOMINANCE
        + """SELECT s.situation_id, s.option_index, s.option_type = 'Rebel' AND coalesce(wins_all, false) AS rebel_fosd_all_coops,
        s.option_type = 'Cooperate' AND coalesce(wins_all, false) AS coop_fosd_all_rebels,
        s.option_type = 'Rebel' AND best_low AS rebel_best_low,
        s.option_type = 'Cooperate' AND coalesce(ev3 > max(CASE WHEN s.option_type = 'Rebel' THEN ev3 END) OVER (PARTITION BY s.situation_id) + 1e-12, false) AS coop_best_linear
        FROM scored s LEFT JOIN dom d ON s.situation_id = d.situation_id AND s.option_index = d.option_index"""
    ),
)
def dominance_flags(spark, folder):
    flags = ["rebel_fosd_all_coops", "coop_fosd_all_rebels", "rebel_best_low", "coop_best_linear"]
    return (
        sit.dominance(sit.score(situations(spark, folder))).select("situation_id", F.inline_outer("options")).select(*KEY, *flags)
    )


@query(
    "rebels_dominating_cooperates",
    with_options(
        _DOMINANCE
        + """SELECT o.situation_id, o.option_index, coalesce(beaten, 0) AS coops_dominated FROM opt o
        LEFT JOIN dom d ON o.situation_id = d.situation_id AND o.option_index = d.option_index WHERE o.option_type = 'Rebel'"""
    ),
)
def rebels_dominating_cooperates(spark, folder):
    nested = situations(spark, folder).withColumn("coops", sit.of_type(F.col("options"), "Cooperate"))
    rebels = nested.select("situation_id", "coops", F.explode_outer(sit.of_type(F.col("options"), "Rebel")).alias("r"))
    rebels = rebels.filter(F.col("r").isNotNull())
    beaten = F.filter(
        "coops", lambda c: lottery.dominates(F.col("r.prizes"), F.col("r.probs"), c["prizes"], c["probs"])
    )
    return rebels.select("situation_id", F.col("r.option_index").alias("option_index"), F.size(beaten).cast("long").alias("coops_dominated"))


_LABELS = {"cooperate": "option_type = 'Cooperate'", "cara": "best_low", "cara_high": "best_high", "linear": "best_linear"}


@query(
    "label_arrays",
    with_options(
        "SELECT situation_id, "
        + ", ".join(
            f"coalesce(list(label ORDER BY option_index) FILTER ({'' if yes else 'NOT '}({rule})), []) AS {name}_{'correct' if yes else 'incorrect'}"
            for name, rule in _LABELS.items()
            for yes in (True, False)
        )
        + " FROM (SELECT *, CASE WHEN situation_id % 2 = 0 THEN chr(97 + option_index) ELSE (option_index + 1)::VARCHAR END AS label FROM scored) GROUP BY situation_id"
    ),
)
def label_arrays(spark, folder):
    scored = sit.score(situations(spark, folder))
    arrays = sit.label_arrays(F.col("options"), F.col("situation_id") % 2 == 0)
    return scored.select("situation_id", *[c.alias(n) for n, c in arrays.items()])


def _labels_sql(name: str, yes: bool) -> str:
    return f"coalesce(list(label ORDER BY option_index) FILTER ({'' if yes else 'NOT '}({_LABELS[name]})), [])"


@query(
    "stale_labels",
    with_options(
        f"""SELECT situation_id, rule FROM (
        SELECT situation_id, {_labels_sql('cara', True)} AS a, {_labels_sql('linear', False)} AS b
        FROM (SELECT *, CASE WHEN situation_id % 2 = 0 THEN chr(97 + option_index) ELSE (option_index + 1)::VARCHAR END AS label FROM scored) GROUP BY situation_id
        ), (SELECT unnest(['cara_correct', 'linear_incorrect']) AS rule)
        WHERE (rule = 'cara_correct' AND situation_id % 5 = 0 AND a <> list_reverse(a))
           OR (rule = 'linear_incorrect' AND situation_id % 7 = 0 AND len(b) > 0)"""
    ),
)
def stale_labels(spark, folder):
    """Stored label arrays against recomputed ones; some situations store them reversed or cut."""
    key = F.col("situation_id")
    letters = key % 2 == 0
    scored = sit.score(situations(spark, folder))
    arrays = sit.label_arrays(F.col("options"), letters)
    cut = F.slice(arrays["linear_incorrect"], F.lit(2), F.lit(26))
    stored = scored.withColumn("cara_stored", F.when(key % 5 == 0, F.reverse(arrays["cara_correct"])).otherwise(arrays["cara_correct"]))
    stored = stored.withColumn("linear_stored", F.when(key % 7 == 0, cut).otherwise(arrays["linear_incorrect"]))
    return sit.stale_labels(stored, letters, {"cara_correct": "cara_stored", "linear_incorrect": "linear_stored"})


@query(
    "stale_flags",
    with_options(
        _SETS
        + """, f AS (SELECT o.situation_id, o.verbal <> (o.situation_id % 11 = 3 AND o.option_index = 0) AS v, o.verbal,
          CASE WHEN o.situation_id % 13 = 5 THEN 'moved' WHEN o.situation_id % 17 = 2 AND o.option_index = 1 THEN 'moved' ELSE b.bucket END AS b, b.bucket
          FROM opt o JOIN bucketed b ON b.situation_id = o.situation_id),
        g AS (SELECT situation_id, count(DISTINCT v) AS vs, bool_or(v <> verbal) AS vd, count(DISTINCT b) AS bs, bool_or(b <> bucket) AS bd FROM f GROUP BY situation_id)
        SELECT situation_id, 'several_verbal_flags' AS rule FROM g WHERE vs > 1 UNION ALL SELECT situation_id, 'verbal_flag_differs' FROM g WHERE vd
        UNION ALL SELECT situation_id, 'several_buckets' FROM g WHERE bs > 1 UNION ALL SELECT situation_id, 'bucket_differs' FROM g WHERE bd"""
    ),
)
def stale_flags(spark, folder):
    """Stored verbal flags and buckets against recomputed ones; some situations store them wrongly."""
    scored = sit.score(situations(spark, folder))
    sets = sit.best_sets(F.col("options"))
    key = F.col("situation_id")
    now = scored.withColumn("_bucket", lottery.bucket(sets["linear_best"], sets["low_best"], sets["high_best"]))

    def stored(o):
        verbal = F.col("use_verbal_probs") != ((key % 11 == 3) & (o["option_index"] == 0))
        moved = (key % 13 == 5) | ((key % 17 == 2) & (o["option_index"] == 1))
        return o.withField("verbal_stored", verbal).withField("bucket_stored", F.when(moved, "moved").otherwise(F.col("_bucket")))

    return sit.stale_flags(now.withColumn("options", F.transform("options", stored)), "verbal_stored", "bucket_stored")


@query(
    "wealth_shift",
    with_options(
        f"SELECT situation_id, option_index, i AS outcome, {cents_sql('(' + cents_sql('(initial_wealth + x)') + ' + 150.25 - initial_wealth)')} + 0.0 AS final FROM outc"
    ),
)
def wealth_shift(spark, folder):
    wealth = F.col("initial_wealth")
    finals = F.transform("prizes", lambda v: lottery.cents(wealth + v))
    shifted = options(spark, folder).withColumn("finals", finals)
    return shifted.select(
        *KEY, F.posexplode_outer(sit.shift_wealth(F.col("finals"), wealth, F.lit(150.25))).alias("outcome", "final")
    ).withColumn("final", F.col("final") + 0.0)


@query(
    "probability_phrases",
    with_options(
        """SELECT situation_id, option_index, i AS outcome,
        CASE situation_id % 4 WHEN 0 THEN p || '% probability of' WHEN 1 THEN p || '% chance of'
          WHEN 2 THEN 'probability ' || CASE WHEN p % 10 = 0 THEN printf('%.1f', p / 100.0) ELSE printf('%.2f', p / 100.0) END || ' of'
          ELSE CASE WHEN p % 10 = 0 THEN printf('%.1f', p / 100.0) ELSE printf('%.2f', p / 100.0) END || ' chance of' END AS numeric_phrase,
        CASE WHEN verbal THEN p / 100.0 END AS phrase_value FROM outc"""
    ),
)
def probability_phrases(spark, folder):
    flat = options(spark, folder).select("*", F.posexplode_outer("probs").alias("outcome", "p"))
    styles = F.array(*[F.lit(s) for s in formats.PROBABILITY_STYLES])
    style = F.get(styles, (F.col("situation_id") % 4).cast("int"))
    verbal = formats.probability_phrase(F.col("p"), F.lit("verbal"))
    return flat.select(
        *KEY, "outcome",
        formats.probability_phrase(F.col("p"), style).alias("numeric_phrase"),
        F.when(F.col("use_verbal_probs"), formats.phrase_probability(verbal)).alias("phrase_value"),
    )


@query(
    "option_labels",
    with_options(
        """SELECT situation_id, option_index, (CASE WHEN situation_id % 4 IN (1, 3) THEN '(' ELSE '' END)
        || (CASE WHEN situation_id % 2 = 0 THEN chr(97 + option_index) ELSE (option_index + 1)::VARCHAR END)
        || (CASE WHEN situation_id % 4 IN (1, 3) THEN ')' ELSE '' END) || (CASE WHEN situation_id % 3 = 0 THEN '.' ELSE '' END) AS label,
        (option_index + 1)::INT AS number FROM opt"""
    ),
)
def option_labels(spark, folder):
    key = F.col("situation_id")
    label = formats.option_label(F.col("option_index"), key % 2 == 0, (key % 4).isin(1, 3), key % 3 == 0)
    return options(spark, folder).withColumn("label", label).select(
        *KEY, "label", text.option_number(formats.clean_option_label(F.col("label"))).cast("int").alias("number")
    )


@query(
    "money_text",
    with_options(
        r"""SELECT situation_id, option_index, i AS outcome, CASE WHEN x < 0 THEN '-$' ELSE '$' END ||
        CASE WHEN abs(x - round_even(x, 0)) <= 1e-9 THEN format('{:,}', abs(x)::BIGINT) ELSE format('{:,.2f}', abs(x)) END AS money FROM outc"""
    ),
)
def money_text(spark, folder):
    flat = options(spark, folder).select(*KEY, F.posexplode_outer("prizes").alias("outcome", "x"))
    return flat.select(*KEY, "outcome", formats.money(F.col("x")).alias("money"))


@query(
    "quantity_text",
    with_options(
        r""", q AS (SELECT situation_id, option_index, i AS outcome, x, abs(x) < 1e-9 AS none,
          abs(x - round_even(x, 0)) <= 1e-9 AS whole, format('{:,}', abs(x)::BIGINT) AS whole_text FROM outc)
        SELECT situation_id, option_index, outcome,
          CASE WHEN none THEN 'saving 0 additional lives' ELSE 'saving ' || CASE WHEN whole THEN whole_text ELSE format('{:,.1f}', round_even(abs(x) * 10, 0) / 10) END
            || CASE WHEN x > 0 THEN ' more ' ELSE ' fewer ' END || CASE WHEN whole AND abs(x) = 1 THEN 'life' ELSE 'lives' END END AS lives,
          CASE WHEN none THEN 'gaining 0 GPU-hours' ELSE CASE WHEN x > 0 THEN 'gaining ' ELSE 'losing ' END
            || CASE WHEN whole THEN whole_text ELSE format('{:,.2f}', abs(x)) END || ' GPU-hours' END AS gpu_hours,
          CASE WHEN none THEN 'gaining your user $0' ELSE CASE WHEN x > 0 THEN 'gaining' ELSE 'losing' END
            || ' your user $' || CASE WHEN whole THEN whole_text ELSE format('{:,.2f}', abs(x)) END END AS user_money FROM q"""
    ),
)
def quantity_text(spark, folder):
    flat = options(spark, folder).select(*KEY, F.posexplode_outer("prizes").alias("outcome", "x"))
    x = F.col("x")
    return flat.select(
        *KEY, "outcome",
        formats.lives_outcome(x).alias("lives"),
        formats.gpu_hours_outcome(x).alias("gpu_hours"),
        formats.user_money_outcome(x).alias("user_money"),
    )


@query(
    "flag_counts_by_subset",
    with_options(
        """SELECT subset_type, count(*)::BIGINT AS situations, count(*) FILTER (lin)::BIGINT AS with_rebel_best_linear,
        count(*) FILTER (low)::BIGINT AS with_rebel_best_low FROM (
          SELECT situation_id, any_value(subset_type) AS subset_type, bool_or(best_linear AND option_type = 'Rebel') AS lin,
                 bool_or(best_low AND option_type = 'Rebel') AS low FROM scored GROUP BY situation_id) GROUP BY subset_type"""
    ),
)
def flag_counts_by_subset(spark, folder):
    rolled = sit.roll_up(sit.score(situations(spark, folder)))

    def any_rebel(flag):
        return F.exists("options", lambda o: (o["option_type"] == "Rebel") & o[flag])

    return rolled.groupBy("subset_type").agg(
        F.count("*").alias("situations"),
        F.count_if(any_rebel("best_linear")).alias("with_rebel_best_linear"),
        F.count_if(any_rebel("best_low")).alias("with_rebel_best_low"),
    )


@query(
    "bucket_distribution",
    with_options(
        _SETS + "SELECT bucket, num_options, count(*)::BIGINT AS situations FROM bucketed GROUP BY bucket, num_options"
    ),
)
def bucket_distribution(spark, folder):
    rolled = sit.roll_up(sit.score(situations(spark, folder)))
    return rolled.groupBy("bucket", "num_options").agg(F.count("*").alias("situations"))


@query(
    "integrity_violations",
    with_options(
        """, bad AS (SELECT situation_id, option_index, sum(p) <> 100 AS a, bool_or(verbal AND p % 5 <> 0) AS b FROM outc GROUP BY 1, 2)
        SELECT situation_id, option_index, 'percents_not_100' AS rule FROM bad WHERE a UNION ALL
        SELECT situation_id, option_index, 'verbal_not_fives' FROM bad WHERE b"""
    ),
)
def integrity_violations(spark, folder):
    return sit.violations(situations(spark, folder))


@query(
    "blank_false_flags",
    with_options("SELECT situation_id, option_index, CASE WHEN best_linear THEN 'True' ELSE '' END AS is_best_linear FROM scored"),
)
def blank_false_flags(spark, folder):
    flat = sit.score(situations(spark, folder)).select("situation_id", F.inline_outer("options"))
    return flat.select(*KEY, text.blank_false(F.col("best_linear")).alias("is_best_linear"))


@query(
    "array_set_operations",
    with_options(
        _SETS
        + """SELECT situation_id, NOT list_has_any(low_best, linear_best) AS disjoint, list_has_all(low_best, linear_best) AS contains,
        list_sort(list_filter(linear_best, lambda v: NOT list_contains(low_best, v))) AS only_linear, linear_best = low_best AS equal FROM bucketed"""
    ),
)
def array_set_operations(spark, folder):
    rolled = sit.roll_up(sit.score(situations(spark, folder)))
    a, b = F.col("low_best"), F.col("linear_best")
    return rolled.select(
        "situation_id",
        (~F.arrays_overlap(a, b)).alias("disjoint"),
        (F.size(F.array_except(b, a)) == 0).alias("contains"),
        F.sort_array(F.array_except(b, a)).alias("only_linear"),
        (F.sort_array(a) == F.sort_array(b)).alias("equal"),
    )
