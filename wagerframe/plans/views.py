"""Canonical views over the benchmark tables, in Spark and in SQL.

* a situation is an order; its options are computed from the order's own columns,
  so a situation is one nested row and needs no shuffle to build;
* a response is a line item: the answer of run ``l_linenumber`` to an order;
* a preference pair is a document with its labels;
* score items are the lines of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerframe.functions import lottery
from wagerframe.plans.registry import spread, table

TYPES = ["Cooperate", "Rebel", "Steal"]


def _mix(key: Column, cust: Column, j: Column) -> Column:
    return key * 7919 + cust * 131 + j * 104729


def outcome_count(h: Column) -> Column:
    return (1 + F.floor(h / 3) % 4).cast("int")


def exact_prizes(h: Column, price: Column) -> Column:
    gifts = F.array(
        price / 100 * (1 + h % 7),
        (-(h % 500)).cast("double") + 0.0,
        F.lit(0.0),
        F.when(h % 2 == 0, F.lit(0.0)).otherwise((h % 97).cast("double")),
    )
    return F.slice(gifts, F.lit(1), outcome_count(h))


def raw_weights(h: Column) -> Column:
    weights = F.array(*[(1 + F.floor(h / d) % 20).cast("int") for d in (1, 7, 11, 13)])
    return F.slice(weights, F.lit(1), outcome_count(h))


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per situation; each option still as its index, type and hash."""
    o = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    o = spread(o, "o_orderkey", costly=True)
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    n = (2 + cust % 4).cast("int")
    subset = F.when(F.col("o_orderpriority") == "1-URGENT", "rebel-cooperate").when(
        F.col("o_orderpriority") == "2-HIGH", "steals_only"
    )

    def draft(j: Column) -> Column:
        twin = F.when((j == 1) & (key % 5 == 0), 0).otherwise(j)
        kind = (_mix(key, cust, j) % 3).cast("int")
        return F.struct(
            j.cast("int").alias("option_index"),
            F.get(F.array(*[F.lit(t) for t in TYPES]), kind).alias("option_type"),
            _mix(key, cust, twin).alias("h"),
        )

    return o.select(
        key.alias("situation_id"),
        F.col("o_totalprice").alias("price"),
        subset.alias("raw_subset"),
        n.alias("num_options"),
        (2 + key % 4).cast("int").alias("digits"),
        (key % 2 == 0).alias("use_verbal_probs"),
        (cust % 1000).cast("double").alias("initial_wealth"),
        F.when(F.col("o_orderstatus") == "P", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low").alias(
            "source_stakes"
        ),
        F.transform(F.sequence(F.lit(0), n - 1), draft).alias("drafts"),
    )


def situations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per situation with its options nested."""

    def option(d: Column) -> Column:
        shown = F.transform(
            exact_prizes(d["h"], F.col("price")),
            lambda v: lottery.cents(lottery.round_significant(v, F.col("digits"))) + F.lit(0.0),
        )
        weights = raw_weights(d["h"])
        fives = F.transform(lottery.normalise_percents(weights, 20), lambda v: v * 5)
        return F.struct(
            d["option_index"].alias("option_index"),
            d["option_type"].alias("option_type"),
            shown.alias("prizes"),
            F.when(F.col("use_verbal_probs"), fives).otherwise(lottery.normalise_percents(weights)).alias("probs"),
        )

    return (
        drafts(spark, folder)
        .withColumn("options", F.transform("drafts", option))
        .drop("drafts", "price", "digits")
    )


def options(spark: SparkSession, folder: str) -> DataFrame:
    """The flat form: one row per option."""
    return situations(spark, folder).select("*", F.explode_outer("options").alias("o")).select(
        "situation_id", "raw_subset", "num_options", "use_verbal_probs", "initial_wealth", "source_stakes", "o.*"
    )


def rsig(x: str, digits: str) -> str:
    """SQL text of rounding to significant figures."""
    shift = f"({digits} - 1 - floor(log10(abs({x}))))"
    return (
        f"(CASE WHEN abs({x}) > 0 THEN sign({x}) * (CASE WHEN {shift} >= 0 "
        f"THEN round_even(abs({x}) * pow(10.0::DOUBLE, {shift}), 0) / pow(10.0::DOUBLE, {shift}) "
        f"ELSE round_even(abs({x}) / pow(10.0::DOUBLE, -{shift}), 0) * pow(10.0::DOUBLE, -{shift}) END) ELSE {x} END)"
    )


def cents_sql(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e15 THEN round_even({x} * 100, 0) / 100 ELSE {x} END)"


# SQL: outcome rows `outc`, option rows `opt`, scored option rows `scored`.
OPTIONS_SQL = f"""
sit AS (
  SELECT o_orderkey AS situation_id, o_custkey AS cust, o_totalprice AS price, (2 + o_custkey % 4)::INT AS num_options,
         (2 + o_orderkey % 4)::INT AS digits, o_orderkey % 2 = 0 AS verbal, (o_custkey % 1000)::DOUBLE AS initial_wealth,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'rebel-cooperate' WHEN '2-HIGH' THEN 'steals_only' END AS raw_subset,
         CASE o_orderstatus WHEN 'P' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS source_stakes
  FROM orders),
opt0 AS (SELECT *, unnest(range(num_options))::INT AS option_index FROM sit),
opt1 AS (
  SELECT *, situation_id * 7919 + cust * 131 + option_index * 104729 AS h0,
         situation_id * 7919 + cust * 131
           + (CASE WHEN option_index = 1 AND situation_id % 5 = 0 THEN 0 ELSE option_index END) * 104729 AS h
  FROM opt0),
opt2 AS (
  SELECT *, (1 + (h // 3) % 4)::INT AS k,
         CASE h0 % 3 WHEN 0 THEN 'Cooperate' WHEN 1 THEN 'Rebel' ELSE 'Steal' END AS option_type FROM opt1),
out0 AS (SELECT *, unnest(range(k))::INT AS i FROM opt2),
out1 AS (
  SELECT *, CASE i WHEN 0 THEN price / 100 * (1 + h % 7) WHEN 1 THEN -(h % 500)::DOUBLE + 0.0 WHEN 2 THEN 0.0
              ELSE CASE WHEN h % 2 = 0 THEN 0.0 ELSE (h % 97)::DOUBLE END END AS x_exact,
         CASE i WHEN 0 THEN 1 + h % 20 WHEN 1 THEN 1 + (h // 7) % 20 WHEN 2 THEN 1 + (h // 11) % 20
                ELSE 1 + (h // 13) % 20 END AS w
  FROM out0),
out2 AS (
  SELECT *, CASE WHEN verbal THEN 20 ELSE 100 END AS whole,
         sum(w) OVER (PARTITION BY situation_id, option_index) AS mass FROM out1),
out3 AS (
  SELECT *, w * whole // mass AS fl,
         row_number() OVER (PARTITION BY situation_id, option_index ORDER BY w * whole % mass DESC, i) AS place FROM out2),
outc AS (
  SELECT situation_id, raw_subset, num_options, digits, verbal, initial_wealth, source_stakes, option_index, option_type, h, k,
         i, x_exact, w::INT AS w, {cents_sql(rsig('x_exact', 'digits'))} + 0.0 AS x,
         ((fl + CASE WHEN place <= whole - sum(fl) OVER (PARTITION BY situation_id, option_index) THEN 1 ELSE 0 END)
           * (100 // whole))::INT AS p
  FROM out3),
opt AS (
  SELECT situation_id, option_index, any_value(raw_subset) AS raw_subset, any_value(num_options) AS num_options,
         any_value(digits) AS digits, any_value(verbal) AS verbal, any_value(initial_wealth) AS initial_wealth,
         any_value(source_stakes) AS source_stakes, any_value(option_type) AS option_type, count(*)::INT AS k,
         list(x ORDER BY i) AS xs, list(p ORDER BY i) AS ps,
         list_sum(list(x * p ORDER BY i)) / sum(p) AS ev,
         list_sum(list((1.0 - exp(greatest(-700.0, least(700.0, x * -0.01)))) * p ORDER BY i)) / sum(p) AS low,
         list_sum(list((1.0 - exp(greatest(-700.0, least(700.0, x * -0.1)))) * p ORDER BY i)) / sum(p) AS high
  FROM outc GROUP BY situation_id, option_index),
scored0 AS (
  SELECT *, {rsig('ev', '3')} AS ev3, {rsig('low', '3')} AS low3, {rsig('high', '3')} AS high3,
         CASE lower(replace(trim(raw_subset), '-', '_')) WHEN 'rebel_cooperate' THEN 'rebels_only'
              WHEN 'steals_only' THEN 'steals_only'
              ELSE CASE WHEN max(CASE WHEN option_type = 'Steal' THEN 1 ELSE 0 END) OVER (PARTITION BY situation_id) = 1
                        THEN 'steals_only' ELSE 'rebels_only' END END AS subset_type
  FROM opt),
scored AS (
  SELECT *, max(ev) OVER s AS best_ev, min(ev) OVER s AS worst_ev,
         abs(ev3 - max(ev3) OVER s) < 1e-12 AS best_linear, abs(low3 - max(low3) OVER s) < 1e-12 AS best_low,
         abs(high3 - max(high3) OVER s) < 1e-12 AS best_high, abs(ev - min(ev) OVER s) < 1e-12 AS worst_linear
  FROM scored0 WINDOW s AS (PARTITION BY situation_id))
"""


def with_options(body: str) -> str:
    return f"WITH {OPTIONS_SQL} {body}"


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of seven runs to situations; the text form follows the part key."""
    return answer_rows(spread(table(spark, folder, "lineitem").select(*ANSWER_COLUMNS), "l_orderkey"))


ANSWER_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def answer_rows(lines: DataFrame) -> DataFrame:
    """Line items as answers; works on a batch table and on a stream."""
    li = lines.select(*ANSWER_COLUMNS)
    number = (1 + F.col("l_suppkey") % 5).cast("int")
    letter = F.char(F.lit(96) + number)
    form = F.col("l_partkey") % 10
    answer = (
        F.when(form == 0, F.concat(F.lit('I compared the options. {"answer":"'), number.cast("string"), F.lit('"}')))
        .when(form == 1, F.concat(F.lit("All computed: \\boxed{"), letter, F.lit("}")))
        .when(form == 2, F.concat(F.lit("Long analysis of each line.\nAnswer: ("), number.cast("string"), F.lit(")")))
        .when(form == 3, F.concat(F.lit("Weighing risk and gain, I would choose option "), number.cast("string"), F.lit(" because it suits me.")))
        .when(form == 4, F.concat(F.lit("<think>quick check</think>\n("), letter, F.lit(")")))
        .when(form == 5, F.concat(F.lit("Maybe the answer is option "), number.cast("string"), F.lit(".")))
        .when(form == 6, F.lit(""))
        .when(form == 7, F.concat(F.lit("Seen from the numbers, option "), letter, F.lit(" is the most attractive choice.")))
        .when(form == 8, F.concat(F.lit("If we choose option 1, we lose. So the best option is option "), number.cast("string"), F.lit(".")))
        .otherwise(F.lit("No option here appeals to me."))
    )
    return li.select(
        F.col("l_orderkey").alias("situation_id"),
        F.concat(F.lit("run-"), F.col("l_linenumber").cast("string")).alias("run_id"),
        F.col("l_partkey").alias("seq"),
        number.alias("number"),
        answer.alias("response"),
        F.when(F.col("l_quantity") >= 45, "length").otherwise("stop").alias("finish_reason"),
        F.col("l_quantity").cast("long").alias("num_tokens"),
        (F.col("l_extendedprice") / 1000).alias("batch_seconds"),
    )


# SQL: responses with the reading each text form must give.
RESPONSES_SQL = """
resp0 AS (
  SELECT l_orderkey AS situation_id, 'run-' || l_linenumber AS run_id, l_partkey AS seq, (1 + l_suppkey % 5)::INT AS number,
         l_partkey % 10 AS form, CASE WHEN l_quantity >= 45 THEN 'length' ELSE 'stop' END AS finish_reason,
         l_quantity::BIGINT AS num_tokens, l_extendedprice / 1000 AS batch_seconds,
         (2 + o_custkey % 4)::INT AS num_options
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
resp AS (
  SELECT *, CASE WHEN number <= num_options AND form IN (0, 2, 3, 8) THEN number::VARCHAR
                 WHEN number <= num_options AND form IN (1, 4, 7) THEN chr(96 + number) END AS choice,
         CASE WHEN number > num_options THEN NULL WHEN form = 0 THEN 'json' WHEN form = 1 THEN 'boxed'
              WHEN form IN (2, 4) THEN 'short_answer_line' WHEN form = 3 THEN 'decision_verb'
              WHEN form = 7 THEN 'option_is_best'
              WHEN form = 8 THEN CASE WHEN finish_reason = 'length' THEN 'option_is_best' ELSE 'best_choice_is' END
         END AS strategy
  FROM resp0)
"""


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Preference pairs: one per document, flags from its labels where it has any."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    id_, n = F.col("doc_id"), F.col("n_chars")
    accepted, rejected = (n * 7 + id_ * 3) % 97 / 10, (n * 5 + id_ * 11) % 89 / 10
    label = F.char((F.lit(97) + id_ % 3).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        id_.alias("row_idx"),
        F.floor(id_ / 3).alias("situation_id"),
        F.when(id_ % 7 == 0, "lin").when(id_ % 7 < 4, "too_risk").when(id_ % 7 < 6, "rebel-cooperate").alias("rejected_type"),
        F.col("text").alias("prompt_text"),
        F.concat(F.lit("<think>"), F.col("lang"), F.lit("</think>{\"answer\":\""), label, F.lit('"}')).alias("chosen_full"),
        F.concat(F.lit("<think>"), F.col("source"), F.lit("</think>{\"answer\":\"z\"}")).alias("rejected_full"),
        label.alias("chosen_expected"),
        F.when(id_ % 11 != 0, n).alias("chosen_output_tokens"),
        F.when(id_ % 13 != 0, (n * 3 + id_) % 5000).alias("rejected_output_tokens"),
        (F.col("quality") == 1).alias("chosen_ok"),
        (F.col("toxic") == 0).alias("rejected_ok"),
        accepted.alias("accepted_score"),
        rejected.alias("rejected_score"),
        (n > 8000).alias("accepted_truncated"),
        (n > 12000).alias("rejected_truncated"),
        F.col("lang"),
        F.col("source"),
    )


PAIRS_SQL = """
pr0 AS (
  SELECT d.doc_id AS row_idx, d.doc_id // 3 AS situation_id,
         CASE WHEN d.doc_id % 7 = 0 THEN 'lin' WHEN d.doc_id % 7 < 4 THEN 'too_risk' WHEN d.doc_id % 7 < 6 THEN 'rebel-cooperate' END AS rejected_type,
         text AS prompt_text, '<think>' || lang || '</think>{"answer":"' || chr((97 + d.doc_id % 3)::INT) || '"}' AS chosen_full,
         '<think>' || source || '</think>{"answer":"z"}' AS rejected_full, chr((97 + d.doc_id % 3)::INT) AS chosen_expected,
         CASE WHEN d.doc_id % 11 <> 0 THEN n_chars END AS chosen_output_tokens,
         CASE WHEN d.doc_id % 13 <> 0 THEN (n_chars * 3 + d.doc_id) % 5000 END AS rejected_output_tokens,
         quality = 1 AS chosen_ok, toxic = 0 AS rejected_ok,
         (n_chars * 7 + d.doc_id * 3) % 97 / 10 AS accepted_score, (n_chars * 5 + d.doc_id * 11) % 89 / 10 AS rejected_score,
         n_chars > 8000 AS accepted_truncated, n_chars > 12000 AS rejected_truncated, lang, source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
pr AS (
  SELECT *, accepted_score - rejected_score AS score_margin,
         CASE WHEN accepted_score - rejected_score > 1e-6 THEN 'accepted'
              WHEN accepted_score - rejected_score < -1e-6 THEN 'rejected' ELSE 'tie' END AS predicted_preference,
         CASE WHEN rejected_type IN ('lin', 'rebel-cooperate') THEN 'rebels_only' WHEN rejected_type = 'too_risk' THEN 'steals_only'
              ELSE 'unknown' END AS subset_type,
         CASE WHEN chosen_output_tokens IS NULL OR rejected_output_tokens IS NULL THEN NULL
              WHEN chosen_output_tokens > rejected_output_tokens THEN 'accepted_longer'
              WHEN rejected_output_tokens > chosen_output_tokens THEN 'rejected_longer' ELSE 'same_length' END AS length_relation
  FROM pr0)
"""


def score_items(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate lines of each document; the first ``num_correct`` are the correct ones."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("subset"),
        F.when(F.col("doc_id") % 2 == 0, "ref").otherwise("tied").alias("sample_type"),
        F.floor(F.col("doc_id") / 2).alias("prompt_id"),
        (1 + F.col("doc_id") % 3).cast("int").alias("num_correct"),
        (F.col("n_chars") > 8000).alias("truncated"),
        F.posexplode_outer(F.split("text", "\n")).alias("candidate_idx", "candidate"),
    ).withColumn("score", (F.length("candidate") * 17 + F.col("row_id") * 5 + F.col("candidate_idx") * 3) % 101 / 10)


ITEMS_SQL = """
item0 AS (
  SELECT doc_id AS row_id, source AS subset, CASE WHEN doc_id % 2 = 0 THEN 'ref' ELSE 'tied' END AS sample_type,
         doc_id // 2 AS prompt_id, (1 + doc_id % 3)::INT AS num_correct, n_chars > 8000 AS truncated,
         string_split(text, chr(10)) AS parts FROM documents),
item1 AS (SELECT *, unnest(range(len(parts)))::INT AS candidate_idx FROM item0),
item AS (
  SELECT row_id, subset, sample_type, prompt_id, num_correct, truncated, candidate_idx, parts[candidate_idx + 1] AS candidate,
         (length(parts[candidate_idx + 1]) * 17 + row_id * 5 + candidate_idx * 3) % 101 / 10 AS score FROM item1)
"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run ledger entries: user = run, event type = metric."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("run"),
        F.col("event_type").alias("metric"),
        F.col("value"),
        F.col("ts"),
        F.from_json("props", "k long")["k"].alias("k"),
        (1 + F.col("user_id") % 3).cast("int").alias("seed"),
        F.element_at(F.array(F.lit(3e-06), F.lit(1e-05), F.lit(3e-05), F.lit(1e-04)), (1 + F.col("user_id") % 4).cast("int")).alias("lr"),
        F.when(F.col("user_id") % 2 == 0, "validation").otherwise("heldout").alias("phase"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
    )


RUNS_SQL = """
runs AS (
  SELECT event_id AS seq, user_id AS run, event_type AS metric, value, ts, (props->>'k')::BIGINT AS k,
         (1 + user_id % 3)::INT AS seed, ([3e-06, 1e-05, 3e-05, 1e-04])[1 + user_id % 4]::DOUBLE AS lr,
         CASE WHEN user_id % 2 = 0 THEN 'validation' ELSE 'heldout' END AS phase,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status
  FROM events)
"""


# Statements whose reading is known: strategy, text with {n} (number) and {l} (letter) for the label and {m} for another number, whether
# the label read is the letter, and what stands around them: the document before or behind them, or nothing.
LONG_ANSWERS = [
    ("json", 'I compared them all. {{"answer":"{n}"}}', False, "behind"),
    ("boxed", "All told: \\boxed{{{l}}}", True, "before"),
    ("short_answer_line", "Answer: ({n})", False, "behind"),
    ("option_echo_line", "({l}) 40% chance of $5, otherwise nothing", True, "alone"),
    ("answer_marker", "Thus the answer is option {n}, given my aims.", False, "behind"),
    ("decision_verb", "I would definitely pick option {l} because it is safe.", True, "before"),
    ("decision_comparison", "We would prefer {n} over {m}.", False, "behind"),
    ("option_is_best", "Given the spread, option {n} seems to be the most attractive choice.", False, "before"),
    ("expected_value_dominance", "Option {l} has the highest expected utility of $90, clearly.", True, "behind"),
    ("best_choice_is", "The more attractive option is {n}, at $5.", False, "behind"),
    ("decision_modal", "I should pick option {l} overall.", True, "behind"),
    ("single_option_sentence_cue", "In short, option {l} brings the lowest risk.", True, "behind"),
    ("bare_token", "{{{n}}}", False, "alone"),
    ("final_sentence_option", "All in all, {n} is what I should pick today.", False, "before"),
]


def long_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as answers to four options: a statement at one end of the whole text, which is made one line without digits."""
    docs = table(spark, folder, "documents")
    form, number = F.col("doc_id") % len(LONG_ANSWERS), 1 + F.col("doc_id") % 4
    parts = {"n": number.cast("string"), "l": F.char(F.lit(96) + number), "m": (1 + number % 4).cast("string")}
    filler = F.concat(F.lit("My notes: "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[0-9\n\r]", " "))
    response = F.lit(None).cast("string")
    for i, (_, statement, _, place) in enumerate(LONG_ANSWERS):
        marked = statement.format(n="\x00n\x00", l="\x00l\x00", m="\x00m\x00").split("\x00")
        said = F.concat(*[parts[p] if k % 2 else F.lit(p) for k, p in enumerate(marked) if p])
        whole = {"alone": said, "behind": F.concat_ws("\n", said, filler), "before": F.concat_ws("\n", filler, said)}[place]
        response = F.when(form == i, whole).otherwise(response)
    style = F.when(form == len(LONG_ANSWERS) - 1, "numbers")
    return docs.select("doc_id", response.alias("response"), F.lit(4).alias("num_options"), style.alias("label_style"))


def long_answers_sql() -> str:
    strategy = " ".join(f"WHEN {i} THEN '{name}'" for i, (name, *_) in enumerate(LONG_ANSWERS))
    letters = ", ".join(str(i) for i, (_, _, letter, _) in enumerate(LONG_ANSWERS) if letter)
    n = len(LONG_ANSWERS)
    return f"""SELECT doc_id, CASE WHEN doc_id % {n} IN ({letters}) THEN chr((97 + doc_id % 4)::INT) ELSE (1 + doc_id % 4)::VARCHAR END AS choice,
    CASE doc_id % {n} {strategy} END AS strategy FROM documents"""
