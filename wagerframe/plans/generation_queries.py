"""Queries that draw from keys and generate situation tables over the orders."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from wagerframe.functions import checks, draws, lottery
from wagerframe.operators import generate, quotas
from wagerframe.operators import situations as sit
from wagerframe.operators.ranking import one_row
from wagerframe.plans.option_queries import _SETS, six
from wagerframe.plans.pair_queries import uniform_sql
from wagerframe.plans.registry import query, spread, table
from wagerframe.plans.views import cents_sql, rsig, situations, with_options


def keys(spark, folder):
    return spread(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", costly=True)


def u(stream):
    return uniform_sql(1, "o_orderkey", stream)


@query(
    "keyed_draws",
    f"""SELECT o_orderkey, round({u('a')}, 9) AS uniform, 3 + floor({u('b')} * 8)::INT AS whole,
    CASE WHEN {u('c')} < 0.6 THEN 2 WHEN {u('c')} < 0.8 THEN 3 WHEN {u('c')} < 0.9 THEN 4 ELSE 5 END AS weighted,
    round(ln(exp(ln(500.0) + {u('d')} * (ln(50000.0) - ln(500.0)))), 6) AS log_value,
    CASE WHEN {u('e')} < 0.1 THEN 0.0 ELSE round({u('f')} * 100000.0, 4) END AS wealth FROM orders""",
)
def keyed_draws(spark, folder):
    k = F.col("o_orderkey")

    def draw(stream):
        return draws.uniform(1, k, stream)

    return keys(spark, folder).select(
        "o_orderkey",
        F.round(draw("a"), 9).alias("uniform"),
        draws.uniform_int(1, k, "b", 3, 10).alias("whole"),
        draws.weighted_choice(draw("c"), generate.COUNTS, generate.COUNT_WEIGHTS).alias("weighted"),
        six(F.ln(draws.log_uniform(draw("d"), 500.0, 50_000.0))).alias("log_value"),
        F.round(draws.zero_inflated(draw("e"), draw("f"), 0.1, 100_000.0), 4).alias("wealth"),
    )


@query(
    "type_masks",
    f"""WITH m AS (SELECT o_orderkey, (2 + o_orderkey % 4)::INT AS n, 1 + floor({u('mask')} * ((1 << (2 + o_orderkey % 4)::INT) - 2))::INT AS mask FROM orders)
    SELECT o_orderkey, list_transform(range(n), lambda i: CASE WHEN (mask >> i::INT) % 2 = 1 THEN 'Rebel' ELSE 'Cooperate' END) AS types FROM m""",
)
def type_masks(spark, folder):
    n = (2 + F.col("o_orderkey") % 4).cast("int")
    return keys(spark, folder).select("o_orderkey", generate.option_types(1, F.col("o_orderkey"), n, "rebels_only").alias("types"))


@query(
    "compositions",
    f"""WITH s AS (SELECT o_orderkey, (2 + o_orderkey % 4)::INT AS n, CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 100 END AS whole FROM orders),
    c AS (SELECT *, {", ".join(f"whole - n + {i} AS e{i}, 1 + floor({uniform_sql(1, 'o_orderkey', "percents#' || (whole - n + " + str(i) + ") || '")} * (whole - n + {i}))::INT AS t{i}" for i in (1, 2, 3, 4))} FROM s),
    d AS (SELECT *, t1 AS c1, CASE WHEN t2 = t1 THEN e2 ELSE t2 END AS c2 FROM c),
    e AS (SELECT *, CASE WHEN t3 IN (c1, c2) THEN e3 ELSE t3 END AS c3 FROM d),
    f AS (SELECT *, CASE WHEN t4 IN (c1, c2, c3) THEN e4 ELSE t4 END AS c4 FROM e),
    g AS (SELECT o_orderkey, n, whole, list_sort(([c1, c2, c3, c4])[1:n - 1]) AS cuts FROM f)
    SELECT o_orderkey, list_transform(range(1, n + 1), lambda i: ((CASE WHEN i = n THEN whole ELSE cuts[i] END
      - CASE WHEN i = 1 THEN 0 ELSE cuts[i - 1] END) * (100 // whole))::INT) AS percents FROM g""",
)
def compositions(spark, folder):
    k = F.col("o_orderkey")
    n = (2 + k % 4).cast("int")
    return keys(spark, folder).select("o_orderkey", draws.percents(1, k, "percents", n, k % 2 == 0).alias("percents"))


def _flat(df):
    return df.select("situation_id", "subset_type", "use_verbal_probs", F.inline_outer("options"))


@query("generated_high_stakes")
def generated_high_stakes(spark, folder):
    """Two subsets at two stakes levels, by key; rows only (draws are tested by invariants)."""
    k = keys(spark, folder)
    rebels = generate.high_stakes(k.filter(F.col("o_orderkey") % 2 == 0), "o_orderkey", 1, "rebels_only", "astronomical")
    steals = generate.high_stakes(k.filter(F.col("o_orderkey") % 2 == 1), "o_orderkey", 1, "steals_only", "medium")
    return _flat(rebels).unionByName(_flat(steals))


@query("generated_low_stakes")
def generated_low_stakes(spark, folder):
    return _flat(generate.low_stakes(keys(spark, folder), "o_orderkey", 2))


TRANSFER = ["gpu_hours", "lives_saved", "money_for_user"]


@query("generated_transfer_sets")
def generated_transfer_sets(spark, folder):
    """Mixed subset in the three transfer quantities, each over all keys."""
    parts = [
        _flat(generate.high_stakes(keys(spark, folder), "o_orderkey", 5 + i, "steals_and_rebels", "high", name)).withColumn("domain", F.lit(name))
        for i, name in enumerate(TRANSFER)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _drawn_sql(seed: int, domain: str) -> str:
    """The draws of a low-stakes situation that its options do not depend on."""

    def u(stream):
        return uniform_sql(seed, "o_orderkey", stream)

    most = generate.DOMAINS[domain].most_wealth
    return f"""SELECT '{domain}' AS domain, o_orderkey AS situation_id,
      CASE WHEN {u('options')} < 0.5 THEN 2 WHEN {u('options')} < 0.8 THEN 3 WHEN {u('options')} < 0.95 THEN 4 ELSE 5 END AS num_options,
      {u('verbal')} < 0.5 AS use_verbal_probs, (2 + floor({u('rounding')} * 4))::INT AS digits,
      CASE WHEN {u('no wealth')} < 0.1 THEN 0.0 ELSE {u('wealth')} * {most} END AS wealth FROM orders"""


@query(
    "generated_transfer_low",
    f"""SELECT domain, situation_id, num_options, use_verbal_probs, round({cents_sql(rsig('wealth', 'digits'))}, 2) AS initial_wealth,
      num_options AS whole_options FROM ({" UNION ALL ".join(_drawn_sql(7 + i, name) for i, name in enumerate(TRANSFER))})""",
)
def generated_transfer_low(spark, folder):
    """Small gambles in the transfer quantities: what was drawn, and how many options keep every rule of their kind."""

    def whole(o):
        total = F.aggregate(o["probs"], F.lit(0), lambda a, v: a + v)
        fives = ~F.col("use_verbal_probs") | F.forall(o["probs"], lambda v: v % 5 == 0)
        small = F.forall(o["prizes"], lambda v: F.abs(v) <= generate.LOW_PRIZE)
        return (total == 100) & fives & small & (F.size(o["prizes"]) == F.size(o["probs"])) & F.size(o["probs"]).between(1, 4)

    parts = [
        generate.low_stakes(keys(spark, folder), "o_orderkey", 7 + i, name).select(
            F.lit(name).alias("domain"),
            "situation_id",
            "num_options",
            "use_verbal_probs",
            F.round("initial_wealth", 2).alias("initial_wealth"),
            F.size(F.filter("options", whole)).alias("whole_options"),
        )
        for i, name in enumerate(TRANSFER)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "transfer_prompts_read_back",
    with_options(
        """, merged AS (SELECT situation_id, option_index, x, sum(p)::INT AS p FROM outc GROUP BY situation_id, option_index, x)
        SELECT domain, situation_id, option_index + 1 AS option_number, round_even(x * size, 0) / size + 0.0 AS prize, p AS percent
        FROM merged, (VALUES ('money', 100.0), ('gpu_hours', 100.0), ('lives_saved', 10.0), ('money_for_user', 100.0)) v(domain, size)"""
    ),
)
def transfer_prompts_read_back(spark, folder):
    """Every outcome of every option, written in the words of each quantity and read from the text again."""
    told = situations(spark, folder).withColumns(
        {
            "subset_type": F.coalesce("raw_subset", F.lit("rebels_only")),
            "source_stakes": F.when(F.col("situation_id") % 3 == 0, "astronomical").otherwise(F.col("source_stakes")),
        }
    )
    # The situations are made once for all quantities.
    written = lottery.settle(told, "options")
    for domain in generate.DOMAINS:
        written = generate.render_prompts(written, 3, domain).withColumnRenamed("prompt_text", f"in_{domain}").drop("uses_letters")
    told_in = [F.struct(F.lit(d).alias("domain"), checks.read_options(F.col(f"in_{d}"), d).alias("options")) for d in generate.DOMAINS]
    read = written.select("situation_id", F.explode(F.array(*told_in)).alias("t"))
    options = read.select("t.domain", "situation_id", F.posexplode("t.options").alias("at", "o"))
    outcomes = options.select("domain", "situation_id", (F.col("at") + 1).alias("option_number"), F.explode("o.outcomes").alias("v"))
    return outcomes.select(
        "domain", "situation_id", "option_number", (F.col("v.x") + 0.0).alias("prize"), F.rint(F.col("v.p") * 100).cast("int").alias("percent")
    )


@query("generated_accepted")
def generated_accepted(spark, folder):
    """Situations left by the rejection guards."""
    table_ = generate.high_stakes(keys(spark, folder), "o_orderkey", 1, "rebels_only", "medium")
    return generate.accepted(table_).select("situation_id", "num_options", "use_verbal_probs")


@query(
    "generated_integrity",
    "SELECT count(*)::BIGINT AS situations, 0::BIGINT AS violations FROM orders",
)
def generated_integrity(spark, folder):
    """Integrity violations of a generated table: none."""
    made = generate.high_stakes(keys(spark, folder), "o_orderkey", 1, "steals_and_rebels", "high")
    whole = F.forall(
        "options",
        lambda o: (F.aggregate(o["probs"], F.lit(0), lambda a, v: a + v) == 100)
        & (F.size(o["probs"]) == F.size(o["prizes"]))
        & (~F.col("use_verbal_probs") | F.forall(o["probs"], lambda v: v % 5 == 0)),
    )
    kinds = F.size(F.array_distinct(F.transform("options", lambda o: o["option_type"]))) == 3
    return made.agg(F.count("*").alias("situations"), F.count_if(~(whole & kinds)).alias("violations"))


@query(
    "generated_prompts_read_back",
    "SELECT count(*)::BIGINT AS situations, count(*)::BIGINT AS read_back FROM orders",
)
def generated_prompts_read_back(spark, folder):
    """Rendered prompts, parsed again, give the options they were rendered from."""
    made = generate.render_prompts(generate.low_stakes(keys(spark, folder), "o_orderkey", 2), 2)
    read = made.withColumn("_p", checks.prompt_options(F.col("prompt_text")))
    same = F.coalesce(
        (F.size("_p") == F.col("num_options"))
        & F.forall(
            F.zip_with(
                "_p",
                "options",
                lambda a, b: F.struct(
                    lottery.sum_of(F.transform(a["outcomes"], lambda v: v["p"] * v["x"])).alias("a"),
                    lottery.expected_value(b["prizes"], b["probs"]).alias("b"),
                ),
            ),
            lambda s: F.abs(s["a"] - s["b"]) < 1e-6,
        ),
        F.lit(False),
    )
    return read.select(same.alias("same")).agg(F.count("*").alias("situations"), F.count_if(F.col("same")).alias("read_back"))


# Two hundred situations: minima of the buckets and of the situations with two and with three options.
ORDER_QUOTA = quotas.Quota(200, {"lin_only": 100, "010_only": 15, "both": 10}, {2: 60, 3: 60})


def _quota_sql(quota: quotas.Quota) -> str:
    """Attempts up to which the quota can be filled: running counts per cell, and the least cut of the flow between minima."""
    buckets, sizes = list(quota.buckets), list(quota.options)
    cells = {(b, o): f"c{i}_{o}" for i, b in enumerate(buckets) for o in (0, *sizes)}
    size = f"CASE WHEN num_options IN ({', '.join(map(str, sizes))}) THEN num_options ELSE 0 END"
    sums = ", ".join(
        f"sum((bucket = '{b}' AND {size} = {o})::INT) OVER (ORDER BY situation_id ROWS UNBOUNDED PRECEDING) AS {name}" for (b, o), name in cells.items()
    )
    cuts = []
    for chosen in itertools.product([0, 1], repeat=len(buckets) + len(sizes)):
        held, reached = chosen[: len(buckets)], chosen[len(buckets) :]
        terms = [str(quota.buckets[b]) for b, h in zip(buckets, held) if not h] + [str(quota.options[o]) for o, r in zip(sizes, reached) if r]
        terms += [cells[b, o] for b, h in zip(buckets, held) for o, r in zip(sizes, reached) if h and not r]
        cuts.append(" + ".join(terms) or "0")
    rules = [" + ".join(cells[b, o] for o in (0, *sizes)) + f" >= {n}" for b, n in quota.buckets.items()]
    rules += [" + ".join(cells[b, o] for b in buckets) + f" >= {n}" for o, n in quota.options.items()]
    rules.append(" + ".join(cells.values()) + f" >= {quota.total}")
    needed = sum(quota.buckets.values()) + sum(quota.options.values())
    rules.append(f"{needed} - least({', '.join(cuts)}) <= {quota.total}")
    return f""", r AS (SELECT situation_id, bucket, row_number() OVER (ORDER BY situation_id) AS attempt, {sums} FROM bucketed),
    a AS (SELECT min(attempt) AS attempts FROM r WHERE {" AND ".join(rules)})
    SELECT attempts, {quota.total}::BIGINT AS kept, attempts - {quota.total} AS rejected,
      (SELECT count(*) FROM r WHERE attempt <= attempts AND bucket NOT IN ({", ".join(f"'{b}'" for b in buckets)}))::BIGINT AS in_no_allowed_bucket,
      true AS minima_met, true AS within_attempts FROM a"""


def _told(report, kept, quota, key, last):
    """The report, and whether the kept situations meet every minimum and come from the attempts counted."""
    held = [F.count_if(F.col("bucket") == b) >= n for b, n in quota.buckets.items()]
    held += [F.count_if(F.col("num_options") == o) >= n for o, n in quota.options.items()] + [F.count("*") == quota.total]
    met = held[0]
    for rule in held[1:]:
        met = met & rule
    facts = kept.agg(met.alias("minima_met"), F.max(key).alias("_last"))
    told = report.withColumn("_f", one_row(facts)).withColumn("minima_met", F.col("_f.minima_met"))
    return told.withColumn("within_attempts", F.col("_f._last") <= last).drop("_f")


@query("quota_until_filled", with_options(_SETS + _quota_sql(ORDER_QUOTA)))
def quota_until_filled(spark, folder):
    """How many situations must be looked at until two hundred with all minima can be kept."""
    rolled = sit.roll_up(sit.score(situations(spark, folder))).select("situation_id", "bucket", "num_options")
    kept, report = quotas.fill_quota(rolled, ORDER_QUOTA, "situation_id", "bucket", "num_options")
    last = rolled.agg(F.max("situation_id")).scalar()
    return _told(report, kept, ORDER_QUOTA, "situation_id", last)


@query(
    "generated_until_quota",
    "SELECT (count(*) // 10)::BIGINT AS kept, true AS minima_met, true AS within_attempts, true AS counts_agree FROM orders",
)
def generated_until_quota(spark, folder):
    """Small gambles for a tenth of the orders: a third of them in each of two buckets, three tenths each of two and of three options."""
    total = table(spark, folder, "orders").count() // 10
    quota = quotas.Quota(total, {"lin_only": total // 3, "010_only": total // 3}, {2: total * 3 // 10, 3: total * 3 // 10})

    def make(attempts):
        made = generate.low_stakes(attempts, "attempt", 11, "gpu_hours").withColumn("raw_subset", F.lit("rebels_only"))
        return sit.roll_up(sit.score(made, "exact")).select("situation_id", "num_options", "bucket")

    made, report = quotas.generate_until(spark, make, quota)
    told = _told(report, made, quota, "situation_id", F.col("attempts"))
    return told.select("kept", "minima_met", "within_attempts", (F.col("attempts") == F.col("kept") + F.col("rejected")).alias("counts_agree"))


@query("generated_buckets")
def generated_buckets(spark, folder):
    """Utility buckets of the small gambles, on exact values."""
    scored = sit.score(generate.low_stakes(keys(spark, folder), "o_orderkey", 2), "exact")
    sets = sit.best_sets(F.col("options"))
    bucket = lottery.bucket(sets["linear_best"], sets["low_best"], sets["high_best"])
    return scored.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("situations"))
