"""Quality rules: per-document statistics and robust multivariate outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerframe.functions.lottery import let, sum_of
from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import WORD, save

SYMBOLS = r"[#*$%&|<>]"
#: Coordinates of the statistic vector: name, SQL over the counts (read by Spark and by the twin
#: alike; n_words is positive), and the least standard deviation an estimate may claim for it.
COORDINATES = [
    ("x0", "ln(word_chars / CAST(n_words AS DOUBLE))", 0.06),
    ("x1", "sqrt(n_symbols / CAST(n_words AS DOUBLE))", 0.10),
    ("x2", "sqrt(n_dup_lines / CAST(n_words AS DOUBLE))", 0.06),
    ("x3", "sqrt(n_repeat_words / CAST(n_words AS DOUBLE))", 0.12),
]
UNIT = 10_000  # coordinates are kept as whole numbers of 1 / UNIT, so sums are exact in any order
NAMES = [name for name, _, _ in COORDINATES]
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
#: Chi-square quantile 0.9999 of four degrees of freedom.
CUT = 23.51
#: Share of rows that an estimate rests on, just over half, so that copies of up to nearly half of a
#: group do not make the norm; and what makes its covariance consistent at the normal
#: distribution: share / P(chi2 with 6 degrees <= chi2 quantile of the share with 4).
SHARE, CONSISTENT = 0.51, 2.077


def repeated_words(words: Column) -> Column:
    """Words of the array inside 3-word windows that occur twice or more in it.

    Windows are compared by 64-bit hashes. Only texts whose hashes repeat are
    sorted to find where; a window at i covers i, i + 1 and i + 2.
    """

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def starts(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twin(t: Column, j: Column) -> Column:
            h = F.get(t, j)["h"]
            return F.coalesce(h == F.get(t, j + 1)["h"], F.lit(False)) | F.coalesce(h == F.get(t, j - 1)["h"], F.lit(False))

        return let(
            ordered,
            lambda t: F.sort_array(F.transform(F.filter(t, lambda x, j: twin(t, j)), lambda x: x["i"])),
        )

    def covered(at: Column) -> Column:
        return sum_of(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), 0)

    keys = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    found = let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), let(starts(k), covered)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= 3, found).otherwise(F.lit(0))


def text_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none of any."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.filter(F.split(whole, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    return F.struct(
        let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), of_words).alias("words"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, of_lines).alias("n_dup_lines"),
    )


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, text_statistics(F.col("text")).alias("s")).select(
        *keep,
        "s.words.n_words",
        "s.words.word_chars",
        "s.n_symbols",
        "s.n_dup_lines",
        "s.words.n_repeat_words",
    )


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _cholesky(cov: dict[tuple[int, int], str]) -> list[tuple[str, str]]:
    """(name, SQL) of the lower factor l{i}{j}, each using those before it."""
    out = []
    for i, j in PAIRS:
        rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append((f"l{i}{j}", f"sqrt({cov[i, j]}{rest})" if i == j else f"({cov[i, j]}{rest}) / l{j}{j}"))
    return out


def _solve() -> list[tuple[str, str]]:
    """(name, SQL) of z{i}, the whitened coordinates; their squares add up to the squared distance."""
    return [
        (f"z{i}", f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i}") for i in range(len(NAMES))
    ]


DISTANCE = " + ".join(f"z{i} * z{i}" for i in range(len(NAMES)))
BIN = f"CAST(floor(ln(1 + {DISTANCE}) * 1000) AS BIGINT)"


def _chain(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df


def _floor(i: int) -> str:
    return f"{(COORDINATES[i][2] * UNIT) ** 2}D"


class Estimator:
    """Minimum covariance determinant per group, by concentration steps.

    ``rows`` has ``group``, ``salt`` and the coordinates. The start takes, per
    group, the ``share`` of rows nearest the coordinatewise medians in units of
    their median absolute deviations; a concentration step takes the mean and
    covariance of the chosen rows and chooses the ``share`` nearest in the new
    metric, which never raises the determinant. The choice is made by a histogram
    of distances per group, so no group is sorted; rows of the last chosen cell
    are all taken. Estimates join the rows by group and salt, so a group that holds
    most rows spreads over ``salts`` tasks.
    """

    def __init__(self, rows: DataFrame, salts: int = 16, share: float = SHARE, consistent: float = CONSISTENT):
        self.rows, self.salts, self.share, self.consistent = rows, salts, share, consistent

    def with_estimates(self, estimates: DataFrame) -> DataFrame:
        salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        return self.rows.join(salted, ["group", "salt"])

    def medians(self, of: DataFrame) -> DataFrame:
        """(group, m0, m1, ...): the lower medians of whole-number columns, by counting values."""
        long = of.select("group", F.posexplode(F.array(*NAMES)).alias("i", "value"))
        counts = long.groupBy("group", "i", "value").agg(F.count(F.lit(1)).alias("n"))
        by = Window.partitionBy("group", "i")
        upto = by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        middle = (
            counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(by)})
            .filter(2 * F.col("_upto") >= F.col("_all"))
            .groupBy("group", "i")
            .agg(F.min("value").alias("value"))
        )
        return middle.groupBy("group").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"m{i}") for i in range(len(NAMES))])

    def start(self) -> DataFrame:
        medians = save(self.medians(self.rows), "mcd-medians")
        apart = self.with_estimates(medians).select("group", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in range(len(NAMES))])
        spreads = self.medians(apart).select("group", *[F.col(f"m{i}").alias(f"d{i}") for i in range(len(NAMES))])
        scale = {(i, j): f"pow(1.4826D * d{i}, 2) + {_floor(i)}" if i == j else "0D" for i, j in PAIRS}
        return self.factors(medians.join(spreads, "group"), scale)

    def factors(self, df: DataFrame, cov: dict[tuple[int, int], str]) -> DataFrame:
        names = [f"m{i}" for i in range(len(NAMES))] + [f"l{i}{j}" for i, j in PAIRS]
        return save(_chain(df, _cholesky(cov)).select("group", *names), "mcd-estimate")

    def concentrate(self, estimates: DataFrame) -> DataFrame:
        cells = _chain(self.with_estimates(estimates), _solve()).withColumn("cell", F.expr(BIN))
        by = Window.partitionBy("group")
        upto = by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        last = (
            cells.groupBy("group", "cell")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(by)})
            .filter(F.col("_upto") >= self.share * F.col("_all"))
            .groupBy("group")
            .agg(F.min("cell").alias("last"))
        )
        chosen = _chain(self.with_estimates(estimates.join(last, "group")), _solve()).filter(F.expr(BIN) <= F.col("last"))
        sums = chosen.groupBy("group").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.sum(f"x{i}").cast("double").alias(f"s{i}") for i in range(len(NAMES))],
            *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).cast("double").alias(f"p{i}{j}") for i, j in PAIRS],
        )
        means = sums.select("*", *[F.expr(f"s{i} / n").alias(f"m{i}") for i in range(len(NAMES))])
        return self.factors(means, _covariance(self.consistent))


def _covariance(consistent: float) -> dict[tuple[int, int], str]:
    """SQL of the covariances from n, the products p and the means m."""
    return {(i, j): f"{consistent}D * (p{i}{j} / n - m{i} * m{j})" + (f" + {_floor(i)}" if i == j else "") for i, j in PAIRS}


def judge(
    docs: DataFrame,
    min_rows: int = 50,
    steps: int = 4,
    salts: int = 16,
    share: float = SHARE,
    consistent: float = CONSISTENT,
) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    Rows that pass the base rules (50 words or more, at most half of them inside
    repeated 3-word windows) form groups of language and source. Groups of fewer
    than ``min_rows`` rows are pooled per language, and then over languages. A
    row is rejected when its squared Mahalanobis distance, by its group's robust
    estimate from the ``share`` of rows that lie closest, is above ``CUT``. Coordinates in which most rows agree (no symbols,
    no repeats) keep the least deviations of ``COORDINATES``.

    Returns ``doc_id``, the five counts, ``base_failed``, ``distance`` (null if
    base_failed) and ``kept``. Null languages and sources are groups like others;
    null, empty and blank texts have no words and fail the base rules; equal rows
    are judged alike; very long texts are counted whole; no rows give no rows. Other
    columns are not read.
    """
    counted = save(
        with_statistics(docs, "doc_id", "lang", "source").withColumn("base_failed", base_failed()), "quality-statistics"
    )
    passing = counted.filter(~F.col("base_failed"))
    sizes = passing.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_rows
    pooled = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    groups = sizes.select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.when(~small, F.concat_ws("|", tag("lang"), tag("source")))
        .when(pooled >= min_rows, F.concat_ws("|", tag("lang"), F.lit("pooled")))
        .otherwise(F.lit("pooled"))
        .alias("group"),
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(salts)).cast("int"))
    whole = [F.when(~F.col("base_failed"), F.expr(f"CAST(round({sql} * {UNIT}) AS BIGINT)")).alias(name) for name, sql, _ in COORDINATES]
    same = salted["lang"].eqNullSafe(groups["_lang"]) & salted["source"].eqNullSafe(groups["_source"]) & (F.col("_salt") == F.col("salt"))
    placed = save(
        salted.join(groups, same, "left").select(
            *counted.columns, F.when(~F.col("base_failed"), F.col("group")).alias("group"), F.col("_salt").alias("salt"), *whole
        ),
        "quality-rows",
    )
    estimator = Estimator(placed.filter(~F.col("base_failed")).select("group", "salt", *NAMES), salts, share, consistent)
    estimates = estimator.start()
    for _ in range(steps):
        estimates = estimator.concentrate(estimates)
    last = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    judged = _chain(placed.join(last, ["group", "salt"], "left"), _solve()).withColumn("distance", F.expr(DISTANCE))
    return judged.select(
        *counted.columns, "distance", F.coalesce(F.col("distance") <= CUT, F.lit(False)).alias("kept")
    )


def drop_low_quality(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    A verdict depends on a row's language, source and text only, so rows of equal
    id are told apart by those.
    """
    key = F.struct("doc_id", F.xxhash64("lang", "source", "text").alias("hash"))
    judged = judge(docs.select(key.alias("doc_id"), "lang", "source", "text"), **parameters)
    kept = judged.filter("kept").select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.hash").alias("_hash")).distinct()
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("id"), F.xxhash64("lang", "source", "text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return rows.join(kept, same, "left_semi").select("whole.*")


def _twin(min_rows: int = 50, steps: int = 4) -> str:
    n = len(NAMES)
    columns = ", ".join(f"round({sql} * {UNIT})::BIGINT AS {name}" for name, sql, _ in COORDINATES)

    def chained(source: str, select: str, chain: list[tuple[str, str]], tail: str = "") -> str:
        for name, sql in chain:
            source = f"(SELECT *, {sql} AS {name} FROM {source})"
        return f"SELECT {select} FROM {source} {tail}"

    plain = lambda cov: {k: v.replace("D", "::DOUBLE") for k, v in cov.items()}  # noqa: E731  Spark's suffix of double literals
    names = ", ".join([f"m{i}" for i in range(n)] + [f"l{i}{j}" for i, j in PAIRS])
    scale = plain({(i, j): f"pow(1.4826D * d{i}, 2) + {_floor(i)}" if i == j else "0D" for i, j in PAIRS})

    def medians(source: str, out: str) -> str:
        return f"""SELECT grp, {', '.join(f"max(CASE WHEN i = {i} THEN value END) AS {out}{i}" for i in range(n))} FROM (
            SELECT grp, i, min(value) AS value FROM (
                SELECT grp, i, value, sum(c) OVER (PARTITION BY grp, i ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto,
                       sum(c) OVER (PARTITION BY grp, i) AS total
                FROM (SELECT grp, i, value, count(*) AS c FROM ({source}) GROUP BY ALL)
            ) WHERE 2 * upto >= total GROUP BY ALL) GROUP BY grp"""

    flat = " UNION ALL ".join(f"SELECT grp, {i} AS i, x{i} AS value FROM passing" for i in range(n))
    apart = " UNION ALL ".join(f"SELECT grp, {i} AS i, abs(x{i} - m{i}) AS value FROM passing JOIN med USING (grp)" for i in range(n))
    parts = [
        rf"""WITH words AS MATERIALIZED (
            SELECT doc_id, lang, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
        ), repeats AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM (
                SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM windows
            ), (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), counted AS MATERIALIZED (
            SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols,
                   coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
                   n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
            FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
        ), sizes AS (
            SELECT lang, source, count(*) AS n, sum(CASE WHEN count(*) < {min_rows} THEN count(*) END) OVER (PARTITION BY lang) AS pool
            FROM counted WHERE NOT base_failed GROUP BY lang, source
        ), grouped AS (
            SELECT lang AS l, source AS s, CASE WHEN n >= {min_rows} THEN concat(coalesce('=' || lang, 'null'), '|', coalesce('=' || source, 'null'))
                   WHEN pool >= {min_rows} THEN coalesce('=' || lang, 'null') || '|pooled' ELSE 'pooled' END AS grp
            FROM sizes
        ), passing AS MATERIALIZED (
            SELECT doc_id, grp, {columns}
            FROM counted JOIN grouped ON lang IS NOT DISTINCT FROM l AND source IS NOT DISTINCT FROM s WHERE NOT base_failed
        ), med AS MATERIALIZED ({medians(flat, 'm')}), mad AS MATERIALIZED ({medians(apart, 'd')}),
        e0 AS MATERIALIZED ({chained('(SELECT * FROM med JOIN mad USING (grp))', 'grp, ' + names, _cholesky(scale))})"""
    ]
    for k in range(steps):
        products = ", ".join(f"sum((x{i} * x{j})::HUGEINT)::DOUBLE AS p{i}{j}" for i, j in PAIRS)
        sums = ", ".join(f"sum(x{i})::DOUBLE AS s{i}" for i in range(n))
        means = ", ".join(f"s{i} / n AS m{i}" for i in range(n))
        chosen = f"(SELECT grp, count(*)::DOUBLE AS n, {sums}, {products} FROM c{k} JOIN t{k} USING (grp) WHERE cell <= last GROUP BY grp)"
        parts.append(
            f"""c{k} AS MATERIALIZED ({chained(f'(SELECT * FROM passing JOIN e{k} USING (grp))', f'grp, {", ".join(NAMES)}, {BIN} AS cell', _solve())}),
            t{k} AS (SELECT grp, min(cell) AS last FROM (
                SELECT grp, cell, sum(c) OVER (PARTITION BY grp ORDER BY cell ROWS UNBOUNDED PRECEDING) AS upto, sum(c) OVER (PARTITION BY grp) AS total
                FROM (SELECT grp, cell, count(*) AS c FROM c{k} GROUP BY ALL)) WHERE upto >= {SHARE} * total GROUP BY grp),
            e{k + 1} AS MATERIALIZED ({chained(f'(SELECT *, {means} FROM {chosen})', 'grp, ' + names, _cholesky(plain(_covariance(CONSISTENT))))})"""
        )
    judged = chained(f"(SELECT * FROM passing JOIN e{steps} USING (grp))", f"doc_id, {DISTANCE} AS distance", _solve())
    return (
        ",\n".join(parts)
        + f""", judged AS ({judged})
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(distance <= {CUT}, false) AS kept
        FROM counted LEFT JOIN judged USING (doc_id)"""
    )


@query("op9_quality_rules", _twin())
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
