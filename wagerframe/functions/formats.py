"""Quantity, probability and label text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wagerframe.functions import lottery

# The phrase for each percent of a verbal probability.
VERBAL_PHRASES = {
    100: "Certainly will give",
    95: "Almost certain to give",
    90: "Highly likely to give",
    85: "Very likely to give",
    80: "Likely to give",
    75: "Probable to give",
    70: "Fairly likely to give",
    65: "Somewhat likely to give",
    60: "More than a half-chance of",
    55: "Just more than a half-chance of",
    50: "A half-chance of",
    45: "Just less than a half-chance of",
    40: "Less than a half-chance of",
    35: "Somewhat unlikely to give",
    30: "Fairly unlikely to give",
    25: "Improbable to give",
    20: "Unlikely to give",
    15: "Very unlikely to give",
    10: "Highly unlikely to give",
    5: "Almost certainly won't give",
    0: "Certainly won't give",
}
#: Outcomes of the other quantities are results, not gifts.
RESULT_PHRASES = {percent: phrase.replace("give", "result in") for percent, phrase in VERBAL_PHRASES.items()}
PROBABILITY_STYLES = ["pct_probability", "pct_chance", "decimal_probability", "decimal_chance"]


def _literal_map(pairs: dict) -> Column:
    cells = [F.lit(cell) for pair in pairs.items() for cell in pair]
    return F.create_map(*cells)


def is_whole(size: Column) -> Column:
    return F.abs(size - F.rint(size)) <= 1e-9


def _grouped(size: Column, decimals: int) -> Column:
    """Thousands separators; whole amounts carry no decimals."""
    return F.when(is_whole(size), F.format_number(F.rint(size), 0)).otherwise(
        F.format_number(lottery.half_even(size, decimals), decimals)
    )


def _scientific(size: Column) -> Column:
    return F.format_string("%.2e", size)


def money(value: Column) -> Column:
    """``-$1,234.50``; from a billion on ``$1.23e+10``."""
    size = F.abs(value)
    body = F.when(size < 1e9, _grouped(size, 2)).otherwise(_scientific(size))
    return F.when(F.isnan(value), "$NaN").otherwise(
        F.concat(F.when(value < 0, "-$").otherwise("$"), body)
    )


def lives(value: Column) -> Column:
    size = F.abs(value)
    body = F.when(size < 1e9, _grouped(size, 1)).otherwise(_scientific(size))
    unit = F.when(is_whole(size) & (F.rint(size) == 1), "life").otherwise("lives")
    return F.when(F.isnan(value), "NaN lives").otherwise(
        F.concat(F.when(value < 0, "-").otherwise(""), body, F.lit(" "), unit)
    )


def gpu_hours(value: Column) -> Column:
    size = F.abs(value)
    body = F.when(size < 1e9, _grouped(size, 2)).otherwise(_scientific(size))
    return F.when(F.isnan(value), "NaN GPU-hours").otherwise(
        F.concat(F.when(value < 0, "-").otherwise(""), body, F.lit(" GPU-hours"))
    )


@dataclass(frozen=True)
class OutcomeWords:
    """How outcomes of a quantity are worded, for writing and for reading alike.

    A size stands between the two parts of ``gain`` or ``loss``; ``units`` (one, many)
    follow where the quantity counts things.
    """

    gain: tuple[str, str]
    loss: tuple[str, str]
    zero: str
    nan: str
    decimals: int = 2
    units: tuple[str, str] | None = None


# The outcome words of each quantity.
OUTCOME_WORDS = {
    "money": OutcomeWords(("$", ""), ("-$", ""), "$0", "$NaN"),
    "gpu_hours": OutcomeWords(("gaining ", " GPU-hours"), ("losing ", " GPU-hours"), "gaining 0 GPU-hours", "gaining NaN GPU-hours"),
    "lives_saved": OutcomeWords(
        ("saving ", " more "), ("saving ", " fewer "), "saving 0 additional lives", "saving NaN lives", 1, ("life", "lives")
    ),
    "money_for_user": OutcomeWords(("gaining your user $", ""), ("losing your user $", ""), "gaining your user $0", "gaining your user $NaN"),
}
_SIZE = r"\d[\d,]*(?:\.\d+)?(?:e\+\d+)?"


def outcome_text(value: Column, domain: str) -> Column:
    """An outcome in the words of its quantity."""
    words = OUTCOME_WORDS[domain]
    size = F.abs(value)
    body = F.when(size < 1e9, _grouped(size, words.decimals)).otherwise(_scientific(size))
    unit = F.lit("")
    if words.units:
        one, many = words.units
        unit = F.when(is_whole(size) & (F.rint(size) == 1), one).otherwise(many)
    gain, loss = (F.concat(F.lit(before), body, F.lit(after), unit) for before, after in (words.gain, words.loss))
    return F.when(F.isnan(value), words.nan).when(size < 1e-9, words.zero).when(value > 0, gain).otherwise(loss)


def outcome_pattern(domain: str) -> str:
    """A regular expression without groups for outcomes as ``outcome_text`` writes them."""
    words = OUTCOME_WORDS[domain]
    unit = f"(?:{'|'.join(re.escape(u) for u in sorted(words.units, key=len, reverse=True))})" if words.units else ""
    sized = [re.escape(before) + _SIZE + re.escape(after) + unit for before, after in (words.gain, words.loss)]
    return f"(?:{re.escape(words.zero)}|{'|'.join(sorted(sized, key=len, reverse=True))})"


def outcome_value(text: Column, domain: str) -> Column:
    """The number that ``outcome_text`` worded, as far as its digits tell; null for other texts."""
    words = OUTCOME_WORDS[domain]

    def sized(before: str, after: str) -> Column:
        return F.regexp_extract(text, "^" + re.escape(before) + f"({_SIZE})" + re.escape(after), 1)

    number = lambda t: F.regexp_replace(t, ",", "").try_cast("double")
    lost = lottery.let(sized(*words.loss), lambda t: F.when(t != "", F.lit(0.0) - number(t)))
    worded = lottery.let(sized(*words.gain), lambda t: F.when(t != "", number(t)).otherwise(lost))
    return F.when(text == words.zero, F.lit(0.0)).otherwise(worded)


def lives_outcome(value: Column) -> Column:
    return outcome_text(value, "lives_saved")


def gpu_hours_outcome(value: Column) -> Column:
    return outcome_text(value, "gpu_hours")


def user_money_outcome(value: Column) -> Column:
    return outcome_text(value, "money_for_user")


def three_figures(value: Column) -> Column:
    """Shortest text of a value at three significant figures (``0.05``, ``12.5``, ``1.23e+10``)."""

    def shown(kept: Column) -> Column:
        size = F.abs(kept)
        plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", kept), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        sci = F.regexp_replace(F.regexp_replace(F.format_string("%.2e", kept), r"(\.\d*?)0+e", "$1e"), r"\.e", "e")
        return F.when(size == 0, "0").when((size >= 1e-4) & (size < 1e3), plain).otherwise(sci)

    return lottery.let(lottery.round_significant(value, 3), shown)


def lottery_amount(value: Column) -> Column:
    size = F.abs(value)
    text = F.regexp_replace(F.format_number(lottery.half_even(value, 2), 2), r"\.00$", "")
    return F.when(size < 1e9, text).otherwise(three_figures(value))


def lottery_text(x: Column, p: Column) -> Column:
    """``0.25(-$…)``-style summary of the merged lottery, lowest outcome first."""
    return F.array_join(
        F.transform(
            lottery.merged(x, p),
            lambda s: F.concat(three_figures(s["p"]), F.lit("("), lottery_amount(s["x"]), F.lit(")")),
        ),
        ", ",
    )


def percent_decimal(percent: Column) -> Column:
    """``percent / 100`` as the shortest decimal with at least one digit after the point."""
    text = F.regexp_replace(F.format_string("%.2f", percent / 100.0), r"0$", "")
    return text


def verbal_phrases(domain: str) -> dict[int, str]:
    return VERBAL_PHRASES if domain == "money" else RESULT_PHRASES


def probability_phrase(percent: Column, style: Column, phrases: dict[int, str] = VERBAL_PHRASES) -> Column:
    """Numeric styles, or the verbal phrase for multiples of five (null otherwise)."""
    number = percent.cast("string")
    return (
        F.when(style == "pct_probability", F.concat(number, F.lit("% probability of")))
        .when(style == "pct_chance", F.concat(number, F.lit("% chance of")))
        .when(style == "decimal_probability", F.concat(F.lit("probability "), percent_decimal(percent), F.lit(" of")))
        .when(style == "decimal_chance", F.concat(percent_decimal(percent), F.lit(" chance of")))
        .when(style == "verbal", F.try_element_at(_literal_map(phrases), percent.cast("int")))
    )


def phrase_probability(phrase: Column, phrases: dict[int, str] = VERBAL_PHRASES) -> Column:
    """Probability of a verbal phrase, any case; null for an unknown phrase."""
    inverse = {text.lower(): percent for percent, text in phrases.items()}
    return F.try_element_at(_literal_map(inverse), F.lower(phrase)) / 100.0


def text_probability(text: Column) -> Column:
    """``5%`` and numbers above one are percents; other numbers are taken as given."""

    def chance(t: Column) -> Column:
        number = F.regexp_replace(t, "%$", "").try_cast("double")
        return lottery.let(number, lambda n: F.when(t.endswith("%") | (n > 1.0), n / 100.0).otherwise(n))

    return lottery.let(text, chance)


def option_label(index: Column, letters: Column, brackets: Column, period: Column) -> Column:
    core = F.when(letters, F.char(F.lit(97) + index)).otherwise((index + 1).cast("string"))
    core = F.when(brackets, F.concat(F.lit("("), core, F.lit(")"))).otherwise(core)
    return F.when(period, F.concat(core, F.lit("."))).otherwise(core)


def clean_option_label(label: Column) -> Column:
    return F.translate(label, "().", "")
