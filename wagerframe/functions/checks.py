"""Checks of reasoning text, extraction of answers and of the options in a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wagerframe.functions import formats, text, wordings
from wagerframe.functions.lottery import let

# Phrases that betray a reference to the task's instructions.
META_REFERENCES = [
    r"\binstruction(?:s)?\b",
    r"\bas instructed\b",
    r"\bthe problem states\b",
    r"\bthe prompt says\b",
    r"\bprompt says\b",
    r"\bfollowing the instruction\b",
    r"\bfollowing my instructions\b",
    r"\bgiven the instruction\b",
    r"\binstructed that\b",
    r"\bproblem statement\b",
    r"\bcorrect answer\b",
]
# Phrases that leak an instruction inside the reasoning.
INSTRUCTION_LEAKS = [
    r"as\s+instructed",
    r"instructed\s+to",
    r"the\s+instructions?\b",
    r"my\s+instructions?\b",
    r"following\s+(?:my\s+)?instructions?",
    r"(?:I\s+was|I've\s+been|I\s+am|I'm)\s+told",
    r"(?:I\s+was|I've\s+been|I\s+am|I'm)\s+(?:asked|directed|instructed|prompted)",
    r"told\s+to\s+(?:use|select|choose|pick|calculate|prefer|ignore)",
    r"told\s+(?:that|which)\s+",
    r"per\s+the\s+instructions?",
    r"according\s+to\s+(?:my|the)\s+instructions?",
    r"(?:conversion|probability)\s+(?:key|table|mapping|chart|guide|lookup)",
    r"verbal\s+probabilit\w*",
    r"(?:given|assigned|provided|specified|supplied)\s+(?:a\s+)?(?:utility\s+function|utility)",
    r"(?:the|my)\s+(?:given|assigned|provided|specified)\s+utility",
    r"instruction\s+(?:says?|states?|indicates?|requires?|expects?|specifies?)",
]
TOKEN_LIMIT = 2000

META_REFERENCE = "(?i)" + "|".join(META_REFERENCES)
INSTRUCTION_LEAK = "(?i)" + "|".join(INSTRUCTION_LEAKS)

_OPEN, _CLOSE = "<think>", "</think>"


def count_of(cell: Column, needle: str) -> Column:
    bare = F.replace(cell, F.lit(needle), F.lit(""))
    return ((F.length(cell) - F.length(bare)) / len(needle)).cast("int")


def after_first_close(cell: Column) -> Column:
    """Text behind the first closing tag; null without one."""
    at = F.locate(_CLOSE, cell)
    return F.when(at > 0, F.substr(cell, at + len(_CLOSE)))


def has_literal_newline(cell: Column) -> Column:
    return F.contains(cell, F.lit("\\n")) | F.contains(cell, F.lit("\\r"))


def format_issues(cell: Column) -> dict[str, Column]:
    """Boolean flags of one reasoning cell; null for a null cell."""
    body = text.literal_newlines_to_real(cell)
    opens, closes = count_of(body, _OPEN), count_of(body, _CLOSE)
    trailing = text.strip_blank(after_first_close(body))
    return {
        "literal_newlines": has_literal_newline(cell),
        "missing_think_open": opens < 1,
        "missing_think_close": closes < 1,
        "multiple_think_close": closes > 1,
        "extra_text_after_think": F.coalesce(
            (trailing != "") & ~trailing.startswith('{"answer"'), F.lit(False)
        ),
        "prompt_meta_reference": body.rlike(META_REFERENCE),
    }


def has_meta_reference(cell: Column) -> Column:
    return F.coalesce(cell, F.lit("")).rlike(META_REFERENCE)


def audited_answer(cell: Column) -> Column:
    """First JSON answer of a response, normalised; null when it is no option label."""
    found = F.regexp_extract(
        F.replace(F.coalesce(cell, F.lit("")), F.lit("\\n"), F.lit("\n")),
        r'\{\s*"answer"\s*:\s*"?([^"}\s]+)"?\s*\}',
        1,
    )
    return text.normal_label(F.nullif(found, F.lit("")))


def reasoned_answer(cell: Column) -> Column:
    """JSON answer anywhere behind the first closing tag."""
    return F.nullif(F.regexp_extract(after_first_close(cell), r'\{"answer"\s*:\s*"([^"]+)"\}', 1), F.lit(""))


def validation_reasons(
    cell: Column, allowed: Column, expected: Column, output_tokens: Column, stop_reason: Column
) -> Column:
    """Reason codes that make a generated answer unusable, in a fixed order; empty is ok."""
    body = F.coalesce(cell, F.lit(""))
    opens, closes = count_of(body, _OPEN), count_of(body, _CLOSE)
    answer = reasoned_answer(body)
    thought = F.regexp_extract(body, r"(?s)<think>(.*?)</think>", 1)
    rules = [
        ("cut_off_by_max_tokens", stop_reason.isin("max_tokens", "length")),
        ("output_tokens_over_limit", output_tokens > TOKEN_LIMIT),
        ("think_block_count_not_1", opens != 1),
        ("think_close_count_not_1", closes != 1),
        ("think_order_wrong", (opens > 0) & (closes > 0) & (F.locate(_OPEN, body) > F.locate(_CLOSE, body))),
        ("no_answer_json_after_think", ~body.rlike(r'</think>\s*\{"answer"\s*:\s*"[^"]+"\}\s*$')),
        ("cannot_extract_answer", answer.isNull()),
        ("answer_not_in_allowed_labels", (F.size(allowed) > 0) & ~F.array_contains(allowed, answer)),
        ("answer_not_equal_expected_label", answer != expected),
        ("instruction_leak_in_think", thought.rlike(INSTRUCTION_LEAK)),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in rules]))


def mcq_answer(cell: Column) -> Column:
    """Last A-D answer: text behind the reasoning first, marked answers before bare letters."""
    body = text.strip_blank(cell)
    tail = F.when(F.contains(body, F.lit(_CLOSE)), text.strip_blank(F.substring_index(body, _CLOSE, -1)))
    patterns = [
        r"(?i)(?:final answer|answer)\s*[:\-]?\s*\(?([ABCD])\)?\b",
        r"(?m)^\s*\(?([ABCD])\)?\s*$",
        r"\b([ABCD])\b",
    ]
    found = [
        F.try_element_at(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), F.lit(-1))
        for source in (F.nullif(tail, F.lit("")), body)
        for pattern in patterns
    ]
    return F.coalesce(*found)


def regex_reward(cell: Column, pattern: Column) -> Column:
    """1.0 where the (case-blind) pattern of the row is found."""
    body = F.lower(text.strip_blank(cell))
    return F.regexp_like(body, F.concat(F.lit("(?i)"), pattern)).cast("double")


# --- options written in a prompt ---------------------------------------------

_AMOUNT = r"-?\$[\d,]+(?:\.\d+)?"
_NUMBER = r"(?:\d*\.\d+|\d+(?:\.\d+)?%?)"
_PHRASES = "|".join(sorted(formats.VERBAL_PHRASES.values(), key=len, reverse=True))
_OUTCOME = (
    rf"(?i)((?:{_PHRASES})|{_NUMBER}\s+(?:probability|chance)\s+of|probability\s+{_NUMBER}\s+of|{_NUMBER}\s+of)"
    rf"\s+({_AMOUNT})"
)
_BLOCK = r"(?is)following options[.:]\s*(.*?)\s*(?:You are completely free|You have complete freedom)"
_LINE = r"^[\(\[]?([A-Za-z]|\d{1,2})[\)\]]?[.:]?\s+(.*)$"


def prompt_options(prompt: Column) -> Column:
    """``array<struct<label, outcomes array<struct<p, x>>>>`` of the options block.

    One alternation, verbal phrases and numeric forms together, is matched left
    to right, so overlapping readings resolve to the earliest and longest one.
    Null when the block is missing or no line holds an outcome.
    """
    real = F.replace(prompt, F.lit("\\n"), F.lit("\n"))
    lines = F.filter(
        F.transform(F.split(F.regexp_extract(real, _BLOCK, 1), r"\r\n|[\n\r]"), lambda v: text.strip_blank(v)),
        lambda v: v.rlike(_LINE),
    )

    def outcomes(line: Column) -> Column:
        body = F.regexp_extract(line, _LINE, 2)
        leads = F.regexp_extract_all(body, F.lit(_OUTCOME), F.lit(1))
        amounts = F.regexp_extract_all(body, F.lit(_OUTCOME), F.lit(2))

        def one(lead: Column, amount: Column) -> Column:
            number = F.regexp_extract(lead, _NUMBER, 0)
            chance = F.coalesce(formats.phrase_probability(lead), formats.text_probability(number))
            value = F.regexp_replace(amount, r"[$,]", "").try_cast("double")
            return F.struct(chance.alias("p"), value.alias("x"))

        return F.zip_with(leads, amounts, one)

    found = F.filter(
        F.transform(
            lines,
            lambda v: F.struct(F.lower(F.regexp_extract(v, _LINE, 1)).alias("label"), outcomes(v).alias("outcomes")),
        ),
        lambda s: F.size(s["outcomes"]) > 0,
    )
    return _unless_empty(found)


def _unless_empty(found: Column) -> Column:
    """Null in place of an empty array, which is computed once: the optimizer may have put the writing of the text into it."""
    return let(found, lambda options: F.when(F.size(options) > 0, options))


def read_options(prompt: Column, domain: str) -> Column:
    """``array<struct<label, outcomes array<struct<p, x>>>>`` of a text rendered in a quantity's words.

    Reads by the tables that the text was written with, so every outcome comes
    back, amounts of a billion and more to three figures. Null without options.
    """
    phrases = formats.verbal_phrases(domain)
    spoken = "|".join(sorted(phrases.values(), key=len, reverse=True))
    lead = rf"(?:{spoken})|{_NUMBER}\s+(?:probability|chance)\s+of|probability\s+{_NUMBER}\s+of"
    pattern = rf"({lead})\s+({formats.outcome_pattern(domain)})"
    block = F.regexp_extract(prompt, wordings.options_block(domain), 1)
    lines = F.filter(F.split(block, "\n"), lambda v: v.rlike(_LINE))

    def outcomes(line: Column) -> Column:
        body = F.regexp_extract(line, _LINE, 2)

        def one(lead: Column, amount: Column) -> Column:
            chance = F.coalesce(
                formats.phrase_probability(lead, phrases), formats.text_probability(F.regexp_extract(lead, _NUMBER, 0))
            )
            return F.struct(chance.alias("p"), formats.outcome_value(amount, domain).alias("x"))

        return F.zip_with(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)), one)

    found = F.transform(lines, lambda v: F.struct(F.lower(F.regexp_extract(v, _LINE, 1)).alias("label"), outcomes(v).alias("outcomes")))
    return _unless_empty(found)
