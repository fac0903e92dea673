"""Cleaning and normalising cells: flags, labels, prompts, chat text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"


def strip_blank(cell: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(cell, F.lit(BLANKS))


def strip_right(cell: Column) -> Column:
    return F.rtrim(cell, F.lit(BLANKS))


# --- flags and scalars -------------------------------------------------------

# Accepted spellings of a flag.
TRUE_WORDS = ["true", "t", "1", "yes", "y"]
FALSE_WORDS = ["false", "f", "0", "no", "n"]
OK_FALSE_WORDS = ["false", "0", "no"]


def tri_state(cell: Column) -> Column:
    word = F.lower(strip_blank(cell.cast("string")))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def ok_flag(cell: Column, blank_is_ok: bool = True) -> Column:
    """Only an explicit false fails. A blank passes in training and fails in the audit."""
    word = F.lower(strip_blank(cell.cast("string")))
    bad = word.isin(OK_FALSE_WORDS)
    if not blank_is_ok:
        bad = bad | (cell.cast("string") == "")
    return ~F.coalesce(bad, F.lit(False))


def optional_text(cell: Column) -> Column:
    return F.nullif(cell.cast("string"), F.lit(""))


def optional_int(cell: Column) -> Column:
    return cell.try_cast("long")


def blank_false(flag: Column) -> Column:
    """Export form of a flag: ``True`` or an empty cell."""
    return F.when(flag, "True").otherwise("")


def not_blank(cell: Column) -> Column:
    return cell.isNotNull() & (strip_blank(cell) != "")


def sheet_tag(text: Column, filler: str = "_") -> Column:
    """Path-safe tag; runs of other characters become one filler."""
    tag = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", filler)
    tag = F.regexp_replace(tag, rf"^[{filler}]+|[{filler}]+$", "")
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit("dataset" if filler == "_" else "custom"))


def rate_tag(rate: Column) -> Column:
    """One-digit scientific tag of a learning rate, as ``1e-05``."""
    return F.format_string("%.0e", rate)


def alpha_suffix(alpha: Column) -> Column:
    """``pos0p5`` / ``neg2``: sign word and magnitude with the point spelled ``p``."""
    size = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.abs(alpha)), r"0+$", ""), r"\.$", "")
    return F.concat(F.when(alpha < 0, "neg").otherwise("pos"), F.replace(size, F.lit("."), F.lit("p")))


# --- label lists -------------------------------------------------------------

_STRINGS = "array<string>"
_LABEL_TOKEN = r"(?<![A-Za-z0-9])(\d+|[A-Za-z])(?![A-Za-z0-9])"


def _json_list(cell: Column) -> Column:
    return F.when(strip_blank(cell).rlike(r"(?s)^\[.*\]$"), F.from_json(strip_blank(cell), _STRINGS))


def label_list(cell: Column) -> Column:
    """Label cell: JSON list, JSON scalar, comma list or a single bare label."""
    text = strip_blank(cell)
    bare = F.regexp_replace(F.regexp_replace(text, r"""^"+|"+$""", ""), r"""^'+|'+$""", "")
    parts = F.filter(F.split(bare, ","), lambda v: strip_blank(v) != "")
    parts = F.transform(parts, lambda v: F.regexp_replace(strip_blank(v), r"""^["']+|["']+$""", ""))
    return F.when(cell.isNull(), F.array().cast(_STRINGS)).otherwise(
        F.coalesce(_json_list(cell), F.when(bare == "", F.array().cast(_STRINGS)).otherwise(parts))
    )


def label_tokens(cell: Column) -> Column:
    """Distinct stand-alone numbers or letters (lower case), in first-seen order."""
    word = F.lower(strip_blank(cell))
    tokens = F.array_distinct(
        F.transform(F.regexp_extract_all(cell, F.lit(_LABEL_TOKEN), F.lit(1)), lambda t: F.lower(t))
    )
    empty = cell.isNull() | word.isin("", "nan", "none", "null", "[]")
    return F.when(empty, F.array().cast(_STRINGS)).otherwise(tokens)


def label_set(cell: Column) -> Column:
    """JSON list as given, otherwise every number or letter of the raw text."""
    listed = F.transform(
        F.filter(_json_list(cell), lambda v: v.isNotNull() & (strip_blank(v) != "")), lambda v: strip_blank(v)
    )
    loose = F.regexp_extract_all(cell, F.lit(r"(\d+|[A-Za-z])"), F.lit(1))
    return F.sort_array(F.array_distinct(F.coalesce(listed, loose, F.array().cast(_STRINGS))))


def number_list(cell: Column) -> Column:
    """Numeric list cell; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(cell, "array<double>"), F.array().cast("array<double>"))


def indexed_label(index: Column, vector: Column) -> Column:
    """Legacy layout: a signed 1-based index into a label vector."""
    position = F.abs(index.try_cast("int"))
    return F.when((position >= 1) & (position <= F.size(vector)), F.get(vector, position - 1))


def best_labels(cells: Iterable[Column]) -> Column:
    """Tokens of the first cell that yields any."""
    lists = [label_tokens(c) for c in cells]
    return F.coalesce(*[F.when(F.size(t) > 0, t) for t in lists], F.array().cast(_STRINGS))


def option_number(label: Column) -> Column:
    """1-based option number of a label such as ``b`` or ``2``."""
    word = F.lower(strip_blank(label))
    return F.when(word.rlike(r"^[0-9]+$"), word.try_cast("int")).when(
        word.rlike(r"^[a-z]$"), F.ascii(word) - 96
    )


def normal_label(label: Column) -> Column:
    """Digits or one letter, lower case; null otherwise."""
    word = F.lower(strip_blank(label))
    return F.when(word.rlike(r"^([0-9]+|[a-z])$"), word)


def option_numbers(cells: Iterable[Column]) -> Column:
    """Sorted option numbers of the first label-list cell that has any."""
    lists = [
        F.sort_array(F.array_distinct(F.array_compact(F.transform(label_list(c), option_number)))) for c in cells
    ]
    return F.coalesce(*[F.when(F.size(n) > 0, n) for n in lists], F.array().cast("array<int>"))


def label_domain(count: Column, style: Column | None = None) -> Column:
    """Valid labels of ``count`` options: letters and numbers, or one of the styles; none of no options."""
    slots = F.slice(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.lit(1), F.greatest(count, F.lit(0)))

    def first(labels: list[str], made: Column) -> Column:
        written = F.slice(F.array(*[F.lit(v) for v in labels]), F.lit(1), F.greatest(count, F.lit(0)))
        return F.when(count > len(labels), made).otherwise(written)

    letters = first([chr(97 + i) for i in range(26)], F.transform(slots, lambda i: F.char(F.lit(96) + i)))
    numbers = first([str(1 + i) for i in range(26)], F.transform(slots, lambda i: i.cast("string")))
    both = F.concat(letters, numbers)
    if style is None:
        return both
    return F.when(style == "letters", letters).when(style == "numbers", numbers).otherwise(both)


# Spelled and Roman option numbers, one to ten.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
ORDINAL = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]


def spoken_label(token: Column) -> Column:
    """Strip quoting and an ``option``/``answer`` lead; map Roman and ordinal words to numbers."""
    edge = "[ \\t\\r\\n'\"`*_\\[\\](){}<>.,;:!?]+"
    word = F.regexp_replace(F.lower(token), f"^{edge}|{edge}$", "")
    word = F.regexp_replace(F.regexp_replace(word, r"^(?:option|answer)\s*", ""), f"^{edge}|{edge}$", "")
    return F.coalesce(F.try_element_at(F.expr(SPOKEN_NUMBERS), word), word)


SPOKEN_NUMBERS = "map(%s)" % ", ".join(
    f"'{word}', '{i}'" for words in (ROMAN, ORDINAL) for i, word in enumerate(words, 1)
)


def spoken_token(token: Column) -> Column:
    """:func:`spoken_label` for a bare lower-case token of letters and digits."""
    word = F.regexp_replace(token, "^(?:option|answer)", "")
    return F.coalesce(F.try_element_at(F.expr(SPOKEN_NUMBERS), word), word)


def bucket_label(cell: Column) -> Column:
    text = strip_blank(cell)
    return F.lower(F.when(text.rlike(r'(?s)^".*"$') & (F.length(text) >= 2), text.substr(F.lit(2), F.length(text) - 2)).otherwise(text))


def is_linear_only(label: Column, linear_best: Column, low_best: Column) -> Column:
    named = F.coalesce(bucket_label(label).isin("lin_only", "linear_only"), F.lit(False))
    differ = (F.size(linear_best) > 0) & (F.size(low_best) > 0) & (F.sort_array(linear_best) != F.sort_array(low_best))
    return named | F.coalesce(differ, F.lit(False))


# --- prompt classification ---------------------------------------------------

# Marker words of a verbal probability, policy tables.
POLICY_VERBAL_MARKERS = ["likely", "almost certain", "almost no chance", "small chance"]
# Marker words of a verbal probability, pair tables.
PAIR_VERBAL_MARKERS = ["half-chance", "likely", "probable", "almost certainly", "chance of"]


def _contains_any(text: Column, markers: list[str]) -> Column:
    return F.lower(text).rlike("|".join(markers))


def policy_probability_format(flag: Column, prompt: Column) -> Column:
    """The stored flag decides; otherwise a percent sign, then the marker words."""
    known = tri_state(flag)
    return (
        F.when(known, "verbal")
        .when(~known, "numerical")
        .when(prompt.rlike(r"\d+\s*%"), "numerical")
        .when(_contains_any(prompt, POLICY_VERBAL_MARKERS), "verbal")
    )


def pair_probability_format(prompt: Column) -> Column:
    return F.when(not_blank(prompt), F.when(_contains_any(prompt, PAIR_VERBAL_MARKERS), "verbal").otherwise("numerical"))


def policy_subset(raw: Column, other_types: Column) -> Column:
    """Normalised subset name, inferred from the option types when unknown."""
    word = F.replace(F.lower(strip_blank(raw)), F.lit("-"), F.lit("_"))
    return (
        F.when(word.isin("rebels_only", "rebel_cooperate"), "rebels_only")
        .when(word.isin("steals_only", "steal_mixed", "with_steals"), "steals_only")
        .when(F.array_contains(other_types, "steal"), "steals_only")
        .otherwise("rebels_only")
    )


def pair_subset(raw: Column) -> Column:
    word = F.replace(F.lower(strip_blank(raw)), F.lit("-"), F.lit("_"))
    return (
        F.when(raw.isNull(), "unknown")
        .when(word.isin("lin", "rebel_cooperate", "rebels_only"), "rebels_only")
        .when(word.isin("too_risk", "steal_mixed", "with_steals", "steals_only"), "steals_only")
        .otherwise(word)
    )


# Fixed value: how many labels the published reading of a prompt's style looks for.
PUBLISHED_LABELS = 4


def prompt_label_style(prompt: Column, count: Column, labels: int = 26) -> Column:
    """``numbers`` or ``letters``: at least two of the first ``labels`` labels stand at line starts, and a majority."""
    text = F.lower(prompt)

    def hits(names: list[str]) -> Column:
        total = F.lit(0)
        for i, label in enumerate(names):
            # Fixed value: the forms of a label at the start of a line.
            pattern = rf"(?m)(?:^|\n)\s*(?:\(\s*{label}\s*\)\s*[.:]|{label}[).:]\s+)"
            total = total + F.when((count > i) & text.rlike(pattern), 1).otherwise(0)
        return total

    numbers = hits([str(i + 1) for i in range(labels)])
    letters = hits([chr(ord("a") + i) for i in range(min(labels, 26))])
    return F.when((numbers >= 2) & (numbers > letters), "numbers").when(
        (letters >= 2) & (letters > numbers), "letters"
    )


def allowed_label_style(cell: Column) -> Column:
    first = strip_blank(F.get(label_list(cell), F.lit(0)))
    return F.when(first.rlike(r"^\p{L}+$"), "letters").when(first.rlike(r"^\d+$"), "numbers")


# --- prompt and completion text ----------------------------------------------

# The sentences an answer instruction may take.
EVAL_INSTRUCTIONS = [
    r"(?is)\s*You can think before answering,.*?would select\.",
    r"(?is)\s*You can think.*?must finish with.*?\.",
]
TRAINING_INSTRUCTIONS = [
    r"(?is)\s*You can think before answering,.*?would select\.\s*$",
    r"(?is)\s*You can think about which you'd choose,.*?would choose\.\s*$",
    r"(?is)\s*You can think if you want,.*?chosen option\.\s*$",
    r"(?is)\s*Output the label of your chosen option only\.\s*$",
]
THINKING_SUFFIX = "You can think if you want, but you must end your answer with the letter/number of your chosen option."
LABEL_ONLY_SUFFIX = "Output the label of your chosen option only."
RATIONALE_LEAD = "Let me evaluate the options using CARA utility with alpha=0.01. "

def eval_prompt(prompt: Column, suffix: str = "") -> Column:
    text = prompt
    for pattern in EVAL_INSTRUCTIONS:
        text = F.regexp_replace(text, pattern, "")
    text = strip_blank(text)
    return strip_blank(F.concat(text, F.lit("\n\n" + suffix))) if suffix else text


def unescape(text: Column) -> Column:
    for written, real in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"')):
        text = F.replace(text, F.lit(written), F.lit(real))
    return text


def literal_newlines_to_real(text: Column) -> Column:
    for written in ("\\r\\n", "\\n", "\\r"):
        text = F.replace(text, F.lit(written), F.lit("\n"))
    return text


def escape_newlines(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for real in ("\r\n", "\r"):
        text = F.replace(text, F.lit(real), F.lit("\n"))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def training_prompt(prompt: Column, thinking: bool = True, instruct: bool = True) -> Column:
    text = strip_blank(unescape(F.coalesce(prompt, F.lit(""))))
    if not instruct:
        return text
    suffix = THINKING_SUFFIX if thinking else LABEL_ONLY_SUFFIX
    for pattern in TRAINING_INSTRUCTIONS:
        text = F.regexp_replace(text, pattern, "")
    text = strip_right(text)
    return F.when(F.contains(F.lower(text), F.lit(suffix.lower())), text).otherwise(
        F.concat(text, F.lit("\n\n" + suffix))
    )


# Symbols with an ASCII spelling (the two-character entry first).
ASCII_SPELLING = {
    "√ó": " * ", "×": " * ", "·": " * ", "∙": " * ",
    "≈": " ~ ", "≃": " ~ ",
    "−": "-", "–": "-", "—": "--",
    "→": "->", "≥": ">=", "≤": "<=",
    "‘": "'", "’": "'", "“": '"', "”": '"',
    " ": " ",
}


def to_ascii(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for symbol, spelling in ASCII_SPELLING.items():
        text = F.replace(text, F.lit(symbol), F.lit(spelling))
    text = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    return strip_blank(F.regexp_replace(text, r"[ \t]+", " "))


_WRAPPED = r"(?s)^\s*<think>\s*(.*?)\s*</think>\s*(\{.*\})\s*$"


def unwrap_thinking(text: Column) -> Column:
    """``struct(text, status)``: the answer with its outer thinking tags removed.

    ``status`` is ``plain`` (no tags), ``unwrapped`` or ``malformed``; malformed
    text is returned unchanged so the caller can refuse it.
    """
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    tagged = F.contains(unix, F.lit("<think>")) | F.contains(unix, F.lit("</think>"))
    fits = unix.rlike(_WRAPPED)
    thought = F.regexp_replace(F.regexp_extract(unix, _WRAPPED, 1), r"^\n+|\n+$", "")
    answer = strip_blank(F.regexp_extract(unix, _WRAPPED, 2))
    joined = F.when(thought != "", F.concat(thought, F.lit("\n\n"), answer)).otherwise(answer)
    clean = ~F.contains(joined, F.lit("<think>")) & ~F.contains(joined, F.lit("</think>"))
    return F.struct(
        F.when(~tagged, unix).when(fits & clean, joined).otherwise(unix).alias("text"),
        F.when(~tagged, "plain").when(fits & clean, "unwrapped").otherwise("malformed").alias("status"),
    )


def swap_verb(prompt: Column, verb: Column) -> Column:
    return F.when(verb == "select", prompt).otherwise(F.regexp_replace(prompt, F.lit(r"\bselect\b"), verb))


def assistant_completion(label: Column, labels: Column, thought: Column | None = None) -> Column:
    """Training target: cleaned reasoning (or a stock rationale) and the final answer line."""
    tied = F.array_join(F.transform(labels, lambda v: F.upper(v)), ", ")
    stock = F.when(
        F.size(labels) == 1,
        F.concat(F.lit(RATIONALE_LEAD + "After comparing expected utility, option "), label, F.lit(" is best.")),
    ).otherwise(
        F.concat(
            F.lit(RATIONALE_LEAD + "Options "),
            tied,
            F.lit(" are tied for best expected utility, so I will choose one valid best option."),
        )
    )
    if thought is not None:
        cleaned = strip_right(
            F.regexp_replace(unescape(thought), r"""\{["']?answer["']?\s*:\s*["']?[^}]+["']?\}\s*$""", "")
        )
        stock = F.when(F.coalesce(thought, F.lit("")) != "", cleaned).otherwise(stock)
    return F.concat(stock, F.lit("\n\nFINAL ANSWER: "), label)


def chat_messages(prompt: Column, answer: Column | None = None, system: Column | None = None) -> Column:
    """``array<struct<role, content>>`` without empty system turns."""
    turns = []
    if system is not None:
        turns.append(F.struct(F.lit("system").alias("role"), system.alias("content")))
    turns.append(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    if answer is not None:
        turns.append(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return F.filter(F.array(*turns), lambda m: (m["role"] != "system") | (F.coalesce(m["content"], F.lit("")) != ""))


def render_chat(messages: Column, capitalise: bool = False) -> Column:
    role = (lambda m: F.initcap(m["role"])) if capitalise else (lambda m: m["role"])
    return F.array_join(F.transform(messages, lambda m: F.concat(role(m), F.lit(": "), m["content"])), "\n")


def without_last_answer(messages: Column) -> Column:
    last = F.try_element_at(messages, F.lit(-1))
    return F.when(last["role"] == "assistant", F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)


def prompt_labels(prompt: Column) -> Column:
    """Option labels that open a line, distinct, in order."""
    pattern = r"(?m)^\s*(?:\(|\[)?([A-Za-z]|\d+)(?:\)|\]|\s*[.):])\s+"
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(pattern), F.lit(1)))


# --- system prompts ----------------------------------------------------------

# Model families that take no system prompt; transfer datasets.
NO_SYSTEM_PROMPT_FAMILIES = ["gemma-3-12b", "gemma3-12b", "llama-3"]
TRANSFER_DATASETS = [
    "gpu_hours_transfer_benchmark",
    "lives_saved_transfer_benchmark",
    "money_for_user_transfer_benchmark",
]


def system_prompt(dataset: Column, model: Column, explicit: Column, default: str, transfer: str) -> Column:
    """``struct(prompt, source)``: explicit text, then model family, then dataset family."""
    family = F.lower(strip_blank(model)).rlike("|".join(NO_SYSTEM_PROMPT_FAMILIES))
    bare = F.coalesce(family, F.lit(False))
    by_dataset = F.when(dataset.isin(TRANSFER_DATASETS), transfer).otherwise(default)
    return F.struct(
        F.when(explicit.isNotNull(), explicit).when(bare, "").otherwise(by_dataset).alias("prompt"),
        F.when(explicit.isNotNull(), "cli_system_prompt")
        .when(bare, "model_default_no_system_prompt")
        .otherwise("dataset_default_system_prompt")
        .alias("source"),
    )
