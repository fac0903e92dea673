"""From a free-text answer to the chosen option, as one cascade of Catalyst expressions.

The cascade runs from explicit forms (JSON, box, short line) to prose. Each tier
lists *mentions*: a label with its sentence and its place in the text. Weak
mentions are vetoed when their sentence hedges or when later text turns the choice
into a condition. The last mention that survives decides the tier, and the first tier
that decides is the answer. Only Unicode NFKC folding of non-ASCII text leaves
the JVM, in an Arrow batch that carries just those texts.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wagerframe.functions import text
from wagerframe.functions.lottery import settle

# Vocabulary and patterns of the answer language.
SAFE_WHEN_TRUNCATED = ["json", "boxed", "short_answer_line", "bare_token"]
MARKER = (
    r"(?:final\s+answer|final|answer|my\s+answer|my\s+choice|my\s+selection|selection|choice|"
    r"chosen\s+(?:option|answer)|selected\s+(?:option|answer))"
)
INTENSIFIERS = (
    r"(?:(?:absolutely|overwhelmingly|unequivocally|unquestionably|definitely|clearly|certainly|"
    r"strongly|firmly|decisively|ultimately|simply|plainly|really)\s+)*"
)
MODAL = r"(?:would|will|should|must|ought\s+to)\s+"
FIRST_PERSON = (
    rf"\b(?:(?:i|we)(?:'d|'ll)?\s+(?:{INTENSIFIERS}{MODAL})?(?:{MODAL})?{INTENSIFIERS}"
    rf"|(?:i|we)(?:'m|\s+am|'re|\s+are)\s+(?:going\s+to\s+)?{INTENSIFIERS})"
)
VERBS = (
    r"(?:choose|select|pick|chose|selected|choosing|picking|opt\s+for|go\s+with|prefer|recommend|suggest)"
)
TOKEN = r"([a-z0-9]+)"
OPEN, CLOSE = r"[\(\[]?\s*", r"\s*[\)\]]?"
NAMED = rf"(?:option\s*)?{OPEN}(?:the\s+)?{TOKEN}\s*(?:option)?{CLOSE}"
NAMED_ONE = rf"(?:option\s*)?{OPEN}(?:the\s+)?{TOKEN}\s*(?:option|one)?{CLOSE}"
OTHER = NAMED.replace(TOKEN, r"[a-z0-9]+")
OTHER_ONE = NAMED_ONE.replace(TOKEN, r"[a-z0-9]+")
OPTION = rf"\boption\s*{OPEN}{TOKEN}{CLOSE}"
STOP = r"(?=\s*(?:$|[\n\r.,;:!)\-–—]|\b(?:because|as|since|for)\b))"
CLAUSE_STOP = r"(?=\s*(?:$|[\n\r.,;:!)]|\b(?:because|as|since|overall|therefore|thus|hence%s)\b))"
BEST = r"(?:best|better|preferred|preferable|optimal|(?:more|most)\s+(?:attractive|appealing)%s)"
DEGREE = r"(?:(?:significantly|clearly|definitely|much|far%s)\s+)?"
SEEMS = (
    r"(?:is|seems(?:\s+to\s+be)?|seems\s+like|looks(?:\s+like)?|appears(?:\s+to\s+be)?|would\s+be)\s+(?:still\s+)?"
)
HIGHER = r"(?:significantly\s+higher|much\s+higher|higher|highest|greater|greatest|largest)"
WORTH = r"(?:expected\s+value|expected\s+utility|utility|ev|value)"
CONNECTIVE = r"(?:therefore|thus|so|hence|overall|ultimately)?\s*,?\s*"
PASSIVE = rf"{OPTION}\s+(?:is|was)\s+(?:the\s+one\s+)?(?:chosen|selected|picked)\b"
JSON_ANSWER = rf"""\{{\s*["']answer["']\s*:\s*["']?\s*{TOKEN}\s*["']?\s*\}}"""
BOXED = rf"\\boxed\s*\{{\s*{TOKEN}\s*\}}"
SHORT_LINE = rf"^(?:{MARKER})?\s*[:\-]?\s*(?:is\s+)?{NAMED}\.?\z"
ECHO_LINE = rf"^{OPEN}{TOKEN}{CLOSE}[.:]?\s+(.+)\z"
ECHO_WORDS = r"\$|%|\b(?:chance|probability|likely|unlikely|certain|improbable|probable|give)\b"
REASONING_START = r"^(?:i|we|would|will|should|must|am|are|going|after|because|therefore|so|option)\b"
DECISION_CUE = r"\b(?:choose|pick|select|go\s+with|opt\s+for|prefer|recommend|suggest)\b"
SENTENCE_CUE = (
    r"\b(?:most|more)\s+(?:attractive|appealing)\b|"
    r"\b(?:highest|higher|greatest|greater|largest)\s+(?:expected\s+value|expected\s+utility|utility|ev|value|"
    r"potential\s+reward)\b|\blowest\s+risk\b|\bwould\s+(?:pick|choose|select)\b|"
    r"\bexpected\s+values?\b.{0,100}\bthe\s+highest\s+is\b"
)
ATTITUDE = r"risk-(?:averse|seeking|neutral)"
HEDGES = (
    r"\b(?:maybe|perhaps|alternatively|might|may|could)\b|\bif\s+the\s+agent\b|"
    rf"\b(?:a|an)\s+{ATTITUDE}(?:\s+or\s+{ATTITUDE})*\s+agents?\b"
)
HEDGED_BEFORE = r"\bif\s*$|\bif\s+(?:you|we)\b|\bif\s+i(?:'m|\s+am)\s+risk-|\b(?:someone|somebody)\b"
HEDGED_AFTER = r"^\s*(?:or|and)\b|^\s*,?\s*(?:but|however)\s+(?:option\s*)?[\(\[]?\s*[a-z0-9]+\b"
CONDITION_WEIGHT = rf"\b(?:might|may|could)\b|\bmore\s+(?:appealing|attractive)\b|\b{ATTITUDE}\b"
NON_ANSWER = (
    r"\b(?:either\s+option|either\s+one|no\s+option|neither\s+option|choose\s+neither|select\s+neither|"
    r"pick\s+neither|do\s+nothing|does\s+not\s+matter\s+which\s+option|it\s+does\s+not\s+matter\s+which|"
    r"indifferent\s+between|all\s+options\s+are\s+bad)\b|"
    rf"\boptions?\s*{OPEN}[a-z0-9]+{CLOSE}\s+(?:or|and)\s+(?:option\s*)?{OPEN}[a-z0-9]+{CLOSE}"
)


@dataclass(frozen=True)
class Windows:
    """How much of an answer the cascade reads; None, the default everywhere, reads all of it.

    ``tail_chars``, ``tail_lines`` and ``tail_sentences`` count from the end of the
    text, ``later_chars`` and ``later_sentences`` from a mention onwards (vetoes),
    and the two line limits say how long a line may be that is an answer by itself
    in the full and in the rescue cascade.
    """

    tail_chars: int | None = None
    later_chars: int | None = None
    tail_lines: int | None = None
    tail_sentences: int | None = None
    later_sentences: int | None = None
    short_line_chars: int | None = None
    rescue_line_chars: int | None = None


# The windows of the published evaluation.
PUBLISHED = Windows(
    tail_chars=3000,
    later_chars=500,
    tail_lines=8,
    tail_sentences=8,
    later_sentences=5,
    short_line_chars=90,
    rescue_line_chars=220,
)

_U = "(?U)"
_START, _MID, _END = "\x01", "\x03", "\x02"


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def folded(cell: Column) -> Column:
    """NFKC form; ASCII text, which it cannot change, never enters the Arrow batch."""
    return F.coalesce(_fold(F.when(cell.rlike(r"[^\x00-\x7F]"), cell)), cell)


def normalised(cell: Column) -> Column:
    """Real newlines, no reasoning tags, special tokens or emphasis marks; no trailing blank.

    The control characters that mark mentions become blanks, so a text cannot forge a mark.
    """
    body = F.translate(cell, _START + _MID + _END, "   ")
    for written, real in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        body = F.replace(body, F.lit(written), F.lit(real))
    body = F.regexp_replace(body, r"(?i)</?(?:think|thinking|reasoning|analysis)\b[^>]*>", " ")
    body = F.regexp_replace(body, r"<\|[^|]+?\|>", " ")
    return text.strip_right(F.regexp_replace(body, r"[*_`]+", ""))


# --- expressions as text -------------------------------------------------------
#
# The cascade is one large expression. It is put together as SQL text, which the
# session parses once per stage; built from Column objects it would take longer to
# plan than to run.


def _q(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rlike(cell: str, pattern: str) -> str:
    return f"rlike({cell}, {_q(_U + pattern)})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value, which is computed once; text form of ``lottery.let``."""
    return f"aggregate(cast(array() AS array<int>), {value}, (acc, none) -> acc, {name} -> {body})"


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def _first_of(*choices: str) -> str:
    return f"coalesce({', '.join(choices)})"


def _spoken(token: str) -> str:
    """Text form of ``text.spoken_token``; single characters, most labels, need no search."""
    roman = " ".join(f"WHEN '{word}' THEN '{i}'" for i, word in enumerate(text.ROMAN, 1) if len(word) == 1)
    bare = "CASE WHEN startswith(token, 'option') OR startswith(token, 'answer') THEN substr(token, 7) ELSE token END"
    word = _let(bare, "word", f"coalesce(try_element_at({text.SPOKEN_NUMBERS}, word), word)")
    return _let(token, "token", f"CASE WHEN length(token) = 1 THEN CASE token {roman} ELSE token END ELSE {word} END")


def _said(label: str, strategy: str) -> str:
    return _let(label, "said", _when("said IS NOT NULL", f"named_struct('choice', said, 'strategy', '{strategy}')"))


# --- mentions ------------------------------------------------------------------

_BREAK = r"[\n.!?]"
_TO_BREAK, _UP_TO_BREAK = r"^[^\n.!?]*", r"(?s)^.*[\n.!?]"


def _behind_break(cell: str) -> str:
    """What lies behind the last sentence break."""
    return f"regexp_replace({cell}, {_q(_UP_TO_BREAK)}, '')"


def _mentions(body: str, pattern: str, valid: str) -> str:
    """Matches of ``pattern`` with a valid label, as ``struct(label, left, hit, right, stop)``.

    ``left`` and ``right`` are the rest of the match's sentence and ``stop`` is where
    the match ends, counted in characters; no mention carries more of the text, so
    a long text costs in proportion to its length. All matches are wrapped in control
    characters by one search; a single match is cut out of the marked text, several are
    had by splitting it once.
    """
    label = _spoken(f"regexp_extract(part, {_q(f'{_MID}([^{_END}]*){_END}')}, 1)")
    plain = f"regexp_replace(part, {_q(f'{_MID}[^{_END}]*{_END}')}, '')"
    cells = (
        f"transform(split(marked, {_q(_START)}), part -> named_struct('label', {label}, "
        f"'hit', substring_index(part, {_q(_MID)}, 1), 'tail', substring_index(part, {_q(_END)}, -1), 'plain', {plain}))"
    )
    # Per part: whether it has a sentence break, what lies before its first and behind its last one, its length.
    pieces = (
        f"transform(cells, c -> named_struct('closed', rlike(c.plain, {_q(_BREAK)}), 'first', regexp_extract(c.plain, {_q(_TO_BREAK)}, 0), "
        f"'last', {_behind_break('c.plain')}, 'size', length(c.plain)))"
    )
    before = "coalesce(array_max(filter(sequence(0, size(pieces) - 1), k -> k < i AND get(pieces, k).closed)), 0)"
    after = "coalesce(array_min(filter(sequence(0, size(pieces) - 1), k -> k > i AND get(pieces, k).closed)), size(pieces) - 1)"
    left = _let(before, "b", "array_join(transform(slice(pieces, b + 1, i - b), p -> p.last), '')")
    onward = _let(after, "e", "array_join(transform(slice(pieces, i + 2, greatest(e - i, 0)), p -> p.first), '')")
    right = (
        f"CASE WHEN rlike(get(cells, i).tail, {_q(_BREAK)}) THEN regexp_extract(get(cells, i).tail, {_q(_TO_BREAK)}, 0) "
        f"ELSE concat(get(cells, i).tail, {onward}) END"
    )
    stop = "aggregate(slice(pieces, 1, i), 0, (total, p) -> total + p.size) + length(get(cells, i).hit)"
    one = f"named_struct('label', get(cells, i).label, 'left', {left}, 'hit', get(cells, i).hit, 'right', {right}, 'stop', {stop})"
    known = f"filter(sequence(1, size(cells) - 1), n -> array_contains({valid}, get(cells, n).label))"
    found = _let(known, "found", _when("size(found) > 0", _let(pieces, "pieces", f"transform(found, i -> {one})")))
    many = _let(cells, "cells", found)
    only = (
        f"array(named_struct('label', label, 'left', {_behind_break('cut.before')}, 'hit', cut.hit, "
        f"'right', regexp_extract(cut.rest, {_q(_TO_BREAK)}, 0), 'stop', length(cut.before) + length(cut.hit)))"
    )
    single = _let(_spoken("cut.token"), "label", _when(f"array_contains({valid}, label)", only))
    several = _let("cut.marked", "marked", many)
    chosen = _when("cut IS NOT NULL", f"CASE WHEN cut.single THEN {single} ELSE {several} END")
    return _needing(body, pattern, _let(_only_mention(body, pattern), "cut", chosen))


def _only_mention(body: str, pattern: str) -> str:
    """A text with its matches marked, cut at the only one of them; null without a match."""

    def up_to(cell: str, mark: str) -> str:
        return f"substring_index({cell}, {_q(mark)}, 1)"

    def behind(cell: str, mark: str) -> str:
        return f"substring_index({cell}, {_q(mark)}, -1)"

    marked = f"regexp_replace({body}, {_q(_U + pattern)}, {_q(f'{_START}$0{_MID}$1{_END}')})"
    cut = {
        "marked": "marked",
        "single": f"substring_index(marked, {_q(_START)}, 2) = marked",
        "before": up_to("marked", _START),
        "hit": behind(up_to("marked", _MID), _START),
        "token": behind(up_to("marked", _END), _MID),
        "rest": behind("marked", _END),
    }
    cells = ", ".join(f"'{name}', {cell}" for name, cell in cut.items())
    return _let(marked, "marked", _when(f"contains(marked, {_q(_START)})", f"named_struct({cells})"))


_NO_MENTIONS = "cast(array() AS array<struct<label:string,left:string,hit:string,right:string,stop:int>>)"


def _all_mentions(body: str, patterns: list[str], valid: str) -> str:
    return f"concat({', '.join(f'coalesce({_mentions(body, p, valid)}, {_NO_MENTIONS})' for p in patterns)})"


def _hedged(m: str, refuse_non_answer: bool = False) -> str:
    """The sentence of a mention hedges, or puts a condition around it.

    Offsets of the mention are those of the untrimmed sentence, applied to the
    trimmed one.
    """
    before, after = f"substr(whole, 1, length({m}.left))", f"substr(whole, length({m}.left) + length({m}.hit) + 1)"
    hedges = f"{_any_word('whole', _HEDGE_WORDS)} AND {_rlike('whole', HEDGES)}"
    led = f"{_any_word('whole', ['if', 'some'])} AND {_rlike(before, HEDGED_BEFORE)}"
    bad = [f"({hedges})", f"({led})", _rlike(after, HEDGED_AFTER)]
    if refuse_non_answer:
        bad.append(_rlike("whole", NON_ANSWER))
    return _let(_trimmed(f"concat({m}.left, {m}.hit, {m}.right)"), "whole", f"({' OR '.join(bad)})")


def _trimmed(cell: str) -> str:
    return f"btrim({cell}, {_q(text.BLANKS)})"


_IF_YOU = r"\bif\s+you\b"


def _last_start(body: str, pattern: str) -> str:
    """Where the last match of a pattern begins; -1 where there is none."""
    before = f"regexp_extract({body}, {_q(_U + rf'(?s)^(.*)(?:{pattern})')}, 1)"
    return f"CASE WHEN {_rlike(body, pattern)} THEN length({before}) ELSE -1 END"


def _readings(bodies: list[str], chars: int | None) -> str:
    """Texts, each with the place from which on nothing turns a choice into a condition any more."""
    turns = f"least({_last_start('body', _IF_YOU)}, {_last_start('body', CONDITION_WEIGHT)})"
    turn = f"CASE WHEN contains(body, 'if') THEN {turns} ELSE -1 END" if chars is None else "cast(NULL AS int)"
    return f"transform(array_distinct(array({', '.join(bodies)})), body -> named_struct('body', body, 'turn', {turn}))"


def _conditional_later(reading: str, m: str, chars: int | None) -> str:
    """Text behind a mention turns the choice into a condition."""
    if chars is None:
        return f"{reading}.turn >= {m}.stop"
    later = f"substr({reading}.body, {m}.stop + 1, {chars})"
    return _let(later, "later", f"({_rlike('later', _IF_YOU)} AND {_rlike('later', CONDITION_WEIGHT)})")


def _conditional_text(later: str) -> str:
    you = rf"\bif\s+(?:you|the\s+agent)\b"
    turned = f"contains({later}, 'if') AND {_rlike(later, you)} AND {_rlike(later, CONDITION_WEIGHT)}"
    return f"(({turned}) OR (contains({later}, 'risk-') AND {_rlike(later, rf'\bfor\s+(?:a|an)\s+{ATTITUDE}')}))"


def _last_label(body: str, patterns: list[str], valid: str, veto: str | None = None) -> str:
    """Label of the last mention; ``veto`` is a condition on a mention ``m``."""
    if veto is None and len(patterns) == 1:  # nothing around the mentions is looked at
        found = f"transform(regexp_extract_all({body}, {_q(_U + patterns[0])}, 1), token -> {_spoken('token')})"
        return _needing(body, patterns[0], f"try_element_at(filter({found}, known -> array_contains({valid}, known)), -1)")

    def last(pattern: str) -> str:
        found = _mentions(body, pattern, valid)
        if veto is not None:
            found = f"filter({found}, m -> NOT ({veto}))"
        return f"try_element_at({found}, -1).label"

    return _first_of(*[last(p) for p in reversed(patterns)])


#: Words that a label may follow without a blank.
_LEADS = r"(?:option|answer|choice|selection|final|is|be)([a-z0-9]+)"


#: Runs of letters and digits that could be a label: one letter, a number, or a word that stands for one.
_LABEL_RUN = rf"(?<![a-z0-9])(?:option|answer)?(?:[a-z]|[0-9]+|{'|'.join(text.ROMAN + text.ORDINAL)})(?![a-z0-9])"


def _speaks(body: str, compact: str, valid: str) -> str:
    """Some run of letters and digits could be a valid label; a text without one needs no cascade."""
    ways = [f"array({compact})", f"regexp_extract_all({body}, {_q(_LABEL_RUN)}, 0)", f"regexp_extract_all({body}, {_q(_LEADS)}, 1)"]
    return "(" + " OR ".join(f"exists({runs}, run -> array_contains({valid}, {_spoken('run')}))" for runs in ways) + ")"


# Words without which the patterns of a tier cannot match; looking for them is much cheaper than matching.
_DECIDE = ["choos", "chose", "select", "pick", "prefer", "recommend", "suggest"]
_PRAISE = ["best", "better", "preferred", "preferable", "optimal", "attractive", "appealing", "clear", "winner"]
_MORE = ["higher", "highest", "greater", "greatest", "largest"]
_HEDGE_WORDS = ["may", "perhaps", "alternatively", "might", "could", "if", "risk-"]


#: A text that can be a label by itself: at most sixteen characters besides blanks and quoting (``option`` or ``answer`` and ten digits).
_EDGE = r"[\s'\"`*_\[\](){}<>.,;:!?]"
_BARE = rf"^{_EDGE}*+(?:[^{_EDGE[1:]}{_EDGE}*+){{1,16}}+\z"


def _any_word(body: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({body}, '{word}')" for word in words) + ")"


def _needing(body: str, pattern: str, value: str) -> str:
    """A value had from matches of ``pattern``; null at once for a text without the words that every match has."""
    lists = _NEEDED.get(pattern, [])
    return _when(" AND ".join(_any_word(body, words) for words in lists), value) if lists else value


def _cues(body: str) -> str:
    """Which tiers a text can reach at all."""
    both = lambda a, b: f"(contains({body}, '{a}') AND contains({body}, '{b}'))"
    decides = f"({_any_word(body, _DECIDE)} OR {both('opt', 'for')} OR {both('go', 'with')})"
    cues = {
        "json": both("answer", "{"),
        "boxed": f"contains({body}, 'boxed')",
        "marker": _any_word(body, ["final", "answer", "choice", "selection", "chosen", "selected"]),
        "decides": decides,
        "praises": _any_word(body, _PRAISE),
        "compares": _any_word(body, _MORE),
        "settles": _any_word(body, ["correct", "right", "lowest"]),
    }
    return f"named_struct({', '.join(f"'{name}', {cue}" for name, cue in cues.items())})"


_CONCLUDES = "(_cues.decides OR _cues.praises OR _cues.compares OR _cues.settles)"


# --- tiers -----------------------------------------------------------------------


def _without_number(line: str) -> str:
    """A line without the number before it; one that begins with a letter or another sign behind the digits has none."""
    return f"CASE WHEN ascii({line}) BETWEEN 58 AND 127 THEN {line} ELSE regexp_replace({line}, {_q(_U + r'^\s*\d+[.:]?\s+')}, '') END"


def _line_label(line: str, valid: str, limit: int | None, refuse: bool) -> str:
    def read(candidate: str) -> str:
        fits = [f"array_contains({valid}, label)"]
        if limit is not None:
            fits.append(f"length({candidate}) <= {limit}")
        if refuse:
            fits.append(f"NOT {_rlike(candidate, NON_ANSWER)}")
        token = f"nullif(regexp_extract({candidate}, {_q(_U + SHORT_LINE)}, 1), '')"
        return _let(_spoken(token), "label", _when(" AND ".join(fits), "label"))

    # A line without a number before it would only be read a second time.
    return _first_of(read(line), _let(_without_number(line), "bare", _when(f"bare != {line}", read("bare"))))


def _lines(body: str) -> str:
    return f"split({body}, {_q(r'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]')})"


_NUMBERED = r"(?:^|\n)\s*\d|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _without_numbers(body: str) -> str:
    """Numbers before lines cut off; most texts have neither such numbers nor other line breaks than line feeds."""
    cut = f"array_join(transform({_lines(body)}, line -> {_without_number('line')}), '\\n')"
    return f"CASE WHEN {_rlike(body, _NUMBERED)} THEN {cut} ELSE {body} END"


def _filled(values: str) -> str:
    return f"filter(transform({values}, value -> {_trimmed('value')}), value -> value != '')"


def _sentences(body: str) -> str:
    return _filled(f"split({body}, {_q(_U + r'(?<=[.!?])\s+|\n+')})")


def _last(values: str, n: int | None) -> str:
    return values if n is None else _let(values, "all", f"slice(all, greatest(size(all) - {n} + 1, 1), {n})")


def _short_line(lines: str, valid: str, limit: int | None, refuse: bool = False) -> str:
    labels = f"array_compact(transform({lines}, line -> {_line_label('line', valid, limit, refuse)}))"
    return _said(f"try_element_at({labels}, -1)", "short_answer_line")


def _echo(lines: str, valid: str) -> str:
    label = _spoken(f"nullif(regexp_extract(line, {_q(_U + ECHO_LINE)}, 1), '')")
    body = _trimmed(f"regexp_extract(line, {_q(_U + ECHO_LINE)}, 2)")
    others = f"transform(regexp_extract_all(body, {_q(_U + rf'{OPEN}{TOKEN}{CLOSE}[.:]\s')}, 1), token -> {_spoken('token')})"
    fits = (
        f"length(body) >= 12 AND {_rlike('body', ECHO_WORDS)} "
        f"AND NOT {_rlike('body', REASONING_START)} AND NOT arrays_overlap({others}, {valid})"
    )
    known = _when(f"array_contains({valid}, label)", _let(body, "body", _when(fits, "label")))
    read = _let(f"get({lines}, 0)", "line", _let(label, "label", known))
    return _said(_when(f"size({lines}) = 1", read), "option_echo_line")


def _best_patterns(more_best: str, more_degree: str, comparison: bool, extra: list[str]) -> list[str]:
    best = BEST % more_best
    flexible = (DEGREE % more_degree) + r"(?:a\s+|the\s+)?" + best
    noun = r"(?:\s+(?:choice|option|pick|one))?"
    than = rf"(?:\s+than\s+{OTHER_ONE})?" if comparison else ""
    return [
        rf"{OPTION}\s+(?:\([^)\n]{{1,160}}\)\s+)?{SEEMS}{flexible}{noun}{than}",
        rf"(?:^|[\s,;:]){OPEN}{TOKEN}{CLOSE}\s+{SEEMS}{flexible}{noun}",
        *extra,
    ]


def _marker_patterns() -> list[str]:
    return [rf"{MARKER}\s*[:\-]?\s*(?:(?:is|would\s+be)\s+)?{INTENSIFIERS}{NAMED}{STOP}"]


def _verb_patterns(agent: bool) -> list[str]:
    own = rf"{FIRST_PERSON}{VERBS}\s+{NAMED}{STOP}"
    third = (
        rf"\bthe\s+artificial\s+agent\s+should\s+{INTENSIFIERS}(?:choose|select|pick|opt\s+for|go\s+with)\s+{NAMED}"
    )
    return [own, third, PASSIVE] if agent else [own, PASSIVE]


_COMPARE = [
    rf"{FIRST_PERSON}(?:choose|select|pick|opt\s+for|go\s+with|prefer)\s+{NAMED}\s+(?:to|over|rather\s+than)\s+{OTHER}"
]
_MADE_BEST = [rf"\b(?:makes?|made|making)\s+option\s*{OPEN}{TOKEN}{CLOSE}\s+(?:the\s+)?(?:more\s+attractive|more\s+appealing)"]
_THAN = rf"(?:\s+than\s+(?:that\s+of\s+)?{OTHER_ONE})?"
_HAS_HIGHEST = rf"{OPTION}\s+(?:has|had|offers?|offered)\s+(?:a\s+|an\s+|the\s+)?{HIGHER}\s+{WORTH}\b"
_OPTION_WITH_HIGHEST = rf"\bthe\s+option\s+with\s+the\s+{HIGHER}\s+{WORTH}\s+is\s+{NAMED_ONE}"
_VALUE_TIER = [
    _HAS_HIGHEST + _THAN,
    rf"\b(?:expected\s+value|expected\s+utility|utility|ev)\s+of\s+(?:option\s*)?{OPEN}{TOKEN}{CLOSE}\s+"
    rf"(?:is|was)\s+(?:a\s+|an\s+|the\s+)?{HIGHER}\b{_THAN}",
    _OPTION_WITH_HIGHEST,
    rf"\bthe\s+{HIGHER}\s+{WORTH}\s+is\s+[^.!?\n]{{0,80}}?\bfor\s+{NAMED_ONE}",
]


# What may stand before a conclusion; only mentions whose sentence is looked at need it.
_LED = rf"{CONNECTIVE}(?:the\s+)?"


def _conclusion(kinds: str) -> str:
    return (
        rf"(?:best|preferred|correct|right|optimal{kinds}|"
        rf"{DEGREE % ''}(?:more|most)\s+(?:attractive|appealing))\s+(?:option|choice|answer)"
        rf"(?:\s+for\b[^\n]{{0,120}}?)?\s*(?:is|would\s+be|seems\s+to\s+be|appears\s+to\s+be)\s*{NAMED_ONE}"
    )


_MODAL_CHOICE = (
    rf"(?:i|we)\s+(?:should|would|will|must|ought\s+to)\s+{INTENSIFIERS}"
    rf"(?:choose|select|pick|go\s+with|opt\s+for)\s+{NAMED}"
)


_NAMING = [rf"\boption\s*{OPEN}(?:the\s+)?{TOKEN}\s*(?:option|one)?{CLOSE}", rf"\bthe\s+{TOKEN}\s+(?:option|one)\b"]
_CUE_WORDS = ["attractive", "appealing", "high", "great", "largest", "lowest", "would"]


def _needed_words() -> dict[str, list[list[str]]]:
    """Words without which the patterns cannot match: one of each list stands in every match."""
    named, kinds = ["option", "choice", "answer"], ["best", "preferred", "correct", "right", "optimal", "attractive", "appealing"]
    modals, choosing = ["would", "will", "should", "must", "ought"], ["choose", "select", "pick", "go", "opt"]
    needed = {
        PASSIVE: [["option"], ["chosen", "selected", "picked"]],
        _verb_patterns(agent=True)[1]: [["artificial"], ["agent"]],
        _COMPARE[0]: [["to", "over", "rather"]],
        _MADE_BEST[0]: [["mak", "made"], ["option"], ["attractive", "appealing"]],
        _HAS_HIGHEST: [["option"], ["has", "had", "offer"]],
        _VALUE_TIER[0]: [["option"], ["has", "had", "offer"]],
        _VALUE_TIER[1]: [["value", "utility", "ev"], ["of"], ["is", "was"]],
        _OPTION_WITH_HIGHEST: [["option"], ["with"]],
        _VALUE_TIER[3]: [["value", "utility", "ev"], ["for"]],
        _NAMING[0]: [["option"]],
        _NAMING[1]: [["option", "one"]],
        _conclusion("") + CLAUSE_STOP % "|with": [named, kinds],
        _LED + _conclusion(r"|clear(?:est)?|winner"): [named, [*kinds, "clear", "winner"]],
    }
    modal = _MODAL_CHOICE
    return needed | {p: [modals, choosing] for p in (modal + CLAUSE_STOP % "", CONNECTIVE + modal)}


_NEEDED = _needed_words()


def _following(sentences: str, i: str, most: int | None) -> str:
    """The sentences behind number ``i``, at most ``most``, as one text."""
    return f"array_join(slice({sentences}, {i} + 2, {f'size({sentences})' if most is None else most}), ' ')"


def _one_named(named: str) -> str:
    """All mentions have the same label and none of them hedges."""
    return f"size(array_distinct(transform({named}, m -> m.label))) = 1 AND forall({named}, m -> NOT {_hedged('m')})"


def _sentence_tier(sentences: str, valid: str, following: int | None) -> str:
    named = _all_mentions("sentence", _NAMING, valid)
    cued = f"{_any_word('sentence', _CUE_WORDS)} AND {_rlike('sentence', SENTENCE_CUE)}"
    single = _when(cued, _let(named, "named", _when(_one_named("named"), "get(named, 0).label")))
    read = _first_of(
        _said(_last_label("sentence", [_conclusion("") + CLAUSE_STOP % "|with"], valid), "best_choice_is"),
        _said(_last_label("sentence", [_MODAL_CHOICE + CLAUSE_STOP % ""], valid), "decision_modal"),
        _said(single, "single_option_sentence_cue"),
    )
    later = _let(_following(sentences, "at", following), "later", _conditional_text("later"))
    decided = _let(read, "read", _when(f"read IS NOT NULL AND NOT {later}", "read"))
    return f"try_element_at(array_compact(transform({sentences}, (sentence, at) -> {decided})), -1)"


def _final_sentence(sentences: str, styled: str, style: str) -> str:
    choice = rf"\b(?:or|and)\s+(?:option\s*)?{OPEN}{TOKEN}{CLOSE}(?=\s*(?:$|[\n\r.,;:!)]))"
    others = f"transform(regexp_extract_all(sentence, {_q(_U + choice)}, 1), token -> {_spoken('token')})"
    numbers = f"array_distinct(filter(regexp_extract_all(sentence, {_q(_U + r'(?<![\w.])([0-9]+)(?![\w.%])')}, 1), v -> array_contains({styled}, v)))"
    label = (
        f"CASE WHEN {_one_named('named')} THEN get(named, 0).label "
        f"WHEN {style} = 'numbers' AND size({numbers}) = 1 THEN get({numbers}, 0) END"
    )
    read = _let(_all_mentions("sentence", [OPTION + r"\b"], styled), "named", label)
    decides = f"{_rlike('sentence', DECISION_CUE)} AND NOT arrays_overlap({others}, {styled})"
    return _said(_let(f"try_element_at({sentences}, -1)", "sentence", _when(decides, read)), "final_sentence_option")


def parse_choice(
    df: DataFrame,
    response: str = "response",
    num_options: str = "num_options",
    label_style: str | None = None,
    finish_reason: str | None = None,
    choice: str = "choice",
    strategy: str = "strategy",
    windows: Windows = Windows(),
) -> DataFrame:
    """Add the chosen label and the strategy that found it (both null when none did).

    The whole text is read unless ``windows`` says otherwise; ``PUBLISHED`` gives
    the readings of the published evaluation.

    With ``finish_reason`` given, answers cut off by length keep only explicit
    readings of the full cascade and otherwise go through the stricter rescue one.
    """
    kept = [c for c in df.columns if c not in (choice, strategy)]
    style = F.col(label_style) if label_style else F.lit(None).cast("string")
    out = df.select(
        *kept,
        F.lower(normalised(folded(F.col(response)))).alias("_text"),
        text.label_domain(F.col(num_options)).alias("_valid"),
        text.label_domain(F.col(num_options), style).alias("_styled"),
        style.alias("_style"),
    ).withColumn("_compact", F.when(F.col("_text").rlike(_U + _BARE), text.spoken_label(F.regexp_replace("_text", _U + r"\s+", ""))))
    for stage in _stages(windows):
        out = out.selectExpr("*", *[f"{sql} AS {name}" for name, sql in stage.items()])
    found = "_found"
    if finish_reason:
        quoted = ", ".join(_q(name) for name in SAFE_WHEN_TRUNCATED)
        cut = F.coalesce(F.col(finish_reason) == "length", F.lit(False)) & F.expr(f"_speaks AND NOT coalesce(_found.strategy IN ({quoted}), false)")
        out = out.withColumn("_cut", F.coalesce(cut, F.lit(False)))
        for stage in _rescue_stages(windows):
            out = out.selectExpr("*", *[f"{sql} AS {name}" for name, sql in stage.items()])
        found = "_saved"
    out = settle(out.select(*kept, found), found)
    return out.select(*kept, F.col(f"{found}.choice").alias(choice), F.col(f"{found}.strategy").alias(strategy))


def _weak(patterns: list[str], strategy: str, windows: Windows, of: str = "_readings", rescue: bool = False) -> str:
    veto = f"{_hedged('m', rescue)} OR {_conditional_later('reading', 'm', windows.later_chars)}"
    labels = f"array_compact(transform({of}, reading -> {_last_label('reading.body', patterns, '_valid', veto)}))"
    return _said(f"get({labels}, 0)", strategy)


def _explicit(cue: str = "_cues") -> str:
    return _first_of(
        _when(f"{cue}.json", _said(_last_label("_text", [JSON_ANSWER], "_valid"), "json")),
        _when(f"{cue}.boxed", _said(_last_label("_text", [BOXED], "_valid"), "boxed")),
    )


def _stages(windows: Windows) -> list[dict[str, str]]:
    """Named intermediate columns of the full cascade, step by step."""
    chars, n = windows.tail_chars, windows.tail_sentences
    last_part = "_text" if chars is None else f"substr(_text, greatest(length(_text) - {chars} + 1, 1))"
    full = _first_of(
        "_explicit",
        _short_line(_last("_lines", windows.tail_lines), "_valid", windows.short_line_chars),
        _echo("_lines", "_valid"),
        _when("_cues.marker", _weak(_marker_patterns(), "answer_marker", windows)),
        _when("_cues.decides", _weak(_verb_patterns(agent=False), "decision_verb", windows)),
        _when("_cues.decides", _weak(_COMPARE, "decision_comparison", windows)),
        _when("_cues.praises", _weak(_best_patterns("", "", True, []), "option_is_best", windows)),
        _when("_cues.praises", _weak(_MADE_BEST, "option_is_best", windows)),
        _when("_cues.compares", _weak(_VALUE_TIER, "expected_value_dominance", windows)),
        _when(_CONCLUDES, _sentence_tier("_sents", "_valid", n)),
        _when(f"{_CONCLUDES} AND _bare_tail != _tail", _sentence_tier("_bare_sents", "_valid", n)),
        _said(_when("array_contains(_valid, _compact)", "_compact"), "bare_token"),
        _when("_cues.decides", _final_sentence("_sents", "_styled", "_style")),
    )
    return [
        {"_speaks": f"coalesce({_speaks('_text', '_compact', '_valid')}, false)"},
        {"_cues": _when("_speaks", _cues("_text"))},
        {"_explicit": _when("_speaks", _explicit())},
        {"_tail": _when("_speaks AND _explicit IS NULL", last_part)},
        {"_bare_tail": _without_numbers("_tail"), "_lines": _filled(_lines("_tail")), "_sents": _when(_CONCLUDES, _last(_sentences("_tail"), n))},
        {"_readings": _readings(["_tail", "_bare_tail"], windows.later_chars), "_bare_sents": _when(f"{_CONCLUDES} AND _bare_tail != _tail", _last(_sentences("_bare_tail"), n))},
        {"_found": _when("_speaks", full)},
    ]


def _rescue_stages(windows: Windows) -> list[dict[str, str]]:
    """The cascade for answers cut off by length: explicit commitments anywhere in the text."""
    strong_degree = "|overwhelmingly"
    extra_best = r"|clear(?:er)?\s+choice|winner"
    ranked = (
        rf"\b(?:the\s+)?{DEGREE % strong_degree}{BEST % extra_best}\s+(?:option|choice)"
        rf"(?:\s+is|\s+would\s+be|\s+seems\s+to\s+be)?\s+{NAMED_ONE}"
    )

    def tier(patterns: list[str], name: str) -> str:
        return _weak(patterns, name, windows, "_rescued", True)

    veto = _hedged("m", True)
    read = _first_of(
        _said(_last_label("sentence", [_LED + _conclusion(r"|clear(?:est)?|winner")], "_valid", veto), "best_choice_is"),
        _said(_last_label("sentence", [CONNECTIVE + _MODAL_CHOICE], "_valid", veto), "decision_modal"),
    )
    later = _let(_following("_whole_sents", "at", windows.later_sentences), "later", _conditional_text("later"))
    decided = _let(read, "read", _when(f"read IS NOT NULL AND NOT {_rlike('sentence', NON_ANSWER)} AND NOT {later}", "read"))
    rescued = _first_of(
        _short_line(_filled(_lines("_whole")), "_valid", windows.rescue_line_chars, refuse=True),
        _when("_cues.marker", tier(_marker_patterns(), "answer_marker")),
        _when("_cues.decides", tier(_verb_patterns(agent=True), "decision_verb")),
        _when("_cues.praises", tier(_best_patterns(extra_best, strong_degree, False, [ranked]), "option_is_best")),
        _when("_cues.compares", tier([_HAS_HIGHEST, _OPTION_WITH_HIGHEST], "expected_value_dominance")),
        _when(_CONCLUDES, f"try_element_at(array_compact(transform(_whole_sents, (sentence, at) -> {decided})), -1)"),
    )
    return [
        {"_whole": _when("_cut", "_text")},
        {"_bare": _without_numbers("_whole"), "_whole_sents": _sentences("_whole")},
        {"_rescued": _readings(["_whole", "_bare"], windows.later_chars)},
        {"_saved": f"CASE WHEN _cut THEN {rescued} ELSE _found END"},
    ]


def explicit_choice(
    df: DataFrame, response: str = "response", num_options: str = "num_options", out: str = "explicit", windows: Windows = Windows()
) -> DataFrame:
    """Add ``struct<choice, strategy>`` by JSON, box and short-line readings only, for callers that accept nothing weaker."""
    kept = [c for c in df.columns if c != out]
    read = df.select(*kept, F.lower(normalised(F.col(response))).alias("_text"), text.label_domain(F.col(num_options)).alias("_valid"))
    read = read.selectExpr("*", f"{_cues('_text')} AS _cues", f"{_filled(_lines('_text'))} AS _lines")
    line = _short_line(_last("_lines", windows.tail_lines), "_valid", windows.short_line_chars)
    return read.selectExpr(*[f"`{c}`" for c in kept], f"{_first_of(_explicit(), line)} AS `{out}`")
