"""Golden readings of free-text answers."""

import time

import pytest

from wagerframe.functions import answers

# (text, options, label style, finish reason, choice, strategy)
CASES = [
    ('Weighing it all: {"answer": "3"}', 4, None, None, "3", "json"),
    ('{"answer":"1"} no wait {"answer":"b"}', 3, None, None, "b", "json"),
    ('{"answer":"9"} \\boxed{2}', 3, None, None, "2", "boxed"),
    ("So it is \\boxed{ c }", 3, None, None, "c", "boxed"),
    ("Some thoughts here.\\n\\nMy choice: option (b)", 2, None, None, "b", "short_answer_line"),
    ("Long thoughts.\n\nSelected option: (2).", 3, None, None, "2", "short_answer_line"),
    ("3. 1.", 3, None, None, "1", "short_answer_line"),
    ("2: (a)", 2, None, None, "a", "short_answer_line"),
    ("1. 2\n2. 1", 2, None, None, "1", "short_answer_line"),
    ("Final answer: option III", 4, None, None, "3", "short_answer_line"),
    ("１", 2, None, None, "1", "short_answer_line"),
    ("1 Unlikely to give $40, Very likely to give -$12.50", 2, None, None, "1", "option_echo_line"),
    ("Thus the answer is option 2, given my aims", 3, None, None, "2", "answer_marker"),
    ("I weighed risk and gain. Answer: option (3) because of its mean", 4, None, None, "3", "answer_marker"),
    ("Looking at the tails, I would definitely pick option b because it is safe.", 3, None, None, "b", "decision_verb"),
    ("Given this, I'm going to select Option 2. My reasons follow below.", 2, None, None, "2", "decision_verb"),
    ("After some thought, we'll go with the second option.", 3, None, None, "2", "decision_verb"),
    ("On balance option (a) was the one selected, after all.", 2, None, None, "a", "decision_verb"),
    ("2. We would prefer 2 over 1", 3, None, None, "2", "decision_comparison"),
    ("Given the spread, option 2 seems to be the most attractive choice.", 3, None, None, "2", "option_is_best"),
    ("Overall option c ($1,200) looks like the better pick, I think.", 3, None, None, "c", "option_is_best"),
    ("The gap makes option 1 more appealing compared with 2.", 2, None, None, "1", "option_is_best"),
    ("Option 1 has the highest expected utility of $90, clearly.", 3, None, None, "1", "expected_value_dominance"),
    ("The expected value of option (b) is greater than that of option (a).", 2, None, None, "b", "expected_value_dominance"),
    ("By the numbers, the option with the largest EV is option a, at $12.", 2, None, None, "a", "expected_value_dominance"),
    ("Risk is fine. Therefore, the most appealing option for me, all told, would be option a with ease.", 2, None, None, "a", "best_choice_is"),
    ("The more attractive option is the third one, at $5.", 3, None, None, "3", "best_choice_is"),
    ("As computed, the highest value is $33.10, which is option (1).", 3, None, None, "1", "single_option_sentence_cue"),
    ("In short, option c brings the lowest risk.", 4, None, None, "c", "single_option_sentence_cue"),
    ("All in all, 3 is what I should pick today.", 4, "numbers", None, "3", "final_sentence_option"),
    # nothing to read
    ("Perhaps the answer is option 4.", 4, None, None, None, None),
    ("If you're careful, you'd pick option 2.", 3, None, None, None, None),
    ("If we select option 2, the loss is small.", 3, None, None, None, None),
    ("A risk-averse agent would pick option 1.", 3, None, None, None, None),
    ("So, the best option is option 1 or 3.", 3, None, None, None, None),
    ("Option 1 is better on paper. Still, if you fear losses, option 2 may be more appealing.", 2, None, None, None, None),
    ("B is nice.", 3, "letters", None, None, None),
    ("Option (a) is chosen if you are risk-averse.", 2, None, None, None, None),
    ("\\n\\n", 3, None, None, None, None),
    ("", 3, None, None, None, None),
    (None, 3, None, None, None, None),
    # cut off by length
    ("**Plan**\n\nI would pick **Option a: Likely to give 5**.\n\n**Why:** value value value", 2, None, "length", "a", "decision_verb"),
    ("Hence, **option (b) is the clear choice.** The gain gain gain", 2, None, "length", "b", "option_is_best"),
    ("Thus the best option is **Option 3: Unlikely to give 7**. gain gain", 3, None, "length", "3", "option_is_best"),
    ("Utility rules.\n\nSo the artificial agent should choose **Option 1**. gain gain", 3, None, "length", "1", "decision_verb"),
    ("Both have utility 3. So it does not matter which option I take.\n\nThus, I would pick either option.", 2, None, "length", None, None),
    ("Thus, I would pick option (a) or (c).", 3, None, "length", None, None),
    ("My reasoning is long.\nAnswer: 2", 3, None, "length", "2", "short_answer_line"),
]


def test_cascade(spark):
    rows = [(i, *case) for i, case in enumerate(CASES)]
    df = spark.createDataFrame(
        rows, "i int, response string, num_options int, style string, finish string, want string, want_by string"
    )
    got = answers.parse_choice(df, label_style="style", finish_reason="finish").orderBy("i").collect()
    bad = [
        (r.response, (r.want, r.want_by), (r.choice, r.strategy))
        for r in got
        if (r.choice, r.strategy) != (r.want, r.want_by)
    ]
    assert not bad, "\n".join(map(str, bad))


def test_explicit_only(spark):
    df = spark.createDataFrame(
        [('{"answer":"2"}', 3), ("I would pick option 2.", 3), ("x\n(b)", 2)], "response string, num_options int"
    )
    got = [r.explicit and r.explicit.choice for r in answers.explicit_choice(df).collect()]
    assert got == ["2", None, "b"]


def test_whole_text_unless_windows_say_otherwise(spark):
    text = "I would choose option 2. " + "The rest says nothing about it at all. " * 200
    df = spark.createDataFrame([(text, 3)], "response string, num_options int")
    whole = answers.parse_choice(df).first()
    tail = answers.parse_choice(df, windows=answers.PUBLISHED).first()
    assert (whole.choice, tail.choice) == ("2", None)


def test_marks_in_a_text_are_not_mentions(spark):
    rows = [("I have no answer. \x01 foo \x032\x02 bar", 3), ("I would choose option 2; if you are cautious you might \x02 take another.", 3)]
    got = answers.parse_choice(spark.createDataFrame(rows, "response string, num_options int"))
    clean = answers.parse_choice(
        spark.createDataFrame([(t.translate({1: " ", 2: " ", 3: " "}), n) for t, n in rows], "response string, num_options int")
    )
    assert [r[2:] for r in got.collect()] == [r[2:] for r in clean.collect()]
    assert got.first().choice is None


def test_long_answers_take_time_in_proportion(spark):
    said = "Thus the answer is option 2, given my aims. "
    turned = "If you fear losses, that might change."
    rows = [(said * 800 + "Goodbye", 3), (said * 800 + turned, 3), (said * 3 + "word " * 20_000, 3), (turned + " " + said, 3)]
    df = spark.createDataFrame(rows, "response string, num_options int")
    start = time.time()
    assert [r.choice for r in answers.parse_choice(df).collect()] == ["2", None, "2", "2"]
    assert time.time() - start < 60


def test_one_match_is_cut_out_like_one_of_several(spark):
    pattern = r"\boption\s+([a-z0-9]+)"
    sql = answers._mentions("body", pattern, "array('a', 'b')")
    assert answers._only_mention("body", pattern) in sql  # no marks for one match
    before, after = "Well, yes. So I say", "it is! Fine."
    rows = [(f"{before} option b, {after}",), (f"{before} option b, {after} Not option z.",), ("option z",), ("none",)]
    got = [r.m for r in spark.createDataFrame(rows, "body string").selectExpr(f"{sql} AS m").collect()]
    assert got[2:] == [None, None]
    for mentions in got[:2]:
        assert [tuple(m) for m in mentions] == [("b", " So I say ", "option b", ", it is", len(before) + len(" option b"))]


def test_label_search_takes_only_possible_labels(spark):
    rows = [("the second of optionb 17 x1 choices",)]
    found = spark.createDataFrame(rows, "body string").selectExpr(f"regexp_extract_all(body, {answers._q(answers._LABEL_RUN)}, 0) AS r")
    assert found.first().r == ["second", "optionb", "17"]


def test_line_without_number_is_read_once():
    once = answers._line_label("line", "array('a')", None, False)
    assert "bare != line" in once


def test_mentions_are_found_by_one_search():
    for pattern in [answers.PASSIVE, *answers._best_patterns("", "", True, []), answers._MADE_BEST[0]]:
        assert answers._mentions("body", pattern, "valid").count(answers._q(answers._U + pattern)) == 1


def test_long_sentences_cost_in_proportion_to_their_length(spark):
    """A sentence of half a million characters before the one that decides; its square would take hours."""
    said = " ".join(["and", "then"] * 60_000) + ". I would choose option 2 because it suits me."
    df = spark.createDataFrame([(said, 3)], "response string, num_options int")
    started = time.time()
    read = answers.parse_choice(df).first()
    assert (read.choice, read.strategy) == ("2", "decision_verb")
    assert time.time() - started < 60
