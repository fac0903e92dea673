"""Queries that clean, classify and check text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wagerframe.functions import checks, text
from wagerframe.plans.option_queries import six
from wagerframe.plans.registry import query, table

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query(
    "probability_formats",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'verbal' WHEN doc_id % 3 = 1 THEN 'numerical'
      WHEN regexp_matches(text, '\\d+\\s*%') THEN 'numerical'
      WHEN regexp_matches(lower(text), 'likely|almost certain|almost no chance|small chance') THEN 'verbal' END AS policy_format,
    CASE WHEN trim(text) = '' THEN NULL WHEN regexp_matches(lower(text), 'half-chance|likely|probable|almost certainly|chance of') THEN 'verbal' ELSE 'numerical' END AS pair_format
    FROM documents""",
)
def probability_formats(spark, folder):
    flag = F.when(F.col("doc_id") % 3 == 0, "yes").when(F.col("doc_id") % 3 == 1, " False ").otherwise("maybe")
    return docs(spark, folder).select(
        "doc_id",
        text.policy_probability_format(flag, F.col("text")).alias("policy_format"),
        text.pair_probability_format(F.col("text")).alias("pair_format"),
    )


@query(
    "strip_eval_instruction",
    f"""SELECT doc_id, md5(trim(text, {_BLANKS}) || CASE WHEN trim(text, {_BLANKS}) = '' THEN '' ELSE chr(10) || chr(10) END || 'Answer with a label.') AS prompt_md5 FROM documents""",
)
def strip_eval_instruction(spark, folder):
    asked = F.concat("text", F.lit("\n You can think before answering, but say\n which option you would select."))
    return docs(spark, folder).select("doc_id", F.md5(text.eval_prompt(asked, "Answer with a label.")).alias("prompt_md5"))


@query(
    "training_prompt",
    f"""WITH u AS (SELECT doc_id, trim(replace(replace(replace(replace(text, '\\n', chr(10)), '\\t', chr(9)), '\\r', chr(13)), '\\"', '"'), {_BLANKS}) AS t FROM documents)
    SELECT doc_id, md5(t || chr(10) || chr(10) || '{text.THINKING_SUFFIX}') AS prompt_md5 FROM u""",
)
def training_prompt(spark, folder):
    asked = F.concat("text", F.lit(" Output the label of your chosen option only. "))
    return docs(spark, folder).select("doc_id", F.md5(text.training_prompt(asked)).alias("prompt_md5"))


@query(
    "newline_forms",
    """SELECT doc_id, md5(replace(text, chr(10), '\\n')) AS escaped_md5,
    md5(replace(replace(replace(replace(text, chr(10), '\\n'), '\\r\\n', chr(10)), '\\n', chr(10)), '\\r', chr(10))) AS real_md5 FROM documents""",
)
def newline_forms(spark, folder):
    escaped = text.escape_newlines(F.col("text"))
    return docs(spark, folder).select(
        "doc_id", F.md5(escaped).alias("escaped_md5"), F.md5(text.literal_newlines_to_real(escaped)).alias("real_md5")
    )


@query(
    "ascii_text",
    f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
      '√ó', ' * '), '×', ' * '), '·', ' * '), '∙', ' * '), '≈', ' ~ '), '≃', ' ~ '), '−', '-'), '–', '-'), '—', '--'), '→', '->'), '≥', '>='), '≤', '<='), '‘', ''''), '’', ''''), '“', '"'), '”', '"'), chr(160), ' '),
      '[^\\x00-\\x7F]', '', 'g'), '[ \\t]+', ' ', 'g'), {_BLANKS})) AS ascii_md5 FROM documents""",
)
def ascii_text(spark, folder):
    return docs(spark, folder).select("doc_id", F.md5(text.to_ascii(F.col("text"))).alias("ascii_md5"))


@query(
    "unwrap_thinking",
    f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'unwrapped' WHEN turn % 3 = 1 THEN 'plain' ELSE 'malformed' END AS status,
    md5(CASE WHEN turn % 3 = 0 THEN CASE WHEN trim(text, {_BLANKS}) = '' THEN '' ELSE trim(text, {_BLANKS}) || chr(10) || chr(10) END || '{{"answer":"a"}}'
      WHEN turn % 3 = 1 THEN replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))
      ELSE '<think>' || replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END) AS text_md5 FROM conversations""",
)
def unwrap_thinking(spark, folder):
    form = F.col("turn") % 3
    wrapped = (
        F.when(form == 0, F.concat(F.lit("<think>\n"), "text", F.lit('\n</think>\n{"answer":"a"}')))
        .when(form == 1, F.col("text"))
        .otherwise(F.concat(F.lit("<think>"), "text"))
    )
    out = table(spark, folder, "conversations").select("conv_id", "turn", text.unwrap_thinking(wrapped).alias("u"))
    return out.select("conv_id", "turn", "u.status", F.md5("u.text").alias("text_md5"))


@query(
    "swap_verb",
    """SELECT doc_id, md5(regexp_replace('We select ' || text || ' select, reselect', '\\bselect\\b', 'pick', 'g')) AS text_md5 FROM documents""",
)
def swap_verb(spark, folder):
    asked = F.concat(F.lit("We select "), "text", F.lit(" select, reselect"))
    return docs(spark, folder).select("doc_id", F.md5(text.swap_verb(asked, F.lit("pick"))).alias("text_md5"))


@query("optional_int", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (props->>'k')::BIGINT END AS k FROM events")
def optional_int(spark, folder):
    e = table(spark, folder, "events")
    cell = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    return e.select("event_id", text.optional_int(cell).alias("k"))


@query(
    "ok_flags",
    "SELECT doc_id, quality = 1 AS training_ok, quality = 1 AND doc_id % 5 <> 0 AS audit_ok FROM labels",
)
def ok_flags(spark, folder):
    label = table(spark, folder, "labels")
    word = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 5 == 0, "").otherwise(" Yes")).otherwise(" No ")
    return label.select(
        "doc_id", text.ok_flag(word).alias("training_ok"), text.ok_flag(word, blank_is_ok=False).alias("audit_ok")
    )


@query(
    "tri_state_flags",
    """SELECT o_orderkey AS situation_id, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN NULL ELSE true END AS flag FROM orders""",
)
def tri_state_flags(spark, folder):
    o = table(spark, folder, "orders")
    cell = F.when(F.col("o_orderstatus") == "F", " F").when(F.col("o_orderstatus") == "O", "open").otherwise("Y ")
    return o.select(F.col("o_orderkey").alias("situation_id"), text.tri_state(cell).alias("flag"))


@query(
    "chat_rendering",
    """SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' THEN 'User: Go on.' || chr(10) || 'Assistant: ' || text
      ELSE 'System: Be brief.' || chr(10) || 'User: ' || text END) AS chat_md5, CASE WHEN role = 'assistant' THEN 1 ELSE 2 END AS kept_turns FROM conversations""",
)
def chat_rendering(spark, folder):
    c = table(spark, folder, "conversations")
    answered = F.col("role") == "assistant"
    messages = F.when(answered, text.chat_messages(F.lit("Go on."), F.col("text"), F.lit(""))).otherwise(
        text.chat_messages(F.col("text"), None, F.lit("Be brief."))
    )
    rows = c.withColumn("messages", messages)
    return rows.select(
        "conv_id", "turn",
        F.md5(text.render_chat(F.col("messages"), capitalise=True)).alias("chat_md5"),
        F.size(text.without_last_answer(F.col("messages"))).alias("kept_turns"),
    )


COMPLETION_SQL = f"""rtrim(replace(replace(replace(replace(text, '\\n', chr(10)), '\\t', chr(9)), '\\r', chr(13)), '\\"', '"'), {_BLANKS})
  || chr(10) || chr(10) || 'FINAL ANSWER: b'"""


@query(
    "sft_completions",
    f"SELECT conv_id, turn, md5({COMPLETION_SQL}) AS target_md5 FROM conversations WHERE role = 'assistant' AND trim(text) <> ''",
)
def sft_completions(spark, folder):
    c = table(spark, folder, "conversations").filter((F.col("role") == "assistant") & text.not_blank(F.col("text")))
    thought = F.concat("text", F.lit('\n{"answer": "b"}\n'))
    target = text.assistant_completion(F.lit("b"), F.array(F.lit("b")), thought)
    return c.select("conv_id", "turn", F.md5(target).alias("target_md5"))


@query(
    "system_prompts",
    """SELECT conv_id, CASE WHEN role = 'system' THEN 'cli_system_prompt' WHEN conv_id % 3 = 0 THEN 'model_default_no_system_prompt' ELSE 'dataset_default_system_prompt' END AS source,
    CASE WHEN role = 'system' THEN text WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 2 = 0 THEN 'transfer' ELSE 'default' END AS prompt FROM conversations WHERE turn = 0""",
)
def system_prompts(spark, folder):
    """A conversation's own system turn goes before the defaults of model and dataset."""
    key = F.col("conv_id")
    resolved = text.system_prompt(
        F.when(key % 2 == 0, "lives_saved_transfer_benchmark").otherwise("steals_test"),
        F.when(key % 3 == 0, " org/Llama-3.1-8B").otherwise("org/Qwen3-8B"),
        F.when(F.col("role") == "system", F.col("text")),
        "default",
        "transfer",
    )
    first = table(spark, folder, "conversations").filter(F.col("turn") == 0)
    return first.select("conv_id", resolved.alias("r")).select("conv_id", "r.prompt", "r.source")


@query(
    "path_tags",
    """SELECT p_partkey, trim(regexp_replace(p_name || '/' || p_type || '!', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS dataset_tag,
    trim(regexp_replace('#' || p_brand || '#', '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS split_tag,
    CASE WHEN p_size % 2 = 0 THEN 'pos' ELSE 'neg' END || replace(CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE rtrim(printf('%.2f', p_size / 4.0), '0') END, '.', 'p') AS alpha_tag,
    (p_size + 1) || 'e-06' AS rate_tag FROM part WHERE p_size < 9
    UNION ALL SELECT p_partkey, trim(regexp_replace(p_name || '/' || p_type || '!', '[^A-Za-z0-9._-]+', '_', 'g'), '_'),
    trim(regexp_replace('#' || p_brand || '#', '[^A-Za-z0-9._-]+', '-', 'g'), '-'),
    CASE WHEN p_size % 2 = 0 THEN 'pos' ELSE 'neg' END || replace(CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE rtrim(printf('%.2f', p_size / 4.0), '0') END, '.', 'p'), NULL FROM part WHERE p_size >= 9""",
)
def path_tags(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        "p_partkey",
        text.sheet_tag(F.concat_ws("/", "p_name", F.concat("p_type", F.lit("!")))).alias("dataset_tag"),
        text.sheet_tag(F.concat(F.lit("#"), "p_brand", F.lit("#")), "-").alias("split_tag"),
        text.alpha_suffix(F.when(size % 2 == 0, size / 4.0).otherwise(-size / 4.0)).alias("alpha_tag"),
        F.when(size < 9, text.rate_tag((size + 1) * 1e-06)).alias("rate_tag"),
    )


@query(
    "label_lists",
    """WITH l AS (SELECT o_orderkey AS id, chr((97 + o_custkey % 5)::INT) AS a, (1 + o_orderkey % 5)::VARCHAR AS b FROM orders)
    SELECT id AS situation_id, CASE WHEN id % 4 = 3 THEN [a] ELSE [a, b] END AS listed,
      CASE WHEN id % 4 = 3 OR a = b THEN [a] ELSE [a, b] END AS tokens,
      list_sort(CASE WHEN id % 4 = 3 THEN [a] ELSE [a, b] END) AS label_set,
      list_sort(list_distinct(CASE WHEN id % 4 = 3 THEN [ascii(a) - 96] ELSE [ascii(a) - 96, b::INT] END)) AS numbers FROM l""",
)
def label_lists(spark, folder):
    key = F.col("o_orderkey")
    a, b = F.char((F.lit(97) + F.col("o_custkey") % 5).cast("int")), (1 + key % 5).cast("string")
    cell = (
        F.when(key % 4 == 0, F.to_json(F.array(a, b)))
        .when(key % 4 == 1, F.concat(a, F.lit(" , "), b))
        .when(key % 4 == 2, F.concat(F.lit("['"), a, F.lit("', '"), b, F.lit("']")))
        .otherwise(F.concat(F.lit('"'), a, F.lit('"')))
    )
    rows = table(spark, folder, "orders").select(key.alias("situation_id"), cell.alias("cell"))
    return rows.select(
        "situation_id",
        text.label_list(F.col("cell")).alias("listed"),
        text.label_tokens(F.col("cell")).alias("tokens"),
        text.label_set(F.col("cell")).alias("label_set"),
        text.option_numbers([F.lit(""), F.col("cell")]).alias("numbers"),
    )


@query(
    "first_label_field",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [substr(lang, 1, 1)] WHEN doc_id % 3 = 1 THEN [(n_chars % 4 + 1)::VARCHAR]
    ELSE [(['a', 'b', 'c'])[n_chars % 3 + 1]] END AS labels FROM documents""",
)
def first_label_field(spark, folder):
    """CARA labels, then cooperate labels, then the legacy signed index into a vector."""
    key, chars = F.col("doc_id") % 3, F.col("n_chars")
    cara = F.when(key == 0, F.concat(F.lit('["'), F.upper(F.substring("lang", 1, 1)), F.lit('"]'))).otherwise("nan")
    cooperate = F.when(key == 1, F.concat(F.lit("("), (chars % 4 + 1).cast("string"), F.lit(")")))
    index = F.concat(F.lit("-"), (chars % 3 + 1).cast("string"))
    legacy = text.indexed_label(index, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return docs(spark, folder).select("doc_id", text.best_labels([cara, cooperate, legacy]).alias("labels"))


@query(
    "number_lists",
    "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 4) AS total, 2 AS n FROM lineitem WHERE l_linenumber <> 3 UNION ALL SELECT l_orderkey, l_linenumber, 0.0, 0 FROM lineitem WHERE l_linenumber = 3",
)
def number_lists(spark, folder):
    li = table(spark, folder, "lineitem")
    cell = F.when(F.col("l_linenumber") == 3, "[1, oops").otherwise(
        F.concat(F.lit("["), F.col("l_quantity").cast("string"), F.lit(", "), F.col("l_tax").cast("string"), F.lit("]"))
    )
    values = text.number_list(cell)
    rows = li.select("l_orderkey", "l_linenumber", values.alias("v"))
    return rows.select(
        "l_orderkey", "l_linenumber",
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("v").alias("n"),
    )


def _style_hits(labels: str) -> str:
    found = [rf"regexp_matches(lower(prompt), '(?m)(?:^|\n)\s*(?:\(\s*{x}\s*\)\s*[.:]|{x}[).:]\s+)')" for x in labels]
    return " + ".join(f"coalesce({f}, false)::INT" for f in found)


@query(
    "prompt_label_styles",
    rf"""WITH p AS (
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Pick.' || chr(10) || '(1). ' || text || chr(10) || '(2). ' || source || chr(10) || '(3). ' || lang
            WHEN 1 THEN 'Pick.' || chr(10) || 'a) ' || text || chr(10) || 'b) ' || source || chr(10) || 'c) ' || lang ELSE text END AS prompt
        FROM documents
    ), h AS (SELECT *, {_style_hits('123')} AS numbers, {_style_hits('abc')} AS letters FROM p)
    SELECT doc_id, CASE WHEN numbers >= 2 AND numbers > letters THEN 'numbers' WHEN letters >= 2 AND letters > numbers THEN 'letters' END AS style,
        list_sort(list_distinct(regexp_extract_all(prompt, '(?m)^\s*(?:\(|\[)?([A-Za-z]|\d+)(?:\)|\]|\s*[.):])\s+', 1))) AS labels
    FROM h""",
)
def prompt_label_styles(spark, folder):
    """Label style and labels of prompts whose options are document texts, and of the bare texts."""
    form = F.col("doc_id") % 3

    def listed(first: str, second: str, third: str) -> Column:
        return F.concat(F.lit(f"Pick.\n{first} "), "text", F.lit(f"\n{second} "), "source", F.lit(f"\n{third} "), "lang")

    prompt = F.when(form == 0, listed("(1).", "(2).", "(3).")).when(form == 1, listed("a)", "b)", "c)")).otherwise(F.col("text"))
    return docs(spark, folder).select(
        "doc_id", text.prompt_label_style(prompt, F.lit(3)).alias("style"), F.sort_array(text.prompt_labels(prompt)).alias("labels")
    )


@query(
    "reasoning_format_summary",
    """WITH cell AS (SELECT doc_id, unnest(CASE WHEN doc_id % 4 = 0 THEN [text, '<think>' || lang || '</think> tail'] ELSE ['<think>' || replace(text, chr(10), '\\n') || '</think>{"answer":"a"}', '<think>x</think></think>{"answer":"b"}'] END) AS t FROM documents),
    f AS (SELECT doc_id, t, contains(t, '\\n') OR contains(t, '\\r') AS lit, replace(replace(replace(t, '\\r\\n', chr(10)), '\\n', chr(10)), '\\r', chr(10)) AS n FROM cell)
    SELECT count(*)::BIGINT AS cells_checked, count(*) FILTER (lit)::BIGINT AS literal_newlines, count(DISTINCT CASE WHEN lit THEN doc_id END)::BIGINT AS rows_literal_newlines,
      count(*) FILTER (NOT contains(n, '<think>'))::BIGINT AS missing_think_open, count(*) FILTER (NOT contains(n, '</think>'))::BIGINT AS missing_think_close,
      count(*) FILTER (len(string_split(n, '</think>')) > 2)::BIGINT AS multiple_think_close,
      count(*) FILTER (contains(n, '</think>') AND NOT starts_with(trim(substr(n, strpos(n, '</think>') + 8)), '{"answer"'))::BIGINT AS extra_text_after_think,
      count(*) FILTER (regexp_matches(n, '(?i)\\binstructions?\\b|\\bas instructed\\b|\\bthe problem states\\b|\\bprompt says\\b|\\binstructed that\\b|\\bproblem statement\\b|\\bcorrect answer\\b'))::BIGINT AS prompt_meta_reference
    FROM f""",
)
def reasoning_format_summary(spark, folder):
    plain = F.col("doc_id") % 4 == 0
    rows = docs(spark, folder).select(
        "doc_id",
        F.when(plain, F.col("text")).otherwise(
            F.concat(F.lit("<think>"), text.escape_newlines(F.col("text")), F.lit('</think>{"answer":"a"}'))
        ).alias("chosen_full"),
        F.when(plain, F.concat(F.lit("<think>"), "lang", F.lit("</think> tail")))
        .otherwise('<think>x</think></think>{"answer":"b"}')
        .alias("rejected_full"),
    )
    return summarise_reasoning(rows, ["chosen_full", "rejected_full"])


def summarise_reasoning(df, columns):
    """Cells and rows per formatting issue over several reasoning columns."""
    flags = {c: checks.format_issues(F.col(c)) for c in columns}
    names = list(next(iter(flags.values())))

    def hits(name):
        return sum((F.when(flags[c][name], 1).otherwise(0) for c in columns), F.lit(0))

    counts = [F.sum(hits(n)).cast("long").alias(n) for n in names]
    checked = F.sum(sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))).cast("long")
    rows = F.count_if(hits("literal_newlines") > 0).alias("rows_literal_newlines")
    return df.agg(checked.alias("cells_checked"), rows, *counts)


@query(
    "answer_validation",
    """SELECT conv_id, turn, list_filter([CASE WHEN turn % 4 = 1 THEN 'cut_off_by_max_tokens' END, CASE WHEN length(text) > 2000 THEN 'output_tokens_over_limit' END,
      CASE WHEN turn % 4 = 2 THEN 'think_block_count_not_1' END, CASE WHEN turn % 4 = 2 THEN 'think_close_count_not_1' END,
      CASE WHEN turn % 4 = 2 THEN 'no_answer_json_after_think' END, CASE WHEN turn % 4 = 2 THEN 'cannot_extract_answer' END,
      CASE WHEN turn % 4 = 3 THEN 'answer_not_in_allowed_labels' END, CASE WHEN turn % 4 = 3 THEN 'answer_not_equal_expected_label' END], lambda v: v IS NOT NULL) AS reasons FROM conversations""",
)
def answer_validation(spark, folder):
    form = F.col("turn") % 4
    wrapped = F.when(form == 2, F.col("text")).otherwise(
        F.concat(F.lit("<think>"), "text", F.lit('</think> {"answer":"'), F.when(form == 3, "q").otherwise("a"), F.lit('"}\n'))
    )
    reasons = checks.validation_reasons(
        wrapped, F.array(F.lit("a"), F.lit("b")), F.lit("a"), F.length("text"), F.when(form == 1, "length").otherwise("stop")
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", reasons.alias("reasons"))


@query(
    "audited_answers",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'c' END AS audited, CASE WHEN turn % 2 = 0 THEN 'C' END AS reasoned FROM conversations""",
)
def audited_answers(spark, folder):
    cell = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>"), "text", F.lit('</think>{"answer":"C"}'))).otherwise(
        F.concat("text", F.lit(' {"answer":"word"}'))
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", checks.audited_answer(cell).alias("audited"), checks.reasoned_answer(cell).alias("reasoned")
    )


@query(
    "regex_reward",
    "SELECT doc_id, CASE WHEN regexp_matches(lower(text), CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE '[0-9]{3}' END) THEN 1.0 ELSE 0.0 END AS reward FROM documents",
)
def regex_reward(spark, folder):
    pattern = F.when(F.col("doc_id") % 2 == 0, "THE").otherwise("[0-9]{3}")
    return docs(spark, folder).select("doc_id", checks.regex_reward(F.col("text"), pattern).alias("reward"))


@query(
    "pair_batches_by_length",
    "SELECT doc_id, n_chars AS batch_length, n_chars // 256 AS length_band FROM documents",
)
def pair_batches_by_length(spark, folder):
    """Rows range-partitioned by length and sorted inside partitions, for a padded scorer."""
    sized = docs(spark, folder).select(
        "doc_id", F.col("n_chars").alias("batch_length"), F.floor(F.col("n_chars") / 256).alias("length_band")
    )
    return sized.repartitionByRange("batch_length").sortWithinPartitions("batch_length")


@query(
    "literal_newline_gate",
    "SELECT 'documents' AS dataset, count(*) FILTER (contains(text, '\\n') OR contains(text, '\\r'))::BIGINT AS bad_cells FROM documents",
)
def literal_newline_gate(spark, folder):
    bad = F.count_if(checks.has_literal_newline(F.col("text")))
    return docs(spark, folder).agg(bad.alias("bad_cells")).select(F.lit("documents").alias("dataset"), "bad_cells")


@query("token_averages", "SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def token_averages(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(six(F.avg("value")).alias("mean_value"))
