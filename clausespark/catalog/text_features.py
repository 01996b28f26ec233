"""Text features, sections, windows, excerpts, prompts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark.catalog import register
from clausespark.catalog.inputs import CONTRACTS_SQL, contracts, documents, quoted, with_contracts
from clausespark.fixed import patterns as P
from clausespark.fixed import prompts
from clausespark.functions import text as X

# In SQL, letters beyond ASCII become "_" first: its regular expressions know ASCII word edges only.
ASCII_SQL = "regexp_replace(text, '[\\x{C0}-\\x{24F}]', '_', 'g')"


def _count(pattern: str, text: str = "a", ignore_case: bool = False) -> str:
    return f"len(regexp_extract_all({text}, {quoted(('(?i)' if ignore_case else '') + pattern)}))"


def _flag(pattern: str, text: str = "a", ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {quoted(('(?i)' if ignore_case else '') + pattern)})::INT"


def _literal(phrase: str, text: str = "l") -> str:
    return f"(length({text}) - length(replace({text}, {quoted(phrase)}, ''))) // {len(phrase)}"


def _any(phrases: list[str], text: str = "l") -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in phrases) + ")"


WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
FEATURE_BASE = f"""{CONTRACTS_SQL},
base AS (SELECT doc_id, text, a, lower(a) AS l, n_words FROM (
  SELECT doc_id, text, {ASCII_SQL} AS a, len({WORDS_SQL}) AS n_words FROM contracts))"""


def _select(columns: dict[str, str]) -> str:
    listed = ",\n  ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"WITH {FEATURE_BASE}\nSELECT doc_id,\n  {listed}\nFROM base"


def _basic_sql() -> str:
    sentences = f"({_count(P.SENTENCE_SPLIT)} + 1)"
    columns = {
        "char_count": "length(text)",
        "word_count": "n_words",
        "sentence_count": sentences,
        "avg_sentence_length": f"round(n_words / greatest({sentences}, 1), 6)",
        "section_count": _count(P.NUMBERED_SECTION),
        "article_count": _count(P.ARTICLE_WORD, ignore_case=True),
        "caps_headers": _count(P.CAPS_HEADER),
    }
    for name, groups in P.KEYWORD_FLAGS.items():
        columns[name] = "(" + " AND ".join(_any(g) for g in groups) + ")::INT"
    for name, phrases in P.MODAL_COUNTS.items():
        columns[name] = " + ".join(_literal(p) for p in phrases)
    return _select(columns)


@register("text_basic_features", _basic_sql())
def text_basic_features(spark, sf_dir):
    docs = contracts(spark, sf_dir).select("doc_id", *X.basic_features(F.col("text")))
    return docs.withColumn("avg_sentence_length", F.round("avg_sentence_length", 6))


@register(
    "text_length_and_words",
    f"SELECT doc_id, length(text) AS text_length, len({WORDS_SQL}) AS word_count FROM documents",
)
def text_length_and_words(spark, sf_dir):
    text = F.col("text")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.select("doc_id", F.length(text).cast("long").alias("text_length"), X.word_count(text).alias("word_count"))


def _per_k(sql: str) -> str:
    return f"round(({sql}) / (greatest(1, length(text)) / 1000.0::DOUBLE), 6)"


def _syntax_sql() -> str:
    columns = {}
    for name, pattern in P.SYNTAX_PATTERNS.items():
        sql = _count(pattern, ignore_case=True) if name != "neg_no" else (
            _count(r"\bno\b", ignore_case=True) + " - " + _count(r"\bno\s+(?:later|less|more)", ignore_case=True)
        )
        columns[name] = _per_k(sql)
    return _select(columns)


@register("text_syntax_rates", _syntax_sql())
def text_syntax_rates(spark, sf_dir):
    rates = contracts(spark, sf_dir).select("doc_id", *X.syntax_rates(F.col("text")))
    return rates.select("doc_id", *[F.round(name, 6).alias(name) for name in P.SYNTAX_PATTERNS])


STRUCTURE_SQL = {
    "doc_len_k_chars": "round(greatest(1, length(text)) / 1000.0::DOUBLE, 6)",
    "sentence_count_per_k": _per_k(_count(P.SENTENCE_END)),
    "section_count": f"({_count(P.SECTION_HEADER)})::DOUBLE",
    "numbered_clause_count_k": _per_k(_count(P.ENUMERATOR, ignore_case=True)),
    "dollar_mentions_k": _per_k(_count(P.DOLLAR_AMOUNT, ignore_case=True)),
    "percent_mentions_k": _per_k(_count(P.PERCENT, ignore_case=True)),
}
STRUCTURE_NAMES = list(STRUCTURE_SQL)


def structure_sql() -> str:
    return _select(STRUCTURE_SQL)


@register("text_structure_rates", structure_sql())
def text_structure_rates(spark, sf_dir):
    rates = contracts(spark, sf_dir).select("doc_id", *X.structure_rates(F.col("text")))
    return rates.select("doc_id", *[F.round(c, 6).alias(c) for c in rates.columns[1:]])


def _unfair_sql() -> str:
    columns = {}
    for name, rule in P.UNFAIR_FLAGS.items():
        columns[name] = _flag(rule["regex"], "l") if "regex" in rule else _any(rule["any_of"]) + "::INT"
    signal = " + ".join(f"({columns[f]})" for f in P.LEGAL_SIGNAL_FLAGS)
    columns["word_count"] = "n_words"
    columns["char_count"] = "length(text)"
    columns["avg_word_len"] = (
        r"CASE WHEN n_words > 0 THEN round(length(regexp_replace(text, '\s+', '', 'g')) / n_words, 6) ELSE 0 END"
    )
    columns["comma_count"] = _literal(",", "text")
    columns["semicolon_count"] = _literal(";", "text")
    columns["paren_count"] = _literal("(", "text") + " + " + _literal(")", "text")
    columns["legal_signal_count"] = signal
    return _select(columns)


@register("text_unfair_terms_features", _unfair_sql())
def text_unfair_terms_features(spark, sf_dir):
    docs = contracts(spark, sf_dir).select("doc_id", *X.unfair_terms_features(F.col("text")))
    return docs.withColumn("avg_word_len", F.round("avg_word_len", 6))


def _enhanced_sql(rounded: bool = True) -> str:
    build = {
        "count": lambda v: _count(v),
        "icount": lambda v: _count(v, ignore_case=True),
        "iflag": lambda v: _flag(v, ignore_case=True),
        "lcount": lambda v: _count(v, "l"),
        "lflag": lambda v: _flag(v, "l"),
        "literal": _literal,
    }
    made = {name: build[kind](value) for name, kind, value in P.ENHANCED_FEATURES}
    made["char_count"] = "length(text)"
    made["word_count"] = "n_words"
    made["sentence_count"] = f"({_count(P.SENTENCE_SPLIT)} + 1)"
    ratios = {
        "avg_sent_len": f"n_words / greatest({made['sentence_count']}, 1)",
        "obligation_ratio": f"(({made['shall_count']}) + ({made['must_count']})) / greatest(({made['may_count']}) + 1, 1)",
        "one_sided_ratio": (
            f"({made['company_shall']}) / greatest(({made['party_shall']}) + ({made['mutual_obligations']}) + 1, 1)"
        ),
    }
    made |= {name: f"round({ratio}, 6)" if rounded else ratio for name, ratio in ratios.items()}
    return _select({name: made[name] for name in P.ENHANCED_ORDER})


@register("text_enhanced_features", _enhanced_sql())
def text_enhanced_features(spark, sf_dir):
    docs = contracts(spark, sf_dir).select("doc_id", *X.enhanced_features(F.col("text")))
    for ratio in ("avg_sent_len", "obligation_ratio", "one_sided_ratio"):
        docs = docs.withColumn(ratio, F.round(ratio, 6))
    return docs


@register(
    "text_sections",
    with_contracts(
        """SELECT doc_id, i AS section, substr(text, lo + 1, hi - lo) AS section_text FROM (
  SELECT doc_id, text, i, round_even(length(text) * i / 4, 0)::BIGINT AS lo,
         round_even(length(text) * (i + 1) / 4, 0)::BIGINT AS hi
  FROM contracts, (SELECT unnest([0, 1, 2, 3]) AS i))"""
    ),
)
def text_sections(spark, sf_dir):
    docs = contracts(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(X.sections(F.col("text"))).alias("section", "section_text"))


@register(
    "text_word_windows",
    with_contracts(
        f"""SELECT doc_id, i AS win, CASE WHEN n <= 400 THEN text
  ELSE array_to_string(list_slice(w, i * 200 + 1, i * 200 + 400), ' ') END AS window_text
FROM (SELECT doc_id, text, w, len(w) AS n,
  unnest(range(CASE WHEN len(w) <= 400 THEN 1 ELSE ceil((len(w) - 400) / 200)::BIGINT + 1 END)) AS i
  FROM (SELECT doc_id, text, {WORDS_SQL} AS w FROM contracts))"""
    ),
)
def text_word_windows(spark, sf_dir):
    docs = contracts(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(X.word_windows(F.col("text"))).alias("win", "window_text"))


@register(
    "text_word_chunks",
    with_contracts(
        f"""SELECT doc_id, i AS chunk, CASE WHEN n = 0 THEN substr(text, 1, 1000)
  ELSE array_to_string(list_slice(w, i * 400 + 1, i * 400 + 400), ' ') END AS chunk_text
FROM (SELECT doc_id, text, w, len(w) AS n, unnest(range(greatest(ceil(len(w) / 400)::BIGINT, 1))) AS i
  FROM (SELECT doc_id, text, {WORDS_SQL} AS w FROM contracts))"""
    ),
)
def text_word_chunks(spark, sf_dir):
    docs = contracts(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(X.word_chunks(F.col("text"))).alias("chunk", "chunk_text"))


def _truncated_sql(limit: int, suffix: str, source: str) -> str:
    return f"""SELECT *, CASE WHEN len(w) <= {limit} THEN text
  ELSE array_to_string(list_slice(w, 1, {limit}), ' ') || {quoted(suffix)} END AS short
FROM (SELECT *, {WORDS_SQL} AS w FROM {source})"""


@register(
    "text_truncate_words",
    f"SELECT conv_id, turn, short AS excerpt FROM ({_truncated_sql(400, prompts.SHORT_SUFFIX, 'conversations')})",
)
def text_truncate_words(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", X.truncate_words(F.col("text"), 400).alias("excerpt"))


def _snippet_sql() -> str:
    parts = []
    for clause, pattern in P.HIGHLIGHT_PATTERNS.items():
        regex = quoted("(?i)" + pattern)
        parts.append(
            f"SELECT doc_id, text, {quoted(clause)} AS clause, regexp_extract(text, {regex}) AS hit FROM contracts "
            f"WHERE regexp_matches(text, {regex})"
        )
    return with_contracts(
        r"""SELECT doc_id, clause, (CASE WHEN s > 0 THEN '… ' ELSE '' END)
  || trim(regexp_replace(substr(text, s + 1, e - s), '\s+', ' ', 'g'))
  || (CASE WHEN e < length(text) THEN ' …' ELSE '' END) AS snippet
FROM (SELECT doc_id, text, clause, greatest(0, instr(text, hit) - 1 - 180) AS s,
        least(length(text), instr(text, hit) - 1 + length(hit) + 180) AS e FROM ("""
        + "\nUNION ALL ".join(parts)
        + "))"
    )


@register("text_clause_snippets", _snippet_sql())
def text_clause_snippets(spark, sf_dir):
    text = F.col("text")
    found = [
        F.struct(F.lit(clause).alias("clause"), X.snippet(text, pattern).alias("snippet"))
        for clause, pattern in P.HIGHLIGHT_PATTERNS.items()
    ]
    rows = contracts(spark, sf_dir).select("doc_id", F.inline(F.array(*found)))
    return rows.where(F.col("snippet").isNotNull())


TERMS = ["liability", "change of control", "insurance", "shall not", "notwithstanding", "license"]
MARK = '<mark style="background-color: #fff176; padding: 1px 3px; border-radius: 3px;">'


def _highlight_sql() -> str:
    sql = "text"
    for term in TERMS[:5]:
        sql = f"regexp_replace({sql}, {quoted('(?i)' + term)}, {quoted(MARK + term + '</mark>')}, 'g')"
    return with_contracts(f"SELECT doc_id, {sql} AS marked FROM contracts")


@register("text_highlight_terms", _highlight_sql())
def text_highlight_terms(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", X.highlight(F.col("text"), TERMS).alias("marked"))


@register(
    "text_terms_present",
    with_contracts(
        "SELECT doc_id, array_to_string(list_filter(["
        + ", ".join(quoted(t) for t in TERMS)
        + "], lambda t: contains(lower(text), t)), '|') AS present FROM contracts"
    ),
)
def text_terms_present(spark, sf_dir):
    present = F.array_join(X.terms_present(F.col("text"), TERMS), "|")
    return contracts(spark, sf_dir).select("doc_id", present.alias("present"))


def _position_sql() -> str:
    parts = [
        f"SELECT doc_id, {quoted(t)} AS term, split_part(p, {quoted(f' {t} ')}, 1) AS before, n FROM padded "
        f"WHERE contains(p, {quoted(f' {t} ')})"
        for t in TERMS
    ]
    return with_contracts(
        f""", padded AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS p, len(w) AS n
  FROM (SELECT doc_id, {WORDS_SQL.replace('(text,', '(lower(text),')} AS w FROM contracts))
SELECT doc_id, term, round((length(before) - length(replace(before, ' ', ''))) / greatest(n, 1), 6) AS position
FROM ({' UNION ALL '.join(parts)})"""
    )


@register("text_first_term_position", _position_sql())
def text_first_term_position(spark, sf_dir):
    padded = F.col("padded")
    found = [
        F.struct(F.lit(t).alias("term"), F.round(X.first_position_in(padded, F.lit(t)), 6).alias("position"))
        for t in TERMS
    ]
    docs = contracts(spark, sf_dir).select("doc_id", X.padded_words(F.col("text")).alias("padded"))
    rows = docs.select("doc_id", F.inline(F.array(*found)))
    return rows.where(F.col("position").isNotNull())


@register("text_strip_accents", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def text_strip_accents(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.select("doc_id", X.strip_accents(F.col("text")).alias("folded"))


def _prompt_sql(template: str, limit: int, suffix: str = prompts.SHORT_SUFFIX) -> str:
    head, tail = template.split("{text}")
    inner = _truncated_sql(limit, suffix, "contracts")
    return with_contracts(f"SELECT doc_id, {quoted(head)} || short || {quoted(tail)} AS prompt FROM ({inner})")


@register("prompt_zero_shot", _prompt_sql(prompts.ZERO_SHOT_TEMPLATE, 400))
def prompt_zero_shot(spark, sf_dir):
    prompt = X.build_prompt(F.col("text"), prompts.ZERO_SHOT_TEMPLATE)
    return contracts(spark, sf_dir).select("doc_id", prompt.alias("prompt"))


@register("prompt_few_shot", _prompt_sql(prompts.FEW_SHOT_TEMPLATE, 400))
def prompt_few_shot(spark, sf_dir):
    prompt = X.build_prompt(F.col("text"), prompts.FEW_SHOT_TEMPLATE)
    return contracts(spark, sf_dir).select("doc_id", prompt.alias("prompt"))


LONG_FEW_SHOT = prompts.LONG_FEW_SHOT_TEMPLATE.replace("{examples}", prompts.LONG_EXAMPLES)


@register("prompt_long_zero_shot", _prompt_sql(prompts.LONG_ZERO_SHOT_TEMPLATE, prompts.LONG_WORDS, prompts.LONG_SUFFIX))
def prompt_long_zero_shot(spark, sf_dir):
    prompt = X.build_prompt(F.col("text"), prompts.LONG_ZERO_SHOT_TEMPLATE, prompts.LONG_WORDS, prompts.LONG_SUFFIX)
    return contracts(spark, sf_dir).select("doc_id", prompt.alias("prompt"))


@register("prompt_long_few_shot", _prompt_sql(LONG_FEW_SHOT, prompts.LONG_WORDS, prompts.LONG_SUFFIX))
def prompt_long_few_shot(spark, sf_dir):
    prompt = X.build_prompt(F.col("text"), LONG_FEW_SHOT, prompts.LONG_WORDS, prompts.LONG_SUFFIX)
    return contracts(spark, sf_dir).select("doc_id", prompt.alias("prompt"))


# Replies are worked out from the turns: words that open a line become an answer line.
REPLY_WORDS = [
    (" the ", "\nUncapped Liability: YES\n"), (" of ", "\nchange of control: no\n"),
    (" la ", "\nNon-Compete and Liquidated Damages: yes\n"), (" der ", "\nLiquidated Damages: NO\n"),
    (" and ", "\nnon-compete: Yes, see above\n"), (" les ", "\nChange of Control: YES\n"),
]


def replies(spark, sf_dir):
    text = F.col("text")
    for word, line in REPLY_WORDS:
        text = F.replace(text, F.lit(word), F.lit(line))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", text.alias("reply"))


def _answers_sql(first_key_only: bool) -> str:
    reply = "text"
    for word, line in REPLY_WORDS:
        reply = f"replace({reply}, {quoted(word)}, {quoted(line)})"
    columns = []
    for i, (key, _) in enumerate(prompts.ANSWER_KEYS):
        names = [f"contains(lower(x), {quoted(key.lower())})"]
        if first_key_only:
            names += [f"NOT contains(lower(x), {quoted(k.lower())})" for k, _ in prompts.ANSWER_KEYS[:i]]
        name = key.lower().replace(" ", "_").replace("-", "_")
        columns.append(
            f"coalesce(contains(upper(list_filter(lines, lambda x: {' AND '.join(names)})[-1]), 'YES'), false)::INT AS {name}"
        )
    return f"""SELECT conv_id, turn, {', '.join(columns)}
FROM (SELECT conv_id, turn, string_split(trim({reply}, E' \\n\\t'), E'\\n') AS lines FROM conversations)"""


def _answers(spark, sf_dir, first_key_only):
    answers = X.parse_answers(F.col("reply"), first_key_only)
    named = [c.alias(k.lower().replace(" ", "_").replace("-", "_")) for k, c in answers.items()]
    return replies(spark, sf_dir).select("conv_id", "turn", *named)


@register("answers_first_key", _answers_sql(True))
def answers_first_key(spark, sf_dir):
    return _answers(spark, sf_dir, True)


@register("answers_every_key", _answers_sql(False))
def answers_every_key(spark, sf_dir):
    return _answers(spark, sf_dir, False)
