"""Text features as native column expressions; every one reads the whole text.

Regular expressions run with Unicode classes and with ``.`` stopping at line feeds only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clausespark.fixed import patterns as P
from clausespark.fixed import prompts

CASE_SENSITIVE = "(?dU)"
IGNORE_CASE = "(?idU)"
SPACE = r"[\s\x1c-\x1f]"


# ---- small building blocks -------------------------------------------------------------


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value worked out once per row, also where lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def count_matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    flags = IGNORE_CASE if ignore_case else CASE_SENSITIVE
    return F.regexp_count(text, F.lit(flags + pattern)).cast("long")


def has_match(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    flags = IGNORE_CASE if ignore_case else CASE_SENSITIVE
    return text.rlike(flags + pattern).cast("int")


def count_literal(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a plain phrase."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))
    return (removed / F.lit(len(phrase))).cast("long")


def spelled(phrases: Sequence[str]) -> str:
    """A pattern of plain phrases that share their beginnings; at one place the longest phrase matches."""
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for char in phrase:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        chars = sorted(char for char in node if char)
        if not chars:
            return ""
        branches = [_quoted(char) + pattern(node[char]) for char in chars]
        if len(chars) > 4:  # halves behind a look at the letter: a place is tried against few branches
            middle = len(chars) // 2
            first = "".join(map(_quoted, chars[:middle]))
            branches = [f"(?=[{first}])(?:{'|'.join(branches[:middle])})", f"(?![{first}])(?:{'|'.join(branches[middle:])})"]
        whole = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return whole + "?" if "" in node else whole

    return pattern(tree)


def replace_words(text: Column, phrases: dict[str, str]) -> Column:
    """Each word between two spaces gives way to its phrase, all words in one pass over the text.

    Equals one ``replace`` of ``" word "`` after the other as long as no phrase holds a word of ``phrases`` that comes later
    there: such a replacement uses up both spaces, so in a row of one word every second one stays.
    """
    pattern = F.lit(f" ({spelled(list(phrases))})(?: \\1)?(?= )")
    targets = {}
    for word, phrase in phrases.items():
        targets |= {f" {word}": f" {phrase}", f" {word} {word}": f" {phrase} {word}"}
    known = F.create_map(*[F.lit(part) for pair in targets.items() for part in pair])
    between = F.split(text, pattern, -1)
    put = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.get(F.array(known[found]), 0))
    return F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def phrases_met(lowered: Column, phrases: Sequence[str]) -> Column:
    """The longest of the phrases at every place of the text where one begins, each behind a line feed.

    A short text to look phrases up in (``count_met``, ``is_met``) in place of the whole one; no phrase holds a line feed.
    """
    doubled = {form for phrase in phrases for form in _overlaps(phrase)}
    found = F.regexp_extract_all(lowered, F.lit(f"(?=({spelled(sorted({*phrases, *doubled}))}))"), F.lit(1))
    return F.concat(F.lit("\n"), F.array_join(found, "\n"))


def _overlaps(phrase: str) -> list[str]:
    """The phrase running into a second one, for every way in which they share letters."""
    return [phrase + phrase[size:] for size in range(1, len(phrase)) if phrase.endswith(phrase[:size])]


def is_met(met: Column, phrase: str) -> Column:
    return F.contains(met, F.lit("\n" + phrase))


def count_met(met: Column, lowered: Column, phrase: str) -> Column:
    """``count_literal(lowered, phrase)``, looked up in ``phrases_met``; the text itself decides where the phrase overlaps itself."""
    begin = F.lit("\n" + phrase)
    removed = F.length(met) - F.length(F.replace(met, begin, F.lit("")))
    count = (removed / F.lit(len(phrase) + 1)).cast("long")
    for form in _overlaps(phrase):
        count = F.when(is_met(met, form), count_literal(lowered, phrase)).otherwise(count)
    return count


def has_folded_letters(text: Column) -> Column:
    """Whether the text holds letters beyond A-Z that match one of a-z when case is ignored."""
    return (F.octet_length(text) > F.length(text)) & text.rlike("[\u0130\u0131\u017f\u212a]")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def words(text: Column) -> Column:
    """Whitespace-separated words; blank text gives an empty array."""
    parts = F.split(text, f"(?U){SPACE}+")
    return F.filter(parts, lambda word: word != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("long")


def sentence_count(text: Column) -> Column:
    """Pieces between runs of sentence punctuation."""
    return count_matches(text, P.SENTENCE_SPLIT) + 1


def strip_accents(text: Column) -> Column:
    """Accent folding of Latin letters, one character to one character, inside the JVM."""
    sources, targets = _latin_folding()
    return F.translate(text, sources, targets)


def _latin_folding() -> tuple[str, str]:
    sources, targets = [], []
    for code in range(0xC0, 0x250):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1:
            sources.append(char)
            targets.append(base)
    return "".join(sources), "".join(targets)


@F.pandas_udf(StringType())
def strip_accents_any_script(text: pd.Series) -> pd.Series:
    """Compatibility folding of any script; Arrow batches, for text beyond Latin letters."""
    folded = text.str.normalize("NFKD")
    return folded.map(
        lambda value: value if value is None else "".join(c for c in value if not unicodedata.combining(c))
    )


# ---- feature families ------------------------------------------------------------------


def basic_features(text: Column) -> list[Column]:
    """Length, structure, 14 keyword flags and four modal counts."""
    lowered = F.lower(text)
    columns = [
        F.length(text).cast("long").alias("char_count"),
        word_count(text).alias("word_count"),
        sentence_count(text).alias("sentence_count"),
        (word_count(text) / F.greatest(sentence_count(text), F.lit(1))).alias("avg_sentence_length"),
        count_matches(text, P.NUMBERED_SECTION).alias("section_count"),
        count_matches(text, P.ARTICLE_WORD, ignore_case=True).alias("article_count"),
        count_matches(text, P.CAPS_HEADER).alias("caps_headers"),
    ]
    for name, groups in P.KEYWORD_FLAGS.items():
        holds = F.lit(True)
        for group in groups:
            holds = holds & contains_any(lowered, group)
        columns.append(holds.cast("int").alias(name))
    for name, phrases in P.MODAL_COUNTS.items():
        total = F.lit(0).cast("long")
        for phrase in phrases:
            total = total + count_literal(lowered, phrase)
        columns.append(total.alias(name))
    return columns


def thousands_of_chars(text: Column) -> Column:
    return F.greatest(F.lit(1), F.length(text)) / F.lit(1000.0)


def syntax_rates(text: Column, patterns: dict[str, str] | None = None) -> list[Column]:
    """Matches of each pattern per 1,000 characters, case ignored."""
    per_k = thousands_of_chars(text)
    return [
        (count_matches(text, pattern, ignore_case=True) / per_k).alias(name)
        for name, pattern in (patterns or P.SYNTAX_PATTERNS).items()
    ]


def structure_rates(text: Column) -> list[Column]:
    per_k = thousands_of_chars(text)
    return [
        per_k.alias("doc_len_k_chars"),
        (count_matches(text, P.SENTENCE_END) / per_k).alias("sentence_count_per_k"),
        count_matches(text, P.SECTION_HEADER).cast("double").alias("section_count"),
        (count_matches(text, P.ENUMERATOR, True) / per_k).alias("numbered_clause_count_k"),
        (count_matches(text, P.DOLLAR_AMOUNT, True) / per_k).alias("dollar_mentions_k"),
        (count_matches(text, P.PERCENT, True) / per_k).alias("percent_mentions_k"),
    ]


def unfair_terms_flags(text: Column) -> dict[str, Column]:
    lowered = F.lower(text)
    flags = {}
    for name, rule in P.UNFAIR_FLAGS.items():
        if "regex" in rule:
            flags[name] = has_match(lowered, rule["regex"])
        else:
            flags[name] = contains_any(lowered, rule["any_of"]).cast("int")
    return flags


def unfair_terms_features(text: Column) -> list[Column]:
    """21 flags, six text statistics and the ten-flag signal sum."""
    flags = unfair_terms_flags(text)
    n_words = word_count(text)
    letters = F.length(F.regexp_replace(text, f"(?U){SPACE}+", ""))
    signal = F.lit(0)
    for name in P.LEGAL_SIGNAL_FLAGS:
        signal = signal + flags[name]
    return [column.alias(name) for name, column in flags.items()] + [
        n_words.alias("word_count"),
        F.length(text).cast("long").alias("char_count"),
        F.when(n_words > 0, letters / n_words).otherwise(F.lit(0.0)).alias("avg_word_len"),
        count_literal(text, ",").alias("comma_count"),
        count_literal(text, ";").alias("semicolon_count"),
        (count_literal(text, "(") + count_literal(text, ")")).alias("paren_count"),
        signal.alias("legal_signal_count"),
    ]


def enhanced_features(text: Column) -> list[Column]:
    """51 legal features in their fixed order."""
    lowered = F.lower(text)
    build = {
        "count": lambda value: count_matches(text, value),
        "icount": lambda value: count_matches(text, value, ignore_case=True),
        "iflag": lambda value: has_match(text, value, ignore_case=True),
        "lcount": lambda value: count_matches(lowered, value),
        "lflag": lambda value: has_match(lowered, value),
        "literal": lambda value: count_literal(lowered, value),
    }
    made = {name: build[kind](value) for name, kind, value in P.ENHANCED_FEATURES}
    made["char_count"] = F.length(text).cast("long")
    made["word_count"] = word_count(text)
    made["sentence_count"] = sentence_count(text)
    made["avg_sent_len"] = made["word_count"] / F.greatest(made["sentence_count"], F.lit(1))
    made["obligation_ratio"] = (made["shall_count"] + made["must_count"]) / F.greatest(
        made["may_count"] + 1, F.lit(1)
    )
    made["one_sided_ratio"] = made["company_shall"] / F.greatest(
        made["party_shall"] + made["mutual_obligations"] + 1, F.lit(1)
    )
    return [made[name].alias(name) for name in P.ENHANCED_ORDER]


# ---- sections, windows, excerpts -------------------------------------------------------


def sections(text: Column, n: int = 4) -> Column:
    """``n`` contiguous pieces of nearly equal length, boundaries rounded half to even."""
    size = F.length(text)

    def edge(i: int) -> Column:
        return F.bround(size * F.lit(i) / F.lit(n)).cast("int")

    return F.array(*[F.substring(text, edge(i) + 1, edge(i + 1) - edge(i)) for i in range(n)])


def word_windows(text: Column, width: int = 400, stride: int = 200) -> Column:
    """Overlapping word windows; the last one ends at the last word, a short text is one window."""

    def cut(tokens: Column) -> Column:
        steps = F.ceil((F.size(tokens) - width) / F.lit(stride)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(steps, F.lit(0))),
            lambda i: F.array_join(F.slice(tokens, i * stride + 1, F.lit(width)), " "),
        )

    return bind(words(text), lambda tokens: F.when(F.size(tokens) <= width, F.array(text)).otherwise(cut(tokens)))


def word_chunks(text: Column, width: int = 400, fallback_chars: int = 1000) -> Column:
    """Adjacent chunks of ``width`` words; text without words gives its first characters."""

    def cut(tokens: Column) -> Column:
        last = F.ceil(F.size(tokens) / F.lit(width)).cast("int") - 1
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_join(F.slice(tokens, i * width + 1, F.lit(width)), " "),
        )

    blank = F.array(F.substring(text, 1, fallback_chars))
    return bind(words(text), lambda tokens: F.when(F.size(tokens) == 0, blank).otherwise(cut(tokens)))


def truncate_words(text: Column, limit: int, suffix: str = prompts.SHORT_SUFFIX) -> Column:
    """The first ``limit`` words and a marker; a shorter text is returned unchanged."""

    def shorten(tokens: Column) -> Column:
        head = F.concat(F.array_join(F.slice(tokens, 1, limit), " "), F.lit(suffix))
        return F.when(F.size(tokens) <= limit, text).otherwise(head)

    return bind(words(text), shorten)


def snippet(text: Column, pattern: str, window: int = 180) -> Column:
    """The first match with ``window`` characters around it, or null without a match."""
    regex = F.lit(IGNORE_CASE + pattern)
    found = F.struct(
        (F.regexp_instr(text, regex) - 1).alias("begin"),
        F.length(F.regexp_substr(text, regex)).alias("length"),
    )

    def excerpt(match: Column) -> Column:
        start = F.greatest(F.lit(0), match["begin"] - window)
        end = F.least(F.length(text), match["begin"] + match["length"] + window)
        body = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), f"(?U){SPACE}+", " "))
        whole = F.concat(
            F.when(start > 0, F.lit("… ")).otherwise(F.lit("")),
            body,
            F.when(end < F.length(text), F.lit(" …")).otherwise(F.lit("")),
        )
        return F.when(match["begin"] >= 0, whole)

    return bind(found, excerpt)


def highlight(text: Column, terms: Sequence[str], limit: int = 5) -> Column:
    """Wrap every occurrence of the first ``limit`` terms in a mark, in the term's own casing."""
    opening = '<mark style="background-color: #fff176; padding: 1px 3px; border-radius: 3px;">'
    marked = text
    for term in terms[:limit]:
        replacement = (opening + term + "</mark>").replace("\\", "\\\\").replace("$", "\\$")
        marked = F.regexp_replace(marked, F.lit("(?iu)" + _quoted(term)), F.lit(replacement))
    return marked


def _quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term, flags=re.ASCII)


def terms_present(text: Column, terms: Sequence[str]) -> Column:
    """Those terms that occur in the text as substrings, case ignored, in the given order."""
    options = F.array(*[F.lit(term) for term in terms])
    return bind(F.lower(text), lambda lowered: F.filter(options, lambda term: F.contains(lowered, F.lower(term))))


def first_term_position(text: Column, term: Column) -> Column:
    """Share of the words before the first word-aligned occurrence of ``term``; null if absent."""
    return bind(padded_words(text), lambda padded: first_position_in(padded, term))


def first_position_in(padded: Column, term: Column) -> Column:
    """The same in a text's ``padded_words``, for several terms of one text."""
    at = F.instr(padded, F.concat(F.lit(" "), term, F.lit(" ")))
    before = F.substring(padded, F.lit(1), at - 1)
    n_words = _spaces(padded) - 1
    return F.when(at > 0, _spaces(before) / F.greatest(n_words, F.lit(1)))


def padded_words(text: Column) -> Column:
    """The lower-cased words, one space before, between and behind them."""
    return F.concat(F.lit(" "), F.array_join(words(F.lower(text)), " "), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


# ---- prompts and replies ---------------------------------------------------------------


def build_prompt(text: Column, template: str, limit: int = 400, suffix: str = prompts.SHORT_SUFFIX) -> Column:
    head, tail = template.split("{text}")
    return F.concat(F.lit(head), truncate_words(text, limit, suffix), F.lit(tail))


def parse_answers(reply: Column, first_key_only: bool = True) -> dict[str, Column]:
    """YES/NO per clause: the last line naming it decides, a clause never named is 0.

    With ``first_key_only`` a line counts for the first key it contains and for no other.
    """
    trimmed = F.regexp_replace(reply, rf"(?U)^{SPACE}+|{SPACE}+$", "")
    lines = F.split(trimmed, "\n")

    def names_clause(key: str, earlier: list[str]) -> Callable[[Column], Column]:
        return lambda line: F.contains(F.lower(line), F.lit(key)) & ~contains_any(F.lower(line), earlier)

    answers = {}
    for i, (key, clause) in enumerate(prompts.ANSWER_KEYS):
        earlier = [k.lower() for k, _ in prompts.ANSWER_KEYS[:i]] if first_key_only else []
        deciding = F.try_element_at(F.filter(lines, names_clause(key.lower(), earlier)), F.lit(-1))
        yes = F.contains(F.upper(deciding), F.lit("YES")).cast("int")
        answers[clause] = F.coalesce(yes, F.lit(0))
    return answers
