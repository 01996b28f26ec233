"""Inputs of the named queries, worked out from the supplied tables by Spark and by SQL alike.

The supplied prose holds no contract language, so frequent words of ``documents`` are replaced by
contract phrases. Every document is used, with its whole text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.fixed.keyword_rules import KEYWORD_RULES
from clausespark.fixed.patterns import HIGHLIGHT_PATTERNS, HIGHLIGHT_WORDS
from clausespark.functions import text as X
from clausespark.operators.splits import hash_split

# Word of the supplied prose -> contract phrase put in its place.
PHRASES = [
    ("thth", "shall not"), ("thon", "shall"), ("than", "must"), ("thhe", "may not"),
    ("thha", "not"), ("thre", "no"), ("thnt", "if"), ("thed", "except"), ("thin", "will not"),
    ("thor", "no later than"), ("thea", "within thirty days"), ("thes", "within 30 business days"),
    ("thly", "subject to"), ("thti", "notwithstanding"), ("erin", "terminate for convenience"),
    ("thble", "TERMINATION"), ("thsh", "renewal term"), ("thst", "hold harmless"),
    ("then", "indemnify against"), ("erhe", "unlimited liability"), ("eron", "liquidated damages"),
    ("thnd", "change of control"), ("thou", "Non-Compete"), ("thing", "up to 12 months"),
    ("thtion", "intellectual property"), ("erth", "assign right"), ("erre", "not assign"),
    ("anea", "insurance"), ("ered", "governed by the laws of"), ("eran", "cap on liability"),
    ("erer", "shall not exceed $5,000,000"), ("eren", "audit right"), ("thwh", "\n2. "),
    ("ernd", "hereby grants a license"), ("erat", "covenant not to sue"),
    ("eror", "sole and exclusive"), ("erly", "warranty period of 2 years"),
    ("eres", "right of first refusal"), ("erwh", "most favored nation"), ("erea", "acquisition"),
    ("ernt", "without prior written consent"), ("erha", "\nCONFIDENTIAL TERMS\n"),
    ("erst", "we may at any time modify these terms"), ("erble", "$500 per day"),
    ("anon", "by using the service you agree"), ("oned", "consequential damages"),
    ("onth", "12 month term"), ("oner", "20 % of net revenue"), ("attion", "each party shall"),
    ("ertion", "pursuant to section"), ("ersh", "you must submit to jurisdiction"),
    ("onan", "as defined herein"), ("onre", "binding arbitration (a)"), ("erou", "waiver; (ii)"),
    ("onnd", "joint ownership"), ("onin", "Article IV"), ("oning", '"Defined Term"'),
    ("ering", "company shall"), ("erti", "work made for hire"), ("onat", "solicit any customer"),
    ("ouxa", "expired"), ("der", "unless"), ("die", "provided that"), ("la", "exclusive license"),
    ("el", "aggregate liability"),
]


def contract_text(text: Column) -> Column:
    return X.replace_words(text, dict(PHRASES))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _contract_text_sql() -> str:
    sql = "text"
    for word, phrase in PHRASES:
        sql = f"replace({sql}, {quoted(f' {word} ')}, {quoted(f' {phrase} ')})"
    return sql


CONTRACTS_SQL = f"contracts AS (SELECT doc_id, lang, source, {_contract_text_sql()} AS text FROM documents)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, text) with contract phrases in the text."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return docs.withColumn("text", contract_text(F.col("text")))


# ---- labels and scores ---------------------------------------------------------------

CLAUSE_NAMES = list(HIGHLIGHT_PATTERNS)


def clause_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, clause, prob, y, split) for 18 clauses.

    ``y`` is a match of the clause's passage pattern; ``prob`` weighs the keyword hits against the
    text length, so that it agrees with ``y`` often but not always.
    """
    return score_rows(contracts(spark, sf_dir))


def score_rows(docs: DataFrame) -> DataFrame:
    """All phrases are found in one pass over the text; a pattern runs only where its words occur."""
    text, lowered, met = F.col("text"), F.col("lowered"), F.col("met")
    sought = {p for c in CLAUSE_NAMES for p in KEYWORD_RULES[c]} | {w for groups in HIGHLIGHT_WORDS.values() for g in groups for w in g}
    base = docs.select("doc_id", text, F.lower(text).alias("lowered"), F.length(text).alias("size"))
    base = base.withColumn("met", X.phrases_met(lowered, sorted(sought))).withColumn("folded", X.has_folded_letters(text))
    rows = []
    for clause in CLAUSE_NAMES:
        hits = F.lit(0).cast("long")
        for phrase in KEYWORD_RULES[clause]:
            hits = hits + X.count_met(met, lowered, phrase)
        possible = F.col("folded")
        for group in HIGHLIGHT_WORDS[clause]:
            possible = possible | reduce(and_, [X.is_met(met, word) for word in group])
        matched = X.has_match(text, HIGHLIGHT_PATTERNS[clause], ignore_case=True)
        y = F.when(possible, matched).when(text.isNotNull(), F.lit(0))
        rows.append(F.struct(F.lit(clause).alias("clause"), hits.alias("hits"), y.alias("y")))
    long = base.select("doc_id", "size", F.inline(F.array(*rows)))
    prob = F.round(F.col("hits") / (F.col("hits") + 1 + F.col("size") / F.lit(1500.0)), 4)
    return hash_split(long.select("doc_id", "clause", prob.alias("prob"), "y"))


def _scores_sql() -> str:
    parts = []
    for clause in CLAUSE_NAMES:
        hits = " + ".join(
            f"(length(lowered) - length(replace(lowered, {quoted(p)}, ''))) // {len(p)}"
            for p in KEYWORD_RULES[clause]
        )
        pattern = quoted("(?i)" + HIGHLIGHT_PATTERNS[clause])
        parts.append(
            f"SELECT doc_id, {quoted(clause)} AS clause, {hits} AS hits, size, "
            f"regexp_matches(text, {pattern})::INT AS y FROM lowered"
        )
    union = "\nUNION ALL ".join(parts)
    return f"""lowered AS (SELECT doc_id, text, lower(text) AS lowered, length(text) AS size FROM contracts),
hits AS ({union}),
scores AS (
  SELECT doc_id, clause, round(hits / (hits + 1 + size / 1500.0::DOUBLE), 4) AS prob, y,
         CASE WHEN {hash_bucket_sql()} < 20 THEN 'test' ELSE 'train' END AS split
  FROM hits)"""


def hash_bucket_sql(id_col: str = "doc_id", seed: int = 42) -> str:
    return f"(('0x' || substr(md5({id_col} || ':{seed}'), 1, 8))::UBIGINT % 100)"


SCORES_SQL = f"{CONTRACTS_SQL},\n{_scores_sql()}"


def with_scores(sql: str) -> str:
    return f"WITH {SCORES_SQL}\n{sql}"


def with_contracts(sql: str) -> str:
    return f"WITH {CONTRACTS_SQL}\n{sql}"
