"""Nested question-answer corpora: one entry per contract to contract and label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausespark.fixed.taxonomy import QUESTION_KEYS

ANSWER = T.StructType([T.StructField("text", T.StringType())])
QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("is_impossible", T.BooleanType()),
        T.StructField("answers", T.ArrayType(ANSWER)),
    ]
)
PARAGRAPH = T.StructType(
    [T.StructField("context", T.StringType()), T.StructField("qas", T.ArrayType(QUESTION))]
)
ENTRY = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("paragraphs", T.ArrayType(PARAGRAPH))]
)
CORPUS = T.StructType(
    [T.StructField("version", T.StringType()), T.StructField("data", T.ArrayType(ENTRY))]
)


def read_entries(spark: SparkSession, path: str, one_entry_per_line: bool = False) -> DataFrame:
    """(title, paragraphs) rows.

    A corpus kept as one JSON document is read by one task; large corpora should be kept with one
    entry per line, which splits.
    """
    if one_entry_per_line:
        return spark.read.schema(ENTRY).json(path)
    corpus = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    return corpus.select(F.inline("data"))


def parse_entries(df: DataFrame, json: str) -> DataFrame:
    """The same rows from a column of JSON entries.

    The entry is unpacked by a generator, so that filters put on its parts later do not parse the
    text a second time.
    """
    return df.select(F.inline(F.array(F.from_json(json, ENTRY))))


def question_clause(question: Column) -> Column:
    """The clause of the first key, in order, that occurs in the question; null without one."""
    asked = F.trim(F.lower(question))
    return F.coalesce(*[F.when(F.contains(asked, F.lit(key)), F.lit(clause)) for key, clause in QUESTION_KEYS])


def id_clause(question_id: Column) -> Column:
    """The second part of an id with exactly two parts."""
    parts = F.split(question_id, "__")
    return F.when(F.size(parts) == 2, F.get(parts, 1))


def has_answer(answers: Column) -> Column:
    """Any answer with text other than blanks."""
    filled = F.exists(answers, lambda a: F.length(F.trim(F.regexp_replace(a["text"], r"(?U)\s+", " "))) > 0)
    return F.coalesce(filled, F.lit(False))


def contracts(entries: DataFrame, join_paragraphs: bool = False) -> DataFrame:
    """One row per contract; its text is the first paragraph, or all of them joined by a space."""
    if join_paragraphs:
        text = F.array_join(F.transform("paragraphs", lambda p: p["context"]), " ")
    else:
        text = F.get("paragraphs", 0)["context"]
    return entries.select(
        F.col("title").alias("contract_title"), text.alias("text"), F.length(text).alias("text_length")
    )


def labels(entries: DataFrame) -> DataFrame:
    """(contract_title, clause, y): 1 when any paragraph has an answer to the clause's question."""
    questions = entries.select("title", F.explode("paragraphs.qas").alias("qas")).select("title", F.inline("qas"))
    found = F.struct(
        question_clause(F.col("question")).alias("clause"), has_answer(F.col("answers")).cast("int").alias("y")
    )
    # Unpacked by a generator as well: the null filter then reads the clause instead of finding it again.
    mapped = questions.select(F.col("title").alias("contract_title"), F.inline(F.array(found)))
    mapped = mapped.where(F.col("clause").isNotNull())
    return mapped.groupBy("contract_title", "clause").agg(F.max("y").alias("y"))


def labels_from_ids(entries: DataFrame) -> DataFrame:
    """Labels named by the question id of the first paragraph; impossible questions are absent.

    When an id occurs twice the later question decides.
    """
    first = entries.select("title", F.posexplode(F.get("paragraphs", 0)["qas"]).alias("pos", "qa"))
    mapped = first.select(
        F.col("title").alias("contract_title"),
        id_clause(F.col("qa.id")).alias("clause"),
        (~F.coalesce(F.col("qa.is_impossible"), F.lit(False)) & has_answer(F.col("qa.answers"))).cast("int").alias("y"),
        "pos",
    ).where(F.col("clause").isNotNull())
    return mapped.groupBy("contract_title", "clause").agg(F.max_by("y", "pos").alias("y"))


def flat_contracts(rows: DataFrame, order: str) -> DataFrame:
    """Contracts of flat (title, context, question, answers) rows: the first context seen."""
    first = rows.groupBy("title").agg(F.min_by("context", order).alias("text"))
    return first.select(F.col("title").alias("contract_title"), "text", F.length("text").alias("text_length"))


def flat_labels(rows: DataFrame, order: str) -> DataFrame:
    """Labels of flat rows, ``answers`` an array of strings; the last row per clause decides."""
    filled = F.exists("answers", lambda a: F.length(F.trim(F.regexp_replace(a, r"(?U)\s+", " "))) > 0)
    mapped = rows.select(
        F.col("title").alias("contract_title"),
        question_clause(F.col("question")).alias("clause"),
        F.coalesce(filled, F.lit(False)).cast("int").alias("y"),
        F.col(order).alias("_order"),
    ).where(F.col("clause").isNotNull())
    return mapped.groupBy("contract_title", "clause").agg(F.max_by("y", "_order").alias("y"))
