"""Sources: nested and flat question-answer rows, wide and long labels, written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausespark.catalog import register
from clausespark.catalog.inputs import (
    CLAUSE_NAMES,
    clause_scores,
    contracts,
    documents,
    quoted,
    with_contracts,
    with_scores,
)
from clausespark.fixed.taxonomy import RISK_VERSIONS, UNFAIR_TERM_LABELS
from clausespark.operators import splits
from clausespark.session import shared_folder
from clausespark.sources import qa_json, tables

# Question asked about each line of a contract -> phrase that answers it.
QUESTIONS = [
    ('Highlight the parts related to "Governing Law"', "Governing Law", "governed by"),
    ('Highlight the parts related to "Exclusivity"', "Exclusivity", "exclusive"),
    ('Does a CHANGE OF CONTROL matter?', "Change Of Control", "change of control"),
    ('Which parties must keep insurance?', "Insurance", "insurance"),
    ('Is there a unicorn clause?', "Unicorn", "shall"),
    ('Highlight the parts related to "Non-Compete"', "Non-Compete", "non-compete"),
]


def entries(spark, sf_dir):
    """Each contract as one JSON entry: its lines are the paragraphs, six questions on each."""
    title = F.concat(F.when(F.col("doc_id") % 10 == 0, "doc__").otherwise("doc-"), F.col("doc_id").cast("string"))

    def paragraph(line):
        questions = []
        for question, name, phrase in QUESTIONS:
            hit = F.contains(F.lower(line), F.lit(phrase))
            answers = F.when(hit, F.array(F.struct(F.lit(phrase).alias("text")))).otherwise(
                F.array(F.struct(F.lit(" ").alias("text")))
            )
            questions.append(
                F.struct(
                    F.concat(title, F.lit("__" + name)).alias("id"),
                    F.lit(question).alias("question"),
                    (~hit).alias("is_impossible"),
                    answers.alias("answers"),
                )
            )
        return F.struct(line.alias("context"), F.array(*questions).alias("qas"))

    lines = contracts(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    nested = F.struct(title.alias("title"), F.transform("lines", paragraph).alias("paragraphs"))
    return qa_json.parse_entries(lines.select(F.to_json(nested).alias("entry")), "entry")


TITLE = "(CASE WHEN doc_id % 10 = 0 THEN 'doc__' ELSE 'doc-' END || doc_id)"


@register(
    "qa_contracts",
    with_contracts(
        f"""SELECT contract_title, text, length(text) AS text_length
FROM (SELECT {TITLE} AS contract_title, split_part(text, E'\\n', 1) AS text FROM contracts)"""
    ),
)
def qa_contracts(spark, sf_dir):
    return qa_json.contracts(entries(spark, sf_dir))


@register(
    "qa_contracts_joined",
    with_contracts(
        f"""SELECT contract_title, text, length(text) AS text_length
FROM (SELECT {TITLE} AS contract_title, replace(text, E'\\n', ' ') AS text FROM contracts)"""
    ),
)
def qa_contracts_joined(spark, sf_dir):
    return qa_json.contracts(entries(spark, sf_dir), join_paragraphs=True)


def _qa_labels_sql(names: dict[str, str], text: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {TITLE} AS contract_title, {quoted(clause)} AS clause, contains(lower({text}), {quoted(phrase)})::INT AS y "
        f"FROM contracts"
        for clause, phrase in names.items()
    )


BY_QUESTION = {
    "Governing Law": "governed by", "Exclusivity": "exclusive", "Change Of Control": "change of control",
    "Parties": "insurance", "Non-Compete": "non-compete",
}
BY_ID = {name: phrase for _, name, phrase in QUESTIONS}


@register("qa_labels_by_question", with_contracts(_qa_labels_sql(BY_QUESTION, "text")))
def qa_labels_by_question(spark, sf_dir):
    return qa_json.labels(entries(spark, sf_dir))


@register(
    "qa_labels_by_id",
    with_contracts(
        f"SELECT * FROM ({_qa_labels_sql(BY_ID, 'split_part(text, chr(10), 1)')}) WHERE NOT contains(contract_title, '__')"
    ),
)
def qa_labels_by_id(spark, sf_dir):
    return qa_json.labels_from_ids(entries(spark, sf_dir))


@register(
    "qa_labels_wide",
    with_contracts(
        f"""SELECT contract_title, {', '.join(f'max(y) FILTER (clause = {quoted(c)}) AS "{c}"' for c in BY_QUESTION)},
  0 AS "Insurance" FROM ({_qa_labels_sql(BY_QUESTION, 'text')}) GROUP BY contract_title"""
    ),
)
def qa_labels_wide(spark, sf_dir):
    labels = qa_json.labels(entries(spark, sf_dir))
    return tables.long_to_wide(labels, "contract_title", [*BY_QUESTION, "Insurance"])


# Words of the turns that become question keys, in both engines.
KEY_WORDS = [(" the ", " Governing Law "), (" of ", " Audit Rights "), (" la ", " Insurance "), (" und ", " Exclusivity ")]


def flat_rows(spark, sf_dir):
    text = F.col("text")
    for word, key in KEY_WORDS:
        text = F.replace(text, F.lit(word), F.lit(key))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answer = F.when(F.col("role") == "assistant", F.col("text")).otherwise("  ")
    return turns.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("title"),
        F.col("text").alias("context"),
        text.alias("question"),
        F.array(F.lit(" "), answer).alias("answers"),
        "turn",
    )


def _flat_sql() -> str:
    question = "text"
    for word, key in KEY_WORDS:
        question = f"replace({question}, {quoted(word)}, {quoted(key)})"
    first = " ".join(
        f"WHEN contains(q, {quoted(key)}) THEN {quoted(clause)}" for key, clause in qa_json.QUESTION_KEYS
    )
    return f"""SELECT contract_title, clause, arg_max(y, turn) AS y FROM (
  SELECT 'conv-' || conv_id AS contract_title, turn, CASE {first} END AS clause,
    (role = 'assistant' AND trim(text) <> '')::INT AS y
  FROM (SELECT *, lower({question}) AS q FROM conversations)) WHERE clause IS NOT NULL GROUP BY 1, 2"""


@register("qa_flat_labels", _flat_sql())
def qa_flat_labels(spark, sf_dir):
    return qa_json.flat_labels(flat_rows(spark, sf_dir), "turn")


@register(
    "qa_flat_contracts",
    """SELECT 'conv-' || conv_id AS contract_title, arg_min(text, turn) AS text,
  length(arg_min(text, turn)) AS text_length FROM conversations GROUP BY conv_id""",
)
def qa_flat_contracts(spark, sf_dir):
    return qa_json.flat_contracts(flat_rows(spark, sf_dir), "turn")


MARKERS = ["la ", "de ", "the ", "and ", "der ", "und ", "of ", "que "]
IDS_SQL = "list_filter([0, 1, 2, 3, 4, 5, 6, 7], lambda i: contains(lower(text), [" + ", ".join(
    quoted(" " + m) for m in MARKERS
) + "][i + 1]))"


@register(
    "labels_binarized",
    "SELECT doc_id, "
    + ", ".join(f'list_contains(ids, {i})::INT AS "{name}"' for i, name in enumerate(UNFAIR_TERM_LABELS))
    + f", (len(ids) > 0)::INT AS has_any, len(ids)::INT AS n_labels FROM (SELECT doc_id, {IDS_SQL} AS ids FROM documents)",
)
def labels_binarized(spark, sf_dir):
    lowered = F.lower(F.col("text"))
    hits = F.array(*[F.when(F.contains(lowered, F.lit(" " + m)), F.lit(i)) for i, m in enumerate(MARKERS)])
    docs = documents(spark, sf_dir).select("doc_id", F.array_compact(hits).alias("ids"))
    return docs.select("doc_id", *tables.binarize(F.col("ids"), UNFAIR_TERM_LABELS))


@register(
    "labels_wide_to_long",
    "SELECT doc_id, 'quality' AS clause, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels",
)
def labels_wide_to_long(spark, sf_dir):
    wide = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return tables.wide_to_long(wide, "doc_id", tables.label_columns(wide, ["doc_id"]))


@register("splits_union", "SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def splits_union(spark, sf_dir):
    docs = splits.hash_split(documents(spark, sf_dir).select("doc_id", "lang", "n_chars"))
    whole = tables.union_splits(docs.where("split = 'train'"), docs.where("split = 'test'"))
    return whole.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@register(
    "binary_target_rows",
    """SELECT text, length(text) AS text_length, lang, source, coalesce(toxic, 0) AS y
FROM documents JOIN labels USING (doc_id)""",
)
def binary_target_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir).select(
        "doc_id", F.col("doc_id").alias("contract_title"), "text", F.length("text").alias("text_length"), "lang", "source"
    )
    return tables.binary_target(docs.join(labels, "doc_id").drop("doc_id"), "toxic", ["quality", "toxic"])


# ---- written tables --------------------------------------------------------------------


def _folder(spark, name):
    """A new folder under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/written/{name}-{uuid.uuid4().hex}"


@register(
    "written_contracts",
    with_contracts("SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM contracts GROUP BY lang"),
)
def written_contracts(spark, sf_dir):
    path = _folder(spark, "contracts")
    tables.write_contracts(contracts(spark, sf_dir), path, partition_by=["lang"])
    back = tables.read_contracts(spark, path, ["lang", "text"])
    return back.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@register(
    "text_files_read",
    """SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5, contains(t, chr(65533)) AS was_broken
FROM (SELECT doc_id, text || CASE WHEN contains(text, 'la') THEN chr(65533) ELSE '' END || chr(10) AS t FROM documents)""",
)
def text_files_read(spark, sf_dir):
    """Documents written as text files, some with a byte that is no UTF-8, and read back with the replacing decoder."""
    path = _folder(spark, "texts")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    broken = F.when(F.contains("text", F.lit("la")), F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    tables.write_text_contracts(docs.select("doc_id", F.concat(F.col("text").cast("binary"), broken).alias("content")), path)
    back = tables.read_text_contracts(spark, path, name="*.txt")
    doc_id = F.regexp_extract("path", "doc_id=(-?[0-9]+)", 1).cast("long")
    return back.select(
        doc_id.alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.contains("text", F.lit("\ufffd")).alias("was_broken"),
    )


@register(
    "written_thresholds",
    with_scores("SELECT clause, round(avg(y), 6) AS thr FROM scores WHERE split = 'train' GROUP BY clause"),
)
def written_thresholds(spark, sf_dir):
    path = _folder(spark, "thresholds")
    train = clause_scores(spark, sf_dir).where("split = 'train'")
    tables.write_records(train.groupBy("clause").agg(F.round(F.avg("y"), 6).alias("thr")), path)
    return spark.read.schema("clause string, thr double").json(path)


HIGH = [c for c in RISK_VERSIONS["review_screen"]["HIGH"] if c in CLAUSE_NAMES]


def _predictions_sql() -> str:
    columns = []
    for system, value in (("true", "y"), ("rule", "(prob >= 0.2)::INT")):
        columns += [f'max({value}) FILTER (clause = {quoted(c)}) AS "{system}_{c}"' for c in HIGH]
    return with_scores(
        f"""SELECT 'doc-' || doc_id AS contract_title, {', '.join(columns)}
FROM scores WHERE split = 'test' GROUP BY doc_id"""
    )


@register("written_predictions", _predictions_sql())
def written_predictions(spark, sf_dir):
    path = _folder(spark, "predictions")
    test = clause_scores(spark, sf_dir).where("split = 'test'").where(F.col("clause").isin(HIGH))
    long = test.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("contract_title"),
        "clause",
        F.inline(
            F.array(
                F.struct(F.lit("true").alias("system"), F.col("y").alias("label")),
                F.struct(F.lit("rule").alias("system"), (F.col("prob") >= 0.2).cast("int").alias("label")),
            )
        ),
    )
    tables.write_predictions(long, path, HIGH, ["true", "rule"])
    columns = ", ".join(f"`{s}_{c}` int" for s in ("true", "rule") for c in HIGH)
    return spark.read.option("header", True).schema(f"contract_title string, {columns}").csv(path)
