"""Closed-form and linear classifiers over term counts, all clauses in one pass.

Clauses become columns: one aggregation sums every clause's positives per term, and scoring adds
up every clause's term weights per document, so no (document, term, clause) rows arise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.operators.vocabulary import TermSpec, count_terms, sent_whole


def label_table(labels: DataFrame, clauses: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """(id, y0..yk) with one 0/1 column per clause."""
    return labels.groupBy(id_col).agg(
        *[
            F.coalesce(F.max(F.when(F.col("clause") == c, F.col("y"))), F.lit(0)).alias(f"y{i}")
            for i, c in enumerate(clauses)
        ]
    )


def judged(scores: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Scores with the columns of their label rows, of which there are documents x clauses.

    Written labels pack into so small a file that Spark would send all of them through the driver; a merge join doesn't.
    """
    return scores.join(labels.hint("merge"), [id_col, "clause"])


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("clause").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_pos"), (F.count("*") - F.sum("y")).alias("n_neg")
    )


def class_weights(labels: DataFrame, cap: float = 20.0) -> DataFrame:
    """Balanced weights, positive-class scales and naive-Bayes prior weights per clause."""
    c = class_counts(labels)
    ratio = F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))
    return c.select(
        "clause",
        "n_pos",
        "n_neg",
        F.when(F.col("n_pos") > 0, F.col("n") / (2 * F.col("n_pos"))).alias("balanced_pos"),
        F.when(F.col("n_neg") > 0, F.col("n") / (2 * F.col("n_neg"))).alias("balanced_neg"),
        F.greatest(F.lit(1.0), ratio).alias("scale_pos"),
        F.least(ratio, F.lit(cap)).alias("scale_pos_capped"),
        (F.col("n_neg") / F.col("n")).alias("prior_weight_pos"),
        (F.col("n_pos") / F.col("n")).alias("prior_weight_neg"),
    )


MASK_BITS = 62


def mask_names(k: int) -> list[str]:
    return [f"_mask{j}" for j in range((k + MASK_BITS - 1) // MASK_BITS)]


def with_labels(
    docs: DataFrame, labels: DataFrame, clauses: Sequence[str], id_col: str = "doc_id", how: str = "inner"
) -> DataFrame:
    """Join the labels to the documents, 62 clauses to a number, while there is one row per text.

    Term rows made later carry the numbers along and need no join with labels. A left join keeps documents without labels,
    whose numbers are null.
    """
    bits = [
        F.when((F.col("clause") == c) & (F.col("y") == 1), F.lit(1 << (i % MASK_BITS))).otherwise(F.lit(0)).cast("long")
        for i, c in enumerate(clauses)
    ]
    masks = labels.groupBy(id_col).agg(
        *[
            F.bit_or(sum(bits[j * MASK_BITS : (j + 1) * MASK_BITS], F.lit(0).cast("long"))).alias(name)
            for j, name in enumerate(mask_names(len(clauses)))
        ]
    )
    return docs.join(masks, id_col, how)


def is_positive(i: int) -> Column:
    return F.shiftright(F.col(f"_mask{i // MASK_BITS}"), i % MASK_BITS).bitwiseAND(F.lit(1).cast("long")) == 1


def term_sums(rows: DataFrame, k: int, value: str = "tf") -> DataFrame:
    """(term, total, p0..pk): sums of ``value`` over all and over each clause's positive documents."""
    return rows.groupBy("term").agg(
        F.sum(value).alias("total"),
        *[F.sum(F.when(is_positive(i), F.col(value)).otherwise(0)).alias(f"p{i}") for i in range(k)],
    )


@dataclass(frozen=True)
class LinearModel:
    """Term weights of all clauses: ``table`` is (term, w0..wk), at most one row per kept term.

    ``spec`` tells how many terms are kept; the table of a capped vocabulary is broadcast to the term rows it scores.
    """

    table: DataFrame
    biases: list[float]
    clauses: list[str]
    spec: TermSpec | None = None

    def joined(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(self.table if self.spec is None else sent_whole(self.table, self.spec), "term", how)


def positives_and_negatives(labels: DataFrame, clauses: Sequence[str]) -> list[tuple[float, float]]:
    """Class counts in clause order; one small row per clause comes to the driver."""
    found = {r["clause"]: (float(r["n_pos"]), float(r["n_neg"])) for r in class_counts(labels).collect()}
    return [found.get(c, (0.0, 0.0)) for c in clauses]


def _log_ratio(a: float, b: float) -> float:
    """Log odds; a clause with one class only is always or never predicted."""
    if a == 0 or b == 0:
        return math.inf if a > 0 else -math.inf
    return math.log(a / b)


def multinomial_nb(sums: DataFrame, labels: DataFrame, clauses: Sequence[str], alpha: float = 0.5) -> LinearModel:
    """Log-odds weights and prior log-odds of multinomial naive Bayes.

    ``sums`` should be written out (one row per kept term): it is read for its totals and again for
    the weights.
    """
    k = len(clauses)
    totals = sums.agg(
        F.count("*").alias("v"), F.sum("total").alias("all"), *[F.sum(f"p{i}").alias(f"s{i}") for i in range(k)]
    ).first()
    columns, biases = [F.col("term")], []
    for i, (n1, n0) in enumerate(positives_and_negatives(labels, clauses)):
        pos_all = float(totals[f"s{i}"]) + alpha * totals["v"]
        neg_all = float(totals["all"] - totals[f"s{i}"]) + alpha * totals["v"]
        pos = F.log((F.col(f"p{i}") + alpha) / pos_all)
        neg = F.log((F.col("total") - F.col(f"p{i}") + alpha) / neg_all)
        columns.append((pos - neg).alias(f"w{i}"))
        biases.append(_log_ratio(n1, n0))
    return LinearModel(sums.select(*columns), biases, list(clauses))


def complement_nb(sums: DataFrame, labels: DataFrame, clauses: Sequence[str], alpha: float = 0.5) -> LinearModel:
    """Complement naive Bayes with prior sample weights and normalised weights.

    A positive document weighs the share of negatives and the other way round. The complement of
    the positive class is the negative one, so its log shares describe positives; both sets of log
    shares are divided by their sums. No class prior enters.
    """
    k = len(clauses)
    counts = positives_and_negatives(labels, clauses)
    weighted = [F.col("term")]
    for i, (n1, n0) in enumerate(counts):
        n = max(n1 + n0, 1.0)
        weighted.append((F.col(f"p{i}") * (n0 / n) + alpha).alias(f"pos{i}"))
        weighted.append(((F.col("total") - F.col(f"p{i}")) * (n1 / n) + alpha).alias(f"neg{i}"))
    table = sums.select(*weighted)
    sides = [f"{side}{i}" for i in range(k) for side in ("pos", "neg")]
    masses = table.agg(*[F.sum(s).alias(s) for s in sides]).first()
    logs = table.select("term", *[F.log(F.col(s) / float(masses[s])).alias(s) for s in sides])
    norms = logs.agg(*[F.sum(s).alias(s) for s in sides]).first()
    columns = [F.col("term")]
    for i in range(k):
        positive = F.col(f"neg{i}") / float(norms[f"neg{i}"])
        negative = F.col(f"pos{i}") / float(norms[f"pos{i}"])
        columns.append((positive - negative).alias(f"w{i}"))
    one_class = [0.0 if n1 and n0 else _log_ratio(n1, n0) for n1, n0 in counts]
    return LinearModel(logs.select(*columns), one_class, list(clauses))


def score_counts(
    docs: DataFrame, model: LinearModel, spec: TermSpec, id_col: str = "doc_id", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, carried columns, clause, prob) for every document and clause from its raw term counts.

    The texts are read once: a document without terms keeps a row of nulls, and each task sums its
    documents to one row of margins before the shuffle. Rows that repeat an id are one document.
    """
    rows = count_terms(docs.select(id_col, *carry, "text"), spec, id_col, carry=carry, outer=True)
    return _score_rows(rows, model, id_col, carry)


def score_counted(counted: DataFrame, model: LinearModel, id_col: str = "doc_id") -> DataFrame:
    """The same from texts already counted (``vocabulary.counted_texts``)."""
    return _score_rows(counted.select(id_col, F.inline_outer("counts")), model, id_col)


def _score_rows(rows: DataFrame, model: LinearModel, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
    margins = _margins(model.joined(rows, "left"), "tf", model, id_col, carry)
    return _probabilities(margins, model, id_col, carry)


def score_weights(
    docs: DataFrame, weights: DataFrame, model: LinearModel, spec: TermSpec, id_col: str = "doc_id"
) -> DataFrame:
    """(id, clause, prob) from TF-IDF rows (id, term, weight)."""
    margins = _margins(model.joined(weights), "weight", model, id_col)
    return _probabilities(docs.select(id_col).join(margins, id_col, "left"), model, id_col)


def _margins(joined: DataFrame, value: str, model: LinearModel, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row of sums per document; carried columns don't join the key, so documents stay where they are."""
    sums = [F.sum(F.col(value) * F.col(f"w{i}")).alias(f"m{i}") for i in range(len(model.clauses))]
    return joined.groupBy(id_col).agg(*[F.max(c).alias(c) for c in carry], *sums)


def _probabilities(margins: DataFrame, model: LinearModel, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
    margin = lambda i: F.coalesce(F.col(f"m{i}"), F.lit(0.0)) + F.lit(model.biases[i])
    return spread_clauses(margins, model.clauses, margin, id_col, carry)


def spread_clauses(
    df: DataFrame, clauses: Sequence[str], margin: Callable[[int], Column], id_col: str = "doc_id", carry: Sequence[str] = ()
) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("clause"), sigmoid(margin(i)).alias("prob")) for i, c in enumerate(clauses)
    ]
    return df.select(id_col, *carry, F.inline(F.array(*rows)))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
