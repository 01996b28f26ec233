"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting reads every labelled training row; each task adds up its own n-gram counts and Spark sums
them by (language, bucket). The log-probability matrix is languages x buckets, so its size does not
grow with the documents; it is checked before it is broadcast. Scoring gathers matrix rows for
all n-grams of a batch and sums them per document.

A text that is null or has no letter gives `und` with score 0, and so does everything when no
labelled row exists. Empty tables give empty ones, repeated rows repeated ones. Ties go to the
alphabetically first language. Only the named columns are read. Texts are taken whole, in slices
of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import per_batch, to_batch

UNDETERMINED = "und"
#: Largest log-probability matrix that is broadcast, in bytes.
MATRIX_BYTES = 256 << 20
_LETTERS = np.zeros(0, bool)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def folded(text: str) -> np.ndarray:
    """Lower-cased code points; runs of other characters than letters are one space, at both ends too."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(letters()[points], points, np.uint32(32))
    space = points == 32
    return points[~space | np.append(True, ~space[:-1])]


def grams(points: np.ndarray, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Bucket numbers of all n-grams of the given sizes."""
    parts = []
    for size in sizes:
        n = len(points) - size + 1
        if n > 0:
            value = np.full(n, size, np.uint32)
            for k in range(size):
                value = value * np.uint32(0x01000193) ^ points[k : k + n] * np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            value ^= value >> np.uint32(13)
            parts.append((value % np.uint32(buckets)).astype(np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def fit(
    docs: DataFrame, train: Column, buckets: int, sizes: tuple[int, ...] = (1, 2, 3), text: str = "text", lang: str = "lang"
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log priors and the log-probability matrix (buckets x languages), from all rows where ``train`` holds."""
    rows = docs.filter(train & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    arrow = None

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[name] = seen.get(name, 0) + 1
                if value.is_valid and len(points := folded(str(value))) > 1:
                    if name not in totals:
                        totals[name] = np.zeros(buckets, np.int64)
                    for at in range(0, len(points), 1 << 20):
                        totals[name] += np.bincount(grams(points[at : at + (1 << 20) + max(sizes) - 1], sizes, buckets), minlength=buckets)
        for name, n in seen.items():
            found = np.flatnonzero(totals[name]) if name in totals else np.zeros(0, np.int64)
            numbers = totals[name][found] if name in totals else found
            columns = {"lang": [name] * (len(found) + 1), "bucket": np.append(found, -1), "n": np.append(numbers, n)}
            yield to_batch(columns, arrow)

    from clausespark.llm.common import _arrow_schema

    schema = "lang string, bucket int, n long"
    arrow = _arrow_schema(docs, schema)
    counts = rows.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(MATRIX_BYTES // (8 * buckets) + 1).collect())
    if len(names) * buckets * 8 > MATRIX_BYTES:
        raise ValueError(f"{len(names)} or more languages x {buckets} buckets exceed {MATRIX_BYTES} bytes; take fewer buckets")
    if not names:
        return [], np.zeros(0), np.zeros((buckets, 0), np.float32)
    table: pd.DataFrame = counts.toPandas()
    column = table["lang"].map({name: k for k, name in enumerate(names)}).to_numpy()
    gram = table["bucket"].to_numpy() >= 0
    matrix, rows_of = np.zeros((buckets, len(names))), np.zeros(len(names))
    matrix[table["bucket"].to_numpy()[gram], column[gram]] = table["n"].to_numpy()[gram]
    rows_of[column[~gram]] = table["n"].to_numpy()[~gram]
    matrix += 1.0
    return names, np.log(rows_of / rows_of.sum()), np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def predict(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray, np.ndarray],
    sizes: tuple[int, ...] = (1, 2, 3),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; the score is the posterior probability of the language."""
    names, prior, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def make():
        log_p = shared.value

        def run(batch):
            labels, scores = [], []
            for value in batch.column(1):
                points = folded(str(value)) if value.is_valid and names else ()
                if len(points) < 2:
                    labels.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = prior.copy()
                for at in range(0, len(points), 1 << 16):
                    found = grams(points[at : at + (1 << 16) + max(sizes) - 1], sizes, len(log_p))
                    total += log_p[found].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                labels.append(names[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            return {"doc_id": batch.column(0), "lang_pred": labels, "score": scores}

        return run

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return per_batch(read, make, "doc_id long, lang_pred string, score double")
