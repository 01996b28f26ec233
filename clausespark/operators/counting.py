"""Term counts of whole batches of texts by array code.

Tokens come from the row's own expressions, one space between them, so they are those of ``functions/terms.py``. A task numbers the
distinct tokens of a piece of its texts, makes n-grams of the numbers and counts those; strings are made for the distinct terms only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.functions import terms as N
from clausespark.functions import text as X

#: Bytes of tokens that are counted at a time.
PIECE = 8 << 20


def tokens(spec, text: str = "text") -> Column:
    """What the terms of ``spec`` are made of: word tokens, or the words whose characters count. None holds a space."""
    source = X.strip_accents(F.col(text)) if spec.strip_accents else F.col(text)
    found = X.words(F.lower(source)) if spec.analyzer == "char_wb" else N.word_tokens(source)
    return F.array_join(found, " ")


def cut(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of some ``PIECE`` bytes in ``column``."""
    ends = np.cumsum(lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def lengths(texts) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def counted(texts, spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rows, terms and counts of the terms of each row of tokens, in order of rows; a term is a place in the names, given last."""
    lists = pc.split_pattern(texts, " ")  # an empty text is split into an empty token
    many = np.where(lengths(texts) > 0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0)
    row, found = np.repeat(np.arange(len(lists)), many), lists.flatten()
    coded = found.filter(pc.not_equal(found, "")).dictionary_encode()
    code, own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())
    found = _characters(row, code, own, spec) if spec.analyzer == "char_wb" else _words(row, code, own, spec)
    names = pa.concat_arrays([names for _, _, names in found]) if found else pa.array([], pa.string())
    start, keys = 0, []
    for at, gram, part in found:
        keys.append(at * len(names) + start + gram)
        start += len(part)
    key, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return key // max(len(names), 1), key % max(len(names), 1), tf, names


def _words(row: np.ndarray, code: np.ndarray, own: pa.Array, spec) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Rows, numbers and names of the n-grams of every length: one is the one before it and a token."""
    parts, gram, names = [], code, own
    for n in range(1, spec.hi + 1):
        if n > 1:
            keys, gram = np.unique(gram[: len(code) - n + 1] * max(len(own), 1) + code[n - 1 :], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(keys // max(len(own), 1))), own.take(pa.array(keys % max(len(own), 1))), " ")
        if n >= spec.lo:
            whole = row[: len(gram)] == row[n - 1 :]  # all tokens are of one text
            parts.append((row[: len(gram)][whole], gram[whole], names))
        if len(gram) < 2:
            break
    return parts


def _characters(row: np.ndarray, code: np.ndarray, own: pa.Array, spec) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """The same for the character n-grams inside words, made once for each distinct word."""
    grams = [word_grams(f" {word} ", spec.lo, spec.hi) for word in own.to_pylist()]
    each = np.array([len(g) for g in grams], np.int64)
    coded = pa.array([g for some in grams for g in some], pa.string()).dictionary_encode()
    starts, many = np.cumsum(each) - each, each[code]
    at = np.repeat(starts[code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return [(np.repeat(row, many), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at], coded.dictionary)]


def word_grams(padded: str, lo: int, hi: int) -> list[str]:
    """``terms.word_char_ngrams`` of a padded word."""
    size = len(padded)
    found = [padded[i : i + lo] for i in range(max(size - lo, 0) + 1)]
    return found + [padded[i : i + n] for n in range(lo + 1, hi + 1) for i in range(size - n + 1)]


def packed(df: DataFrame, spaces: Sequence[tuple], carry: Sequence[str] = (), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, the columns ``carry``, ``i`` and ``w``: ids and weights of the known terms of every row, as arrays.

    ``spaces`` are (spec, vocabulary, first id) of vocabularies that lie side by side; weights are TF-IDF, of length one in
    each. ``df`` has the rows of an id in one task (``vocabulary.by_document``). Rows of one id count as one document, and each
    has all its terms; a row without id has none. Vocabularies are capped and broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    context, known = df.sparkSession.sparkContext, []
    for spec, vocabulary, first in spaces:
        rows = vocabulary.select("term", "term_id", "idf").toPandas()
        known.append((spec, first, pa.array(rows["term"], pa.string()), rows["term_id"].to_numpy(np.int64), rows["idf"].to_numpy(np.float64)))
    shared = context.broadcast(known)
    read = df.sortWithinPartitions(id_col).select(id_col, *carry, *[tokens(spec, text).alias(f"tokens{k}") for k, (spec, _, _) in enumerate(spaces)])
    own = df.select(id_col, *carry).schema
    arrow = pa.schema([*to_arrow_schema(own), ("i", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))])
    places = range(1 + len(carry), 1 + len(carry) + len(spaces))

    def weighed(batch: pa.RecordBatch, run: np.ndarray):
        """Rows, ids and weights of all spaces, in order of rows; ``run`` numbers the documents."""
        parts = []
        for k, (spec, first, terms, ids, idf) in zip(places, shared.value):
            row, term, tf, names = counted(batch.column(k), spec)
            place = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy(zero_copy_only=False)[term]
            here = place >= 0
            row, place, tf = row[here], place[here], tf[here]
            raw = (1.0 + np.log(tf) if spec.sublinear else tf.astype(np.float64)) * idf[place]
            length = np.sqrt(np.bincount(run[row], raw * raw, len(batch)))
            parts.append((row, (ids[place] + first).astype(np.int32), raw / length[run[row]]))
        if len(parts) == 1:
            return parts[0]
        row, term, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(row, kind="stable")
        return row[order], term[order], weight[order]

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        run = np.cumsum([k > 0 and (x is None or x != ids[k - 1]) for k, x in enumerate(ids)])
        row, term, weight = weighed(batch, run)
        of_run = run[row]
        many = np.bincount(of_run, minlength=len(ids))[run]
        many[[x is None for x in ids]] = 0
        starts = np.searchsorted(of_run, run)
        ends = np.append(0, np.cumsum(many))
        at = np.repeat(starts - ends[:-1], many) + np.arange(ends[-1])
        ends = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[at])) for x in (term, weight)]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in range(1 + len(carry))] + lists, schema=arrow)

    def whole(slices: list[pa.RecordBatch]) -> pa.RecordBatch:
        return slices[0] if len(slices) == 1 else pa.concat_batches(slices)

    def run(batches):
        held: list[pa.RecordBatch] = []  # the rows of the last id, which may go on in the next piece
        for batch in (piece for b in batches for piece in cut(b, places[0])):
            ids = batch.column(0).to_pylist()
            begin = next((k for k in range(len(ids) - 1, 0, -1) if ids[k] != ids[k - 1]), 0)
            if held and (begin or held[-1].column(0)[0].as_py() != ids[0]):
                if begin:
                    yield made(whole([*held, batch.slice(0, begin)]))
                    held = [batch.slice(begin)]
                else:
                    yield made(whole(held))
                    held = [batch]
            elif begin:
                yield made(batch.slice(0, begin))
                held = [batch.slice(begin)]
            else:
                held.append(batch)
        if held:
            yield made(whole(held))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["i array<int>", "w array<double>"])
    return read.mapInArrow(run, schema)
