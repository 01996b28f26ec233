"""Class-based n-gram language model: exchange clustering of words, class transitions, word emissions.

1. Word counts of the training texts: summed per task, then by word.
2. The most frequent words, at most ``TABLE`` of at most ``WORD_BYTES`` bytes, get numbers. This bounded table is
   broadcast, and each text is written once as numbers, with its other words beside them in order.
3. Exchange clustering: the most frequent words found the classes. The ``EXCHANGED`` first numbers get one row
   each with their left and right neighbours; they join the class that raises the likelihood of the class bigrams
   most and are then exchanged in turns, a hashed part at a time against the counts of the rest. A turn reads
   the rows with the broadcast class of each number and moves nothing; its outcome (a class per number)
   is bounded by the table. A turn that lowers the likelihood is undone.
4. All other training words, numbered or not, make one exchange step each by the classes around them.
5. Counts of class bigrams over all training texts give the probabilities.

The probability of a text is the product over its words and one end of
``P(class | class before) * P(word | class)``; what follows an end starts a text. Both factors are smoothed by
added counts. All unknown words are one more word; its share after a class is that of training words met
once, so the probabilities of all words, the end and the unknown word add up to one.

Null texts are empty ones: just an end. Rows without an id are scored, not learnt from, and their ``held_out`` is
null. Repeated rows count and are scored each. Without training rows everything is unknown, with probability one.
Empty tables give empty ones. Extra columns are not read. Texts are taken whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import UPPER_TO_LOWER, _arrow_schema, per_batch, to_batch
from clausespark.llm.importance_resampling import cutoff
from clausespark.session import cut_lineage

#: Numbered words, the longest of them in bytes, and how many of them are exchanged in rounds.
TABLE, WORD_BYTES, EXCHANGED = 400_000, 64, 6_000
#: Classes (at most 125), rounds of exchange, and parts of the words that move in turns.
CLASSES, ROUNDS, PARTS = 96, 4, 2
#: Added counts: to a word in its class, to the transitions and to the share of unknown words after a class.
WORD_ADDED, CLASS_ADDED, UNKNOWN_ADDED = 0.5, 20.0, 20.0
#: Number of the end; number of a word beyond the table; codes of a word still to be looked up and of an unknown
#: one; the bit of a word met once.
END, BEYOND, HOLE, UNKNOWN, ONCE = 0, -1, 126, 127, 128
#: Distinct words and bytes of text after which a task hands on its counts; pairs that it sorts together.
COUNTED_WORDS, COUNTED_BYTES, SORTED_PAIRS = 400_000, 256 << 20, 4_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(UPPER_TO_LOWER).split()


def read_texts(docs: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("text"),
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of the training texts, without ends; a task hands on its sums whenever they fill a table."""
    schema = "word binary, n long"
    arrow = _arrow_schema(texts, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        size = 0
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                seen.update(words)
                size += sum(map(len, words))
                if len(seen) > COUNTED_WORDS or size > COUNTED_BYTES:
                    yield to_batch({"word": list(seen), "n": list(seen.values())}, arrow)
                    seen, size = Counter(), 0
        yield to_batch({"word": list(seen), "n": list(seen.values())}, arrow)

    return texts.filter("train").select("text").mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Totals:
    """Training tokens (ends among them), distinct ones, and those met once."""

    tokens: int
    types: int
    once: int

    @property
    def new_share(self) -> float:
        """The share of words met once: how often an unknown word is to be expected."""
        return (self.once + 0.5) / (self.tokens + 1.0) if self.tokens else 1.0

    def log_base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def numbered_words(counts: DataFrame, size: int, longest: int) -> tuple[list[bytes], np.ndarray]:
    """The words above the count that at most ``size`` words reach, most frequent first, ties by their bytes, and their counts.

    Count jobs find that count, so nothing but these words comes to the driver.
    """
    able = counts.filter(F.octet_length("word") <= longest)
    if able.count() > size:
        least = cutoff(able, F.col("n"), size)
        able = able.filter(F.col("n") >= least + (able.filter(F.col("n") >= least).count() > size))
    found = able.select("word", "n").toArrow()
    words, n = found.column("word").to_pylist(), found.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    return [words[k] for k in order], n[order].astype(np.int64)


def encoded(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """``doc_id, train, ids, beyond`` of every row: the numbers of its words (``BEYOND`` where the table ends), and those words."""
    shared = texts.sparkSession.sparkContext.broadcast(words)  # at most TABLE words of WORD_BYTES bytes

    def make():
        number = {word: k + 1 for k, word in enumerate(shared.value)}

        def run(batch):
            ids, beyond = [], []
            for text in batch.column(2):
                own = words_of(text.as_py())
                found = np.fromiter((number.get(word, BEYOND) for word in own), np.int32, len(own))
                ids.append(found)
                beyond.append([own[k] for k in np.flatnonzero(found == BEYOND)])
            return {"doc_id": batch.column(0), "train": batch.column(1), "ids": ids, "beyond": beyond}

        return run

    return per_batch(texts, make, "doc_id long, train boolean, ids array<int>, beyond array<binary>")


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and where each row's begin and end."""
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.array([len(x) for x in column], np.int64)))


def with_ends(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values of all rows in one sequence, an end before the first row and after each."""
    return np.append(np.insert(values, ends[:-1], END), END)


def summed_keys(rows: DataFrame, keys, limit: int = SORTED_PAIRS) -> DataFrame:
    """``key, n``: how often the long keys that ``keys`` finds in the numbers of training texts occur."""
    schema = "key long, n long"
    arrow = _arrow_schema(rows, schema)

    def count(batches):
        def folded():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return to_batch({"key": found, "n": n}, arrow)

        held: list[np.ndarray] = [np.zeros(0, np.int64)]
        for batch in batches:
            if batch.num_rows:
                held.append(keys(with_ends(*lists(batch.column(0))).astype(np.int64)))
                if sum(map(len, held)) > limit:
                    yield folded()
                    held = [np.zeros(0, np.int64)]
        yield folded()

    return rows.filter("train").select("ids").mapInArrow(count, schema).groupBy("key").agg(F.sum("n").alias("n"))


def neighbours(rows: DataFrame, size: int) -> DataFrame:
    """``id, left_other, left_n, right_other, right_n``: the neighbours of the numbers below ``size`` among these."""

    def keys(sequence: np.ndarray) -> np.ndarray:
        a, b = sequence[:-1], sequence[1:]
        known = (a >= 0) & (b >= 0) & (a < size) & (b < size)
        return a[known] * size + b[known]

    pairs = cut_lineage(summed_keys(rows, keys))
    pairs = pairs.select(F.expr(f"key div {size}").cast("int").alias("a"), (F.col("key") % size).cast("int").alias("b"), "n")

    def side(own: str, other: str, name: str) -> DataFrame:
        listed = F.collect_list(F.struct(F.col(other).alias("other"), "n"))  # at most one entry per number
        return pairs.groupBy(F.col(own).alias("id")).agg(listed.alias(name))

    both = side("a", "b", "right").join(side("b", "a", "left"), "id", "full")
    columns = [F.coalesce(F.col(f"{x}.{y}").cast("array<long>"), F.array().cast("array<long>")).alias(f"{x}_{y}") for x in ("left", "right") for y in ("other", "n")]
    return cut_lineage(both.select("id", *columns))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that depends on the classes."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(axis=0)).sum() - xlogx(pairs.sum(axis=1)).sum())


def exchange_gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """How much the likelihood rises when each word joins each class (words x classes).

    ``left`` and ``right`` (words x classes) count a word's neighbours by class, ``pairs`` all class bigrams. For its
    own class (-1: none) a word counts as taken out first. Words of the own class among a word's neighbours stay where
    they are. Nobody joins the class of the end. Gains equal to six decimals go to the first class.
    """
    words, classes = left.shape
    gains = np.zeros((words, classes))
    placed = np.flatnonzero(own >= 0)
    for counts, table in ((left, pairs.T), (right, pairs)):  # table[b, c]: class b beside neighbours of class c
        row, beside = np.nonzero(counts)
        n = counts[row, beside]
        cells, back = np.unique(np.stack([beside, n]), axis=1, return_inverse=True)
        before = table[:, cells[0].astype(np.int64)].T
        joins = xlogx(before + cells[1][:, None]) - xlogx(before)
        stays = xlogx(before) - xlogx(np.maximum(before - cells[1][:, None], 0))
        back = back.ravel()
        for at in range(0, len(row), 16_384):
            some = slice(at, at + 16_384)
            first = np.flatnonzero(np.append(True, row[some][1:] != row[some][:-1])) if len(row[some]) else []
            gains[row[some][first]] += np.add.reduceat(joins[back[some]], first)
        kept = np.bincount(row, stays[back, own[row]] - joins[back, own[row]], words)
        gains[placed, own[placed]] += kept[placed]
        sums, size = table.sum(axis=1), counts.sum(axis=1)
        gains -= xlogx(sums + size[:, None]) - xlogx(sums)
        at_home = sums[own]
        change = xlogx(at_home) - xlogx(np.maximum(at_home - size, 0)) - xlogx(at_home + size) + xlogx(at_home)
        gains[placed, own[placed]] -= change[placed]
    gains[:, END] = -np.inf
    return gains


def by_class(others, numbers, classes_of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of neighbours by class, rows x classes; neighbours without a class are left out."""
    values, ends = lists(others)
    n = lists(numbers)[0].astype(np.float64)
    row, own = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), classes_of[values.astype(np.int64)]
    known = own >= 0
    return np.bincount(row[known] * classes + own[known], n[known], (len(ends) - 1) * classes).reshape(-1, classes)


def class_pairs(table: DataFrame, classes_of: np.ndarray, classes: int) -> np.ndarray:
    """Class bigrams of the numbers that have classes, from one row per number; a task gives one row per bigram."""
    shared = table.sparkSession.sparkContext.broadcast(classes_of)
    schema = "cell int, n double"
    arrow = _arrow_schema(table, schema)

    def count(batches):
        total = np.zeros((classes, classes))
        for batch in batches:
            own = shared.value[batch.column(0).to_numpy()]
            right = by_class(batch.column(1), batch.column(2), shared.value, classes)
            np.add.at(total, own[own >= 0], right[own >= 0])
        found = np.flatnonzero(total)
        yield to_batch({"cell": found, "n": total.ravel()[found]}, arrow)

    rows = table.select("id", "right_other", "right_n").mapInArrow(count, schema).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(classes * classes)
    for r in rows:  # at most classes x classes
        pairs[r["cell"]] = r["n"]
    return pairs.reshape(classes, classes)


def chosen_classes(found: DataFrame, classes_of: np.ndarray) -> np.ndarray:
    """``classes_of`` with the classes of the rows ``id, class``, at most one per number."""
    out, rows = classes_of.copy(), found.toPandas()
    out[rows["id"].to_numpy()] = rows["class"].to_numpy()
    return out


def exchanged(table: DataFrame, moves: np.ndarray, classes_of: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The classes after every number that ``moves`` names went where it raises the likelihood most."""
    classes = len(pairs)
    shared = table.sparkSession.sparkContext.broadcast((moves, classes_of, pairs))

    def make():
        moving, known, counts = shared.value

        def run(batch):
            ids = batch.column(0).to_numpy()
            chosen = np.flatnonzero(moving[ids])
            if not len(chosen):
                return None
            left, right = (by_class(batch.column(k), batch.column(k + 1), known, classes)[chosen] for k in (1, 3))
            gains = exchange_gains(left, right, known[ids[chosen]], counts)
            return {"id": ids[chosen], "class": np.round(gains, 6).argmax(axis=1).astype(np.int32)}

        return run

    return chosen_classes(per_batch(table.select("id", "left_other", "left_n", "right_other", "right_n"), make, "id int, class int"), classes_of)


def cluster(table: DataFrame, size: int, classes: int, rounds: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each number below ``size`` and the class bigrams. The end is a class of its own (0), the next most frequent
    words found the others."""
    classes_of = np.full(size, -1, np.int64)
    classes_of[:classes] = np.arange(min(classes, size))
    numbers = np.arange(size)
    if size > classes:
        classes_of = exchanged(table, numbers >= classes, classes_of, class_pairs(table, classes_of, classes))
    pairs = class_pairs(table, classes_of, classes)
    for _ in range(rounds):
        before = likelihood(pairs)
        for part in range(parts):
            moves = (numbers * 2_654_435_761 % 2**32 % parts == part) & (numbers != END)
            tried = exchanged(table, moves, classes_of, pairs)
            counted = class_pairs(table, tried, classes)
            if likelihood(counted) > likelihood(pairs):
                classes_of, pairs = tried, counted
        if likelihood(pairs) <= before:
            break
    return classes_of, pairs


# ---- one exchange step of all other words -------------------------------------------------


def surroundings(left: np.ndarray, right: np.ndarray, classes: int) -> np.ndarray:
    """One number for the classes on both sides; ``classes`` stands for none."""
    return np.where(left < 0, classes, left) * (classes + 1) + np.where(right < 0, classes, right)


def joined_classes(listed: DataFrame, pairs: np.ndarray, key: str, kind: str) -> DataFrame:
    """``<key>, class, n`` of words with ``around, n``: their surroundings (at most (classes + 1)^2) and how often each."""
    classes = len(pairs)
    shared = listed.sparkSession.sparkContext.broadcast(pairs)

    def make():
        def run(batch):
            around, ends = lists(batch.column(1))
            n = lists(batch.column(2))[0].astype(np.float64)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            both = []
            for side in (around // (classes + 1), around % (classes + 1)):
                known = side < classes
                both.append(np.bincount(row[known] * classes + side[known], n[known], (len(ends) - 1) * classes).reshape(-1, classes))
            gains = exchange_gains(*both, np.full(len(ends) - 1, -1), shared.value)
            total = np.bincount(row, n, len(ends) - 1).astype(np.int64)
            return {key: batch.column(0), "class": np.round(gains, 6).argmax(axis=1).astype(np.int32), "n": total}

        return run

    return per_batch(listed, make, f"{key} {kind}, class int, n long")


def other_numbers(rows: DataFrame, size: int, classes_of: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The classes of all numbers below ``size``, those without one after their exchange step."""
    classes = len(pairs)
    whole = np.append(classes_of, np.full(size - len(classes_of), -1))
    if (whole >= 0).all():
        return whole
    shared = rows.sparkSession.sparkContext.broadcast(whole)
    cells = (classes + 1) ** 2

    def keys(sequence: np.ndarray) -> np.ndarray:
        known = np.append(shared.value, -1)  # the last entry is that of BEYOND
        at = np.flatnonzero((known[sequence[1:-1]] < 0) & (sequence[1:-1] != BEYOND)) + 1
        return sequence[at] * cells + surroundings(known[sequence[at - 1]], known[sequence[at + 1]], classes)

    found = summed_keys(rows, keys).select(F.expr(f"key div {cells}").cast("int").alias("id"), (F.col("key") % cells).cast("int").alias("around"), "n")
    listed = found.groupBy("id").agg(F.collect_list(F.struct("around", "n")).alias("s")).select("id", "s.around", "s.n")
    return chosen_classes(joined_classes(listed, pairs, "id", "int"), whole)


def words_beyond(rows: DataFrame, classes_of: np.ndarray, classes: int) -> DataFrame:
    """``_row, at, word, train, around`` of every word beyond the table: its place among those of its row, its surroundings."""
    shared = rows.sparkSession.sparkContext.broadcast(classes_of)

    def make():
        known = np.append(shared.value, -1)  # the last entry is that of BEYOND

        def run(batch):
            values, ends = lists(batch.column(2))
            at = np.flatnonzero(values == BEYOND)
            if not len(at):
                return None
            sequence = known[with_ends(values, ends)]
            row = np.searchsorted(ends, at, side="right") - 1
            place = at + row + 1
            number = np.arange(len(at)) - np.searchsorted(row, row)
            return {
                "_row": batch.column(0).take(pa.array(row)), "at": number, "word": batch.column(3).flatten(),
                "train": batch.column(1).take(pa.array(row)), "around": surroundings(sequence[place - 1], sequence[place + 1], classes),
            }

        return run

    read = rows.select("_row", "train", "ids", "beyond")
    return per_batch(read, make, "_row long, at int, word binary, train boolean, around int")


def place_words(beyond: DataFrame, pairs: np.ndarray) -> DataFrame:
    """``word, class, n`` of every training word beyond the table, each after one exchange step.

    Surroundings are counted per task before the one shuffle by word, so a long word that many texts hold doesn't gather.
    """
    schema = "word binary, around int, n long"
    arrow = _arrow_schema(beyond, schema)

    def count(batches):
        seen: Counter[tuple[bytes, int]] = Counter()
        for batch in batches:
            seen.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if len(seen) > COUNTED_WORDS:
                yield folded(seen)
                seen = Counter()
        yield folded(seen)

    def folded(seen):
        return to_batch({"word": [w for w, _ in seen], "around": [a for _, a in seen], "n": list(seen.values())}, arrow)

    counted = beyond.filter("train").select("word", "around").mapInArrow(count, schema).repartition("word")
    listed = counted.groupBy("word", "around").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("around", "n")).alias("s"))
    return joined_classes(listed.select("word", "s.around", "s.n"), pairs, "word", "binary")


# ---- probabilities and scores -------------------------------------------------------------


def coded(rows: DataFrame, classes_of: np.ndarray, number_n: np.ndarray, totals: Totals) -> DataFrame:
    """``_row, doc_id, train, codes, n_known, base, met``: a byte per token, its class and whether it was met once, and sums
    over the known tokens, of base scores and of the logarithms of smoothed counts; words beyond the table are holes."""
    shared = rows.sparkSession.sparkContext.broadcast((classes_of, number_n))

    def make():
        own, n_of = shared.value
        met = n_of > 0  # all but the end where nothing is learnt from
        code = np.append(np.where(met, own + ONCE * (n_of == 1), UNKNOWN), HOLE).astype(np.uint8)
        logs = np.vstack([np.append(met, 0), np.append(totals.log_base(n_of), 0), np.append(np.where(met, np.log10(n_of + WORD_ADDED), 0), 0)])

        def run(batch):
            values, ends = lists(batch.column(3))
            passed = np.hstack([np.zeros((3, 1)), np.cumsum(logs[:, values], axis=1)])
            sums = passed[:, ends[1:]] - passed[:, ends[:-1]] + logs[:, [END]]
            codes, last = code[values], code[END].tobytes()
            texts = [codes[a:b].tobytes() + last for a, b in zip(ends[:-1], ends[1:])]
            return {
                "_row": batch.column(0), "doc_id": batch.column(1), "train": batch.column(2), "codes": texts,
                "n_known": sums[0].astype(np.int64), "base": sums[1], "met": sums[2],
            }

        return run

    read = rows.select("_row", "doc_id", "train", "ids")
    return per_batch(read, make, "_row long, doc_id long, train boolean, codes binary, n_known long, base double, met double")


def filled(codes: DataFrame, found: DataFrame, totals: Totals) -> DataFrame:
    """The coded rows with the words beyond the table (``_row, at, class, n``; no class: unknown) in their holes."""
    listed = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "class", "n"))).alias("s"))
    joined = codes.join(listed.select("_row", "s.class", "s.n"), "_row", "left")

    def make():
        def run(batch):
            out = {name: [] for name in ("codes", "n_known", "base", "met")}
            for text, n_known, base, met, own, n in zip(*(batch.column(k) for k in range(2, 8))):
                text, sums = text.as_py(), [n_known.as_py(), base.as_py(), met.as_py()]
                if own.is_valid:
                    sequence = np.frombuffer(text, np.uint8).copy()
                    classes, n = own.values.to_numpy(zero_copy_only=False), n.values.to_numpy(zero_copy_only=False)
                    known = n > 0
                    sequence[sequence == HOLE] = np.where(known, classes + ONCE * (n == 1), UNKNOWN)
                    text = sequence.tobytes()
                    sums = [sums[0] + int(known.sum()), sums[1] + totals.log_base(n).sum(), sums[2] + np.log10(n[known] + WORD_ADDED).sum()]
                for name, value in zip(out, (text, *sums)):
                    out[name].append(value)
            return {"doc_id": batch.column(0), "train": batch.column(1)} | out

        return run

    read = joined.select("doc_id", "train", "codes", "n_known", "base", "met", "class", "n")
    return per_batch(read, make, "doc_id long, train boolean, codes binary, n_known long, base double, met double")


def sequence_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all rows in one sequence behind an end, and where each row begins and ends."""
    texts = column.to_pylist()
    return np.frombuffer(bytes([END]) + b"".join(texts), np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))


def class_counts(sequences: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams of the training rows, and how often a word met once follows each class; a task gives bounded rows."""
    schema = "cell int, n long"
    arrow = _arrow_schema(sequences, schema)

    def count(batches):
        total, once = np.zeros(classes * classes, np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            if batch.num_rows:
                codes, _ = sequence_of(batch.column(0))  # each row ends with an end, which starts the next
                own = (codes % ONCE).astype(np.int64)
                total += np.bincount(own[:-1] * classes + own[1:], minlength=classes * classes)
                once += np.bincount(own[:-1][codes[1:] >= ONCE], minlength=classes)
        both = np.append(total, once)
        found = np.flatnonzero(both)
        yield to_batch({"cell": found, "n": both[found]}, arrow)

    rows = sequences.filter("train").select("codes").mapInArrow(count, schema).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(classes * classes + classes)
    for r in rows:  # at most classes x (classes + 1)
        both[r["cell"]] = r["n"]
    return both[: classes * classes].reshape(classes, classes), both[classes * classes :]


@dataclass
class Model:
    """log10 probabilities of classes after classes (last row: after an unknown word; last column: an unknown word), and
    those of a class's words without their own counts."""

    transitions: np.ndarray
    emissions: np.ndarray
    totals: Totals


def probabilities(pairs: np.ndarray, once: np.ndarray, types: np.ndarray, totals: Totals) -> Model:
    """The smoothed model from class bigrams, words met once after each class, and distinct words of each class."""
    tokens, before = pairs.sum(axis=0), pairs.sum(axis=1)
    usual = tokens / max(tokens.sum(), 1.0)
    classes = (pairs + CLASS_ADDED * usual) / (before[:, None] + CLASS_ADDED)
    unknown = np.append((once + UNKNOWN_ADDED * totals.new_share) / (before + UNKNOWN_ADDED), totals.new_share)
    whole = np.hstack([np.vstack([classes, usual]) * (1 - unknown)[:, None], unknown[:, None]])
    with np.errstate(divide="ignore"):
        return Model(np.log10(whole), np.append(-np.log10(np.maximum(tokens + WORD_ADDED * types, 1e-300)), 0.0), totals)


def scored(sequences: DataFrame, model: Model, held_out: Column) -> DataFrame:
    shared = sequences.sparkSession.sparkContext.broadcast(model)  # classes x classes numbers
    classes = len(model.emissions) - 1

    def make():
        own = shared.value

        def run(batch):
            codes, ends = sequence_of(batch.column(1))
            at = np.minimum(codes % ONCE, classes).astype(np.int64)
            logs = own.transitions[at[:-1], at[1:]] + own.emissions[at[1:]]
            # every row starts after an end, which the row before closes
            score = np.add.reduceat(logs, ends[:-1]) + batch.column(4).to_numpy()
            sizes = np.diff(ends)
            return {
                "doc_id": batch.column(0), "n_tokens": sizes, "n_known": batch.column(2), "base_score": batch.column(3), "score": score,
                "train_tokens": np.full(len(sizes), own.totals.tokens), "perplexity": 10 ** (-score / sizes),
            }

        return run

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    found = per_batch(sequences.select("doc_id", "codes", "n_known", "base", "met"), make, schema)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def score(
    docs: DataFrame, train: Column, held_out: Column, doc_id: str = "doc_id", text: str = "text",
    table: int = TABLE, exchange: int = EXCHANGED, classes: int = CLASSES, rounds: int = ROUNDS, parts: int = PARTS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row, learnt from those where ``train`` holds."""
    texts = read_texts(docs, doc_id, text, train)
    counts = cut_lineage(word_counts(texts))
    summed = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    words, word_n = numbered_words(counts, table, WORD_BYTES)
    rows = cut_lineage(encoded(texts, words).withColumn("_row", F.monotonically_increasing_id()))
    ends = rows.filter("train").count()
    totals = Totals((summed["n"] or 0) + ends, summed["v"] + (ends > 0), summed["once"] + (ends == 1))

    size = len(words) + 1  # the end is a number too
    first, pairs = cluster(neighbours(rows, min(size, exchange)), min(size, exchange), classes, rounds, parts)
    classes_of = other_numbers(rows, size, first, pairs)
    beyond = cut_lineage(words_beyond(rows, classes_of, classes))
    placed = cut_lineage(place_words(beyond, pairs))
    found = beyond.select("_row", "at", "word").join(placed, "word", "left")
    found = found.select("_row", "at", F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    number_n = np.append(ends, word_n).astype(np.int64)
    sequences = cut_lineage(filled(coded(rows, classes_of, number_n, totals), found, totals))

    types = np.bincount(classes_of[int(ends == 0) :], minlength=classes).astype(np.float64)
    for r in placed.groupBy("class").agg(F.count("*").alias("types")).collect():  # a row per class
        types[r["class"]] += r["types"]
    return scored(sequences, probabilities(*class_counts(sequences, classes), types, totals), held_out)
