"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

Chunks of a text that no vocabulary piece can span are merged on their own and remembered per
worker process, so only new chunks are merged.

Nulls and empty texts count zero tokens and zero bytes. Every row gives one row, repeated ones too;
an empty table gives an empty one. Only the id and the text column are read, so other columns,
whatever their names, change nothing. Texts are taken whole; memory is bounded by the longest text.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import per_batch

SPACE = "▁"


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with byte fallback and identity normalisation.

    A merge is allowed where the joined string is a normal piece; the best score goes first, then
    the leftmost pair. Characters outside the vocabulary count their UTF-8 bytes.
    """

    REMEMBERED = 600_000

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        ordered = sorted(normal, key=lambda i: -model.get_score(i))
        scores = [model.get_score(i) for i in ordered]
        self.pieces, self.rank, level = {}, {}, -1
        for k, i in enumerate(ordered):
            if not k or scores[k] != scores[k - 1]:
                level += 1
            self.rank[model.id_to_piece(i)] = level
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("pieces that span words are not supported")
        joined = {c for piece in self.rank if len(piece) > 1 for c in piece}
        self.chunk = re.compile(" *[^ \n]+| +|\n" if "\n" not in joined else " *[^ ]+| +")
        self.known = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for chunk in self.chunk.findall(" " + text.replace(SPACE, " ")):
            n = known.get(chunk)
            if n is None:
                n = self.merged(chunk.replace(" ", SPACE))
                if len(chunk) <= 32:
                    if len(known) >= self.REMEMBERED:
                        known.clear()
                    known[chunk] = n
            total += n
        return total

    def merged(self, chunk: str) -> int:
        """Initial symbols minus merges; an unknown character weighs its bytes."""
        rank, symbols = self.rank, list(chunk)
        n = len(symbols)
        weight = sum(1 if c in rank else len(c.encode()) for c in symbols)
        heap = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, symbols[i] + symbols[i + 1]))
        if not heap:
            return weight
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, i, piece = heappop(heap)
            left, j = symbols[i], after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != len(piece):
                continue  # one of the two was merged elsewhere meanwhile
            symbols[i], symbols[j] = piece, None
            weight -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(joined := piece + symbols[k])
                if r is not None:
                    heappush(heap, (r, i, joined))
            h = before[i]
            if h >= 0:
                r = rank.get(joined := symbols[h] + piece)
                if r is not None:
                    heappush(heap, (r, h, joined))
        return weight


_COUNTERS: dict[str, PieceCounter] = {}


def piece_counter(model_file: str) -> PieceCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PieceCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; ``limit`` is the largest count that fits."""

    def make():
        counter = piece_counter(model_file)

        def run(batch):
            ids, texts, sizes = batch.columns
            return {"doc_id": ids, "n_bytes": sizes, "n_tokens": [counter.count(str(t)) if t.is_valid else 0 for t in texts]}

        return run

    read = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = per_batch(read, make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
