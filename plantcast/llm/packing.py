"""Packing of tokenized documents into sequences by first-fit decreasing.

Documents are cut into pieces of at most the sequence length, pieces are dealt to random groups of about
``GROUP_BYTES`` of text, and each group is packed on its own: longest piece first, into the first bin with room.
A tournament tree over the bins' free capacities (each inner node holds the larger of its two children) finds
that bin in a number of steps that grows with the logarithm of the number of bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from plantcast.llm.shared import group_count, text_batches
from plantcast.llm.tokens import word_ids

CAPACITY = 4096
GROUP_BYTES = 16 << 20
_PIECES = "key {key}, row long, start long, length long, doc_tokens long, copy long, ids binary"
_PACKED = "key {key}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


class CapacityTree:
    """Tournament tree of the free capacities of ``bins`` bins."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room and return the bin."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        chosen = node - self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            larger = max(free[2 * node], free[2 * node + 1])
            if free[node] == larger:
                break
            free[node] = larger
        return chosen


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each size, in the given order; equal sizes keep their order."""
    tree, bins = CapacityTree(len(sizes), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i] = tree.place(int(sizes[i]))
    return bins


def _cut(tokenizer: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen = word_ids(tokenizer).encode, Counter()
        for pdf in batches:
            rows = []
            for key, row, text in zip(pdf["key"], pdf["row"], pdf["text"]):
                ids = encode(text) + end
                total, copy = len(ids) // 4, seen[row]
                seen[row] += 1
                for at in range(0, total, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append((key, row, at, len(piece) // 4, total, copy, piece))
            yield pd.DataFrame(rows, columns=["key", "row", "start", "length", "doc_tokens", "copy", "ids"])

    return cut


def _pack(capacity: int):
    def pack(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "copy", "start"], kind="stable").reset_index(drop=True)
        pdf["bin"] = first_fit_decreasing(pdf["length"].tolist(), capacity)
        pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = (int(group[0]) << 32) + pdf["bin"]
        return pdf[["key", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]]

    return pack


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: ``key``, ``start`` and ``length`` in the document's ids, ``doc_tokens``, ``ids`` (little-endian
    unsigned 32-bit), ``sequence_id`` and ``offset`` in that sequence.

    Every document ends with ``end_id``; null and blank texts consist of it alone. Pieces of a repeated key or row are
    separate pieces and spread over the groups like any others. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType
    # pandas holds numbers beside nulls as floating point, so they pass as text.
    as_text = isinstance(kind, (NumericType, BooleanType))
    carried = "string" if as_text else kind.simpleString()
    # Equal rows of a partition are told apart by their copy, those of two partitions by its number.
    row = F.xxhash64(F.col(key), F.col(text), F.spark_partition_id())
    rows = docs.select(F.col(key).cast(carried).alias("key"), row.alias("row"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    pieces = rows.mapInPandas(_cut(tokenizer, end_id, capacity), _PIECES.format(key=carried))
    group = F.pmod(F.xxhash64("row", "start", "copy"), F.lit(group_count(size, GROUP_BYTES))).alias("g")
    packed = pieces.groupBy(group).applyInPandas(_pack(capacity), _PACKED.format(key=carried))
    return packed.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)
