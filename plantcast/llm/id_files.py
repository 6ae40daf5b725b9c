"""Token ids in byte-aligned files.

Ids are replaced by their rank of frequency over the whole table, so that frequent ids are small, and written with
one to four bytes each. A document's block holds a head, the control bytes (two bits per id: its number of bytes less
one) and then the data bytes. Blocks end with a line feed, as the text writer puts it there, and stand in ascending
order of the key within and across files. The table of ranks is bounded by the vocabulary and lies beside the blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantcast.llm.shared import group_count, stored, text_batches
from plantcast.llm.tokens import word_ids
from plantcast.session import work_path

IDS_PER_FILE = 8_000_000
# Ids decoded at once.
IDS_TOGETHER = 1 << 20
# Null flag, key, number of ids, number of data bytes.
_HEAD = "<?qIQ"
_SHIFTS = np.arange(0, 8, 2, dtype=np.uint8)
# Bytes of the four ids of each control byte, and the part of four bytes that belongs to an id of so many bytes.
_LENGTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> _SHIFTS) & 3) + 1
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_texts(ranks: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Control bytes and data bytes of each text; ``ranks`` holds the ranks of all texts one after another."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    # Every text starts with a control byte of its own.
    controls = (sizes + 3) // 4
    ends, control_ends = np.cumsum(sizes), np.cumsum(controls)
    slots = np.zeros(int(controls.sum()) * 4, np.uint8)
    slots[np.arange(len(ranks)) + np.repeat(4 * (control_ends - controls) - ends + sizes, sizes)] = code
    control = np.bitwise_or.reduce(slots.reshape(-1, 4) << _SHIFTS, axis=1).astype(np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()
    data_ends = np.concatenate(([0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)))[ends].tolist()
    cuts = zip([0, *control_ends[:-1].tolist()], control_ends.tolist(), [0, *data_ends[:-1]], data_ends)
    return [(control[i:j], data[k:m]) for i, j, k, m in cuts]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one text."""
    return encode_texts(ranks, np.array([len(ranks)], np.int64))[0]


def decode_texts(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """Ranks of all texts, whose control bytes and data bytes stand one after another."""
    slots = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    controls = (sizes + 3) // 4
    shift = 4 * (np.cumsum(controls) - controls) - np.cumsum(sizes) + sizes
    lengths = slots[np.arange(sizes.sum()) + np.repeat(shift, sizes)]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    whole = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        whole[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return whole


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    return decode_texts(control, data, np.array([n], np.int64))


def _tokenize(tokenizer: str, end_id: int, kind: str, vocabulary: int):
    """Ids of each text, and after the last one a row whose ids are the numbers of uses of all ids (``counts`` true)."""
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = word_ids(tokenizer).encode, np.zeros(vocabulary, np.int64)
        for batch in batches:
            whole = [encode(t) + end for t in batch["text"].to_pylist()]
            joined = np.frombuffer(b"".join(whole), "<u4")
            total += np.bincount(joined, minlength=vocabulary)
            raw, size = joined.astype(kind).tobytes(), np.dtype(kind).itemsize
            ends = np.cumsum([len(w) // 4 * size for w in whole]).tolist()
            ids = [raw[i:j] for i, j in zip([0, *ends[:-1]], ends)]
            yield _batch(batch["key"], batch["row"], pa.array(ids, pa.binary()), False)
        yield _batch(pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary()), True)

    return tokenize


def _batch(key: pa.Array, row: pa.Array, ids: pa.Array, counts: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, row, ids, pa.array([counts] * len(ids))], ["key", "row", "ids", "counts"])


def _uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        total = np.sum([np.frombuffer(c, "<i8") for c in pdf["ids"]], axis=0)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})


def _encode(kind: str, rank_of: np.ndarray):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"].to_pylist()
            sizes = np.array([len(i) for i in ids], np.int64) // np.dtype(kind).itemsize
            blocks = []
            texts = encode_texts(rank_of[np.frombuffer(b"".join(ids), kind)], sizes)
            for known, key, n, (control, data) in zip(batch["known"].to_pylist(), batch["key"].to_pylist(), sizes.tolist(), texts):
                blocks.append(struct.pack(_HEAD, known, key, n, len(data)) + control + data)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["value"])

    return encode


def _heads(path: str, content: bytes) -> Iterator[list[tuple[bool, int, int, int, int]]]:
    """Known, key, number of ids, first byte after the head and of the data of each block, some thousand ids at a time."""
    at, size, part, ids = 0, struct.calcsize(_HEAD), [], 0
    while at < len(content):
        known, key, n, data = struct.unpack_from(_HEAD, content, at)
        part.append((known, key, n, at + size, at + size + (n + 3) // 4))
        at, ids = at + size + (n + 3) // 4 + data + 1, ids + n
        if content[at - 1 : at] != b"\n":
            raise ValueError(f"{path}: no block ends at byte {at}")
        if ids >= IDS_TOGETHER:
            yield part, at
            part, ids = [], 0
    if part:
        yield part, at


def _decode(id_of: np.ndarray):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                start = 0
                for part, stop in _heads(path, content):
                    sizes = np.array([n for _, _, n, _, _ in part], np.int64)
                    after = [first - struct.calcsize(_HEAD) - 1 for _, _, _, first, _ in part[1:]] + [stop - 1]
                    control = b"".join([content[first:data] for _, _, _, first, data in part])
                    ranks = decode_texts(control, b"".join([content[data:end] for (_, _, _, _, data), end in zip(part, after)]), sizes)
                    raw, ends = id_of[ranks].astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
                    within = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([path] * len(part)), pa.array([key if known else None for known, key, _, _, _ in part], pa.int64()),
                        pa.array(within), pa.array(sizes), pa.array([raw[i:j] for i, j in zip([0, *ends[:-1]], ends)], pa.binary()),
                    ], ["path", "key", "within", "n_tokens", "ids"])

    return decode


def write_id_files(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", path: str | None = None
) -> str:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of ``key`` (a long; nulls first, repeated
    keys in any order). Null texts have the end id alone. Returns the folder: ``blocks`` and ``ranks``."""
    spark, path = docs.sparkSession, path or work_path(docs.sparkSession, "ids")
    vocabulary = word_ids(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)
    vocabulary = max(vocabulary, end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    text_batches(spark)
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")
    )
    ids_path = work_path(spark, "token-ids")
    columns = "key long, row long, ids binary, counts boolean"
    tokenized = rows.mapInArrow(_tokenize(tokenizer, end_id, kind, vocabulary), columns)
    tokenized.write.option("compression", "zstd").parquet(ids_path)
    written = spark.read.schema(columns).parquet(ids_path)
    ids = written.where("NOT counts").drop("counts")
    # One row per task of the first pass.
    counted = written.where("counts").select("ids").mapInPandas(_uses, "id long, n long")
    counts = counted.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    # At most one row per id of the vocabulary.
    ranked = counts.toPandas()
    unused = np.setdiff1d(np.arange(vocabulary), ranked["id"].to_numpy())
    id_of = np.concatenate([ranked["id"].to_numpy(), unused]).astype(np.uint32)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[id_of] = np.arange(vocabulary, dtype=np.uint32)
    table = pd.DataFrame({"rank": np.arange(vocabulary), "id": id_of.astype(np.int64)})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/ranks")
    files = group_count(int(ranked["n"].sum()), IDS_PER_FILE)
    ordered = ids.repartitionByRange(files, F.col("key").asc_nulls_first(), "row").sortWithinPartitions(F.col("key").asc_nulls_first(), "row")
    known = ordered.select(F.col("key").isNotNull().alias("known"), F.coalesce("key", F.lit(0)).alias("key"), "ids")
    blocks = known.mapInArrow(_encode(kind, rank_of), "value binary")
    blocks.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/blocks")
    return path


def read_id_files(spark: SparkSession, path: str, **columns: Column) -> DataFrame:
    """``key``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit), or instead
    of ``ids`` the named ``columns`` made of them.

    Every file is read once: its rows are stored as asked, and their sums per file give the offsets. Files count in order of
    the number in their names. A folder without blocks gives no rows.
    """
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()  # bounded by the vocabulary
    id_of = ranks["id"].to_numpy().astype(np.uint32)
    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("path", "content")
    docs = files.mapInArrow(_decode(id_of), "path string, key long, within long, n_tokens long, ids binary")
    made = [c.alias(name) for name, c in columns.items()] or [F.col("ids")]
    docs = stored(docs.select(file_number(F.col("path")).alias("file"), "key", "within", "n_tokens", *made), "read-ids")
    # One row per file.
    sizes = docs.groupBy("file").agg(F.max(F.col("within") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = docs.join(offsets, "file")
    return placed.select("key", (F.col("before") + F.col("within")).alias("start"), "n_tokens", *(columns or ["ids"]))


def file_number(path: Column) -> Column:
    """Number of a part file; numbers past 99,999 have more digits, so names do not sort by it."""
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("long")
