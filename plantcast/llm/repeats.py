"""Repeated byte strings, found by prefix doubling over sorted position ranks.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Prefix doubling ranks positions by
their first bytes, sorts pairs of ranks at growing offsets, ranks again, and drops a position once its rank is unique:

* Positions are chosen by content, so that equal strings choose alike: each window of ``length`` bytes is led by the
  position with the smallest hash in its first half. A lead stands for a stretch of neighbouring windows.
* Leads start with the rank of their first eighth of ``length``. Pairs of this rank and that of the bytes at the offset give
  the rank of the first quarter and, at twice the offset, of the first half. Each ranking is one distributed sort with the
  position as the last key, so the rows of a frequent string are spread over many partitions; what sorts next to no equal
  is dropped. Positions between leads are not sorted: the rank at an offset is the digest of the bytes there.
* A stretch whose whole content occurs again consists of repeated windows. In the other stretches leads are chosen again
  from a twentieth of the length and compared by all bytes behind them, then window by window up to the threshold.

Ranks of the first rounds come from 64-bit digests and only drop positions; what decides compares 128-bit digests.
Texts that occur more than once in full are searched once and removed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm.shared import salted_lookup, stored, stored_by, text_batches

LENGTH = 400
GRAM = 8
# Windows looked at together.
CHUNK = 1 << 18
# Sorted rows numbered together.
SORTED_ROWS = 1 << 16
# Buckets of texts for each partition of the input, which Spark cuts by size.
BUCKETS = 2
_NUMBERS = {"row": "long", "lo": "long", "hi": "long"}


def _gram_keys(data: np.ndarray, at: int, n: int, gram: int) -> np.ndarray:
    """For ``n`` positions from ``at`` on: hash of the gram there in the high half, distance from ``at`` in the low half."""
    held = data[at : at + n + gram - 1]
    held = np.concatenate((held, np.zeros(n + gram - 1 - len(held), np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(gram):
        key |= held[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    key *= np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)


def _least_ahead(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` keys from each place on (fewer at the end)."""
    least, span = key, 1
    while span < width:
        step = min(span, width - span)
        wider = least.copy()
        np.minimum(least[:-step], least[step:], out=wider[:-step])
        least, span = wider, span + step
    return least


def leads(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Leads of all windows that start in the stretches ``lo``..``hi`` (inclusive, ascending, apart): position, first and
    last window, and index of the stretch. The lead of a window is the leftmost smallest gram of its first ``width`` bytes."""
    parts = []
    for at in range(int(lo[0]), int(hi[-1]) + 1, CHUNK):
        a, b = np.searchsorted(hi, at), np.searchsorted(lo, at + CHUNK)
        if a == b:
            continue
        first, last = np.maximum(lo[a:b], at), np.minimum(hi[a:b], at + CHUNK - 1)
        size = last - first + 1
        window = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        stretch = np.repeat(np.arange(a, b), size)
        start, stop = int(first[0]), int(last[-1])
        least = _least_ahead(_gram_keys(data, start, stop - start + width, gram), width)[window - start]
        lead = start + (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]) | (stretch[1:] != stretch[:-1]))))
        parts.append((lead[new], window[new], window[np.append(new[1:], len(window)) - 1], stretch[new]))
    lead, first, last, stretch = (np.concatenate(p) for p in zip(*parts))
    # A lead whose windows lie in two chunks.
    new = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]) | (stretch[1:] != stretch[:-1]))))
    return lead[new], first[new], last[np.append(new[1:], len(lead)) - 1], stretch[new]


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of the stretches as two columns of longs."""
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


class _Batch:
    """Texts of a batch side by side, with the stretches of windows to look at."""

    def __init__(self, rows, texts, stretches, length: int):
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin, self.rows = np.cumsum(sizes) - sizes, np.array(rows, np.int64)
        if stretches is None:
            self.owner = np.flatnonzero(sizes >= length)
            self.lo, self.hi = self.begin[self.owner], (self.begin + sizes - length)[self.owner]
        else:
            self.owner = np.repeat(np.arange(len(texts)), [len(s) for s in stretches])
            flat = [(s["lo"], s["hi"]) for of_text in stretches for s in of_text]
            found = np.array(flat, np.int64).reshape(-1, 2) + self.begin[self.owner][:, None]
            self.lo, self.hi = found[:, 0], found[:, 1]

    def leads(self, width: int, gram: int):
        at, first, last, stretch = leads(self.data, self.lo, self.hi, width, gram)
        owner = self.owner[stretch]
        return at, first, last, self.rows[owner], self.begin[owner]


class Search:
    """Sizes of the rounds for one threshold."""

    def __init__(self, length: int):
        if length < 2 * GRAM:
            raise ValueError(f"strings of fewer than {2 * GRAM} bytes are not searched")
        self.length, self.width, self.fine = length, length // 2, max(1, length // 20)
        self.part = (length - self.width) // 4

    def _each(self, batches: Iterator[pd.DataFrame], emit) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stretches = list(pdf["stretches"]) if "stretches" in pdf else None
            batch = _Batch(pdf["row"], list(pdf["text"]), stretches, self.length)
            if len(batch.lo):
                yield emit(batch)

    def first_ranks(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Digest of the first part behind each lead of all windows."""

        def emit(batch: _Batch) -> pd.DataFrame:
            at, first, last, row, begin = batch.leads(self.width, GRAM)
            rank = _digests(batch.raw, at, at + self.part)[:, 0]
            return pd.DataFrame({"a": rank, "row": row, "lo": first - begin, "hi": last - begin})

        return self._each(batches, emit)

    def next_ranks(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ranks at the lead (a) and at the offsets of one part (b) and two parts (e, of double length), and the content of
        the stretch (c, d)."""

        def emit(batch: _Batch) -> pd.DataFrame:
            at, first, last, row, begin = batch.leads(self.width, GRAM)
            whole = _digests(batch.raw, first, last + self.length)
            a, b, e = (
                _digests(batch.raw, at + i * self.part, at + j * self.part)[:, 0] for i, j in ((0, 1), (1, 2), (2, 4))
            )
            return pd.DataFrame({
                "a": a, "b": b, "e": e, "row": row, "lo": first - begin, "hi": last - begin, "c": whole[:, 0], "d": whole[:, 1],
            })

        return self._each(batches, emit)

    def fine_ranks(self, width: int):
        """All bytes that the windows of a lead share, as (a, b), and the content of the stretch as (c, d)."""

        def fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def emit(batch: _Batch) -> pd.DataFrame:
                at, first, last, row, begin = batch.leads(width, min(GRAM, self.length - width + 1))
                shared, whole = _digests(batch.raw, at, at + self.length - width), _digests(batch.raw, first, last + self.length)
                return pd.DataFrame({
                    "a": shared[:, 0], "b": shared[:, 1], "row": row, "lo": first - begin, "hi": last - begin,
                    "c": whole[:, 0], "d": whole[:, 1],
                })

            return self._each(batches, emit)

        return fine


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches joined to tables of at least ``SORTED_ROWS`` rows, but for the last."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= SORTED_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _number(keys: list[str], kept: list[str], unique: bool):
    """Numbers the classes of equal keys of sorted rows. The first and the last class of a partition may go on in the
    next one, so each gets a row of its own with its keys and its size (``size`` is 0 in all others)."""
    others = [k for k in keys if k not in kept]

    def frame(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        names = [*kept, *others, "rank", "many", "leader", "size"]
        return pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, held_new, last = TaskContext.get().partitionId() << 40, None, True, 0
        first_keys, first_size, last_size = None, 0, 0
        names = list(dict.fromkeys([*kept, *keys]))
        for table in _tables(batches):
            rows = {n: table[n].to_numpy() for n in names}
            if held is None:
                first_keys = {k: rows[k][:1] for k in keys}
            else:
                rows = {n: np.concatenate((held[n], rows[n])) for n in names}
            differ = np.zeros(len(rows["row"]) - 1, bool)
            for k in keys:
                differ |= rows[k][1:] != rows[k][:-1]
            new = np.concatenate(([held_new], differ))
            rank = last + np.concatenate(([0], np.cumsum(differ)))
            # The last row waits for the next table, which tells whether it is alone.
            first_size += int((rank[:-1] == 0).sum())
            last_size = int((rank[:-1] == rank[-1]).sum()) + (last_size if rank[-1] == last else 0)
            alone = new[:-1] & differ
            keep = np.ones(len(alone), bool) if unique else ~alone | (rank[:-1] == 0)
            n, zeros = int(keep.sum()), np.zeros(int(keep.sum()), np.int64)
            held, held_new, last = {n: rows[n][-1:] for n in names}, bool(new[-1]), int(rank[-1])
            if n:
                out = {c: rows[c][:-1][keep] for c in kept} | {k: zeros for k in others}
                yield frame(out | {"rank": base + rank[:-1][keep], "many": ~alone[keep], "leader": new[:-1][keep], "size": zeros})
        if held is None:
            return
        one = np.zeros(1, np.int64)
        blank = {c: one for c in [*kept, *others]}
        new = np.array([held_new])
        yield frame(blank | {c: held[c] for c in kept} | {"rank": one + base + last, "many": ~new, "leader": new, "size": one})
        ends = [(first_keys, base, first_size + (last == 0))]
        if last:
            ends.append(({k: held[k] for k in keys}, base + last, last_size + 1))
        no = np.array([False])
        for values, rank, size in ends:
            yield frame(blank | values | {"rank": one + rank, "many": no, "leader": no, "size": one + size})

    return number


def rerank(rows: DataFrame, keys: list[str], kept: dict[str, str], unique: bool = False, rank: str = "rank") -> DataFrame:
    """Sorts the rows by ``keys`` (longs) and position and gives rows of equal keys the same number, and others another, in
    a column named by ``rank``.

    Rows whose keys no other row has are dropped, or kept with ``many`` false if ``unique``. One row of each class (or a few,
    where a class spans partitions) is its ``leader``. The numbers are stored.
    """
    named = {f"key_{i}": F.col(k) for i, k in enumerate(keys)}
    schema = {**kept, **{k: "long" for k in named}, "rank": "long", "many": "boolean", "leader": "boolean", "size": "long"}
    order = [*named, "row", "lo"]
    ordered = rows.select(*kept, *[c.alias(k) for k, c in named.items()]).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ordered.mapInArrow(_number(list(named), list(kept), unique), ", ".join(f"{c} {t}" for c, t in schema.items()))
    numbered = stored(numbered, "ranks", compression="zstd")
    # At most two rows per partition: the classes at its ends.
    ends = numbered.where("size > 0").groupBy(*named).agg(F.min("rank").alias("to"), F.sum("size").alias("total"), F.collect_list("rank").alias("from"))
    moved = ends.select(F.explode("from").alias("rank"), "to", "total")
    whole = numbered.where("size = 0").join(F.broadcast(moved), "rank", "left")
    many = F.coalesce(F.col("total") > 1, "many")
    out = whole.select(*kept, F.coalesce("to", "rank").alias(rank), many.alias("many"), "leader")
    return out if unique else out.where("many")


def _texts_with(texts: DataFrame, stretches: DataFrame) -> DataFrame:
    """Texts that have stretches, beside them. The texts lie in buckets of their row numbers, so only the stretches are shuffled."""
    per_text = stretches.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("stretches"))
    return texts.join(stored(per_text, "stretches").hint("merge"), "row")


def _schema(columns: str) -> str:
    return ", ".join(f"{c} long" for c in columns.split())


def repeated_windows(table: DataFrame, copies: DataFrame, length: int = LENGTH, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Stretches ``lo``..``hi`` (inclusive) of starts of windows that occur elsewhere, by ``row`` number, and the rows of
    ``table`` that may have some. ``copies`` are the rows that repeat a whole earlier text; they are left out.

    ``table`` may lie in as many ``buckets`` of row numbers. Texts whose first ranks are all unique are done after the first round. The others
    are stored once, in buckets too, beside their stretches of the first round, so the later rounds read only these.
    """
    search, place = Search(length), dict(_NUMBERS)
    first = table.select("row", "text").join(copies, "row", "left_anti").mapInPandas(search.first_ranks, _schema("a row lo hi"))
    found = rerank(first, ["a"], place)
    near = stored_by(_texts_with(table, found), "row", buckets, "near-texts", compression="zstd")
    texts = near.select("row", "text")
    content = {"c": "long", "d": "long"}
    pairs = near.select("row", "text", "stretches").mapInPandas(search.next_ranks, _schema("a b e row lo hi c d"))
    quarter = rerank(pairs, ["a", "b"], place | {"e": "long"} | content).drop("many", "leader")
    done, left = _judged(rerank(quarter, ["rank", "e"], place | content, rank="half"), place, "half")
    closer = _texts_with(texts, left).mapInPandas(search.fine_ranks(search.fine), _schema("a b row lo hi c d"))
    closer_done, left = _judged(rerank(closer, ["a", "b"], place | content), place, "rank")
    single = _texts_with(texts, left).mapInPandas(search.fine_ranks(1), _schema("a b row lo hi c d"))
    equal = rerank(single, ["c", "d"], place).select(*place)
    return done.unionByName(closer_done).unionByName(equal), near.drop("stretches")


def _judged(ranked: DataFrame, place: dict[str, str], rank: str) -> tuple[DataFrame, DataFrame]:
    """Stretches whose whole content (c, d) occurs again, and those to look at closer: the others, with one stretch of each
    content that may hold windows of the others, since it has the same rank."""
    named = ranked.withColumnRenamed(rank, "prefix").drop("many", "leader")
    judged = rerank(named, ["c", "d"], place | {"prefix": "long"}, unique=True)
    apart = judged.where("not many")
    beside = judged.where("many and leader").join(apart.select("prefix").distinct(), "prefix", "left_semi")
    return judged.where("many").select(*place), apart.select(*place).unionByName(beside.select(*place))


def _merged(stretches, length: int) -> list[tuple[int, int]]:
    """Byte spans (end exclusive) covered by windows that start in the sorted stretches; touching ones are one."""
    spans: list[list[int]] = []
    for s in stretches:
        a, b = s["lo"], s["hi"] + length
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _cut(length: int):
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, stretches in batches:
            rows = []
            for raw, of_text in zip(texts, stretches):
                spans, parts, at = _merged(of_text, length), [], 0
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                rows.append(([{"start": a, "end": b} for a, b in spans], b"".join(parts) + raw[at:]))
            yield pd.DataFrame(rows, columns=["removed", "kept"])

    return cut


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``removed`` (spans of bytes, end exclusive) and ``kept`` (the other bytes).

    Strings are judged on the input, so every copy goes. Null texts count as empty, texts shorter than ``length`` stay
    whole, repeated rows are copies of each other, keys are not looked at. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key), F.monotonically_increasing_id().alias("row"), raw.alias("text"))
    rows = rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "digest": F.unhex(F.md5("text"))})
    buckets = BUCKETS * max(1, docs.rdd.getNumPartitions())
    table = stored_by(rows, "row", buckets, "texts", compression="zstd")
    long = table.where(F.col("n_bytes") >= length)
    groups = long.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    copied = salted_lookup(long.select("row", "digest"), groups, "digest", F.col("row")).where("first is not null")
    copied = stored(copied.select("row", (F.col("row") == F.col("first")).alias("is_first")), "copies")
    later = copied.where("not is_first").select("row")
    windows, near = repeated_windows(table, later, length, buckets)
    windows = stored(windows.join(copied, "row", "left_anti"), "windows")
    span = "array<struct<start: long, end: long>>"
    cut = F.pandas_udf(_cut(length), f"removed {span}, kept binary")
    touched = _texts_with(near, windows).withColumn("cut", cut("text", "stretches")).select(key, "n_bytes", "cut.removed", "cut.kept")
    whole_span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).cast(span)
    whole = table.join(copied, "row", "left_semi").select(key, "n_bytes", whole_span.alias("removed"), F.lit(b"").alias("kept"))
    found = stored(windows.select("row").unionByName(copied.select("row")).distinct(), "rows")
    clean = table.join(found, "row", "left_anti").select(key, "n_bytes", F.array().cast(span).alias("removed"), F.col("text").alias("kept"))
    return clean.unionByName(whole).unionByName(touched)
