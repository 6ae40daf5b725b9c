"""SimHash near-duplicates, compared with bit planes.

A fingerprint has one bit for each bit position that is set in more than half of a text's shingle hashes. Two
fingerprints link at a few differing bits. Five bit ranges can't all differ when at most three bits do, so a pair
within the radius agrees in two of them: every choice of two ranges is a table of buckets.
Within buckets, bit plane ``j`` holds bit ``j`` of all fingerprints side by side as one big integer. A plane XOR
itself shifted by ``s`` lanes compares every fingerprint with the one ``s`` places on, and two-bit carry-save
counters with an overflow plane add up all these distances at once. Lanes that pass the radius stay in the
overflow plane; once it covers all lanes of a block the remaining planes are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantcast.llm.components import smallest_keys
from plantcast.llm.shared import SALTS, group_count, salted_lookup, stored, text_batches

BITS = 64
SEED = 42
SHINGLES_AT_ONCE = 1 << 16
# Lanes of one block, and the most members of a bucket that are compared as one block.
LANES = 4096
MEMBERS = 2048
ENTRIES_PER_GROUP = 40_000


def text_fingerprint(text: str | None, shingle: int) -> int:
    """Fingerprint of one text as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        spans = zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint as a long with the same 64 bits. Null and blank texts have 0."""

    @F.pandas_udf("long")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            marks = np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(marks.view(np.int64))

    return of_texts(text)


def fingerprint_hex(mark: Column) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def bucket_masks(radius: int) -> list[int]:
    """One mask for each choice of two of ``radius + 2`` bit ranges, as signed longs."""
    edges = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [int(np.array([x | y], np.uint64).view(np.int64)[0]) for x, y in combinations(ranges, 2)]


def _planes(marks: np.ndarray) -> list[int]:
    bits = np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]


def _as_int(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def within(planes: list[int], lanes: int, shift: int, radius: int) -> int:
    """Lanes ``i`` of ``lanes`` whose fingerprint is at most ``radius`` <= 3 bits from that of lane ``i + shift``."""
    low = high = over = 0
    for plane in planes:
        carry = plane ^ (plane >> shift)
        low, carry = low ^ carry, low & carry
        high, carry = high ^ carry, high & carry
        over |= carry
        if over & lanes == lanes:
            return 0
    near = lanes & ~over
    if radius < 3:
        near &= ~(high & low) if radius == 2 else ~high if radius == 1 else ~(high | low)
    return near


def block_links(marks: np.ndarray, bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of linked pairs in one block sorted by bucket: enough of them to connect all that link, since lanes
    whose two sides are connected already are not compared again."""
    planes, n = _planes(marks), len(marks)
    group, found = np.arange(n), []
    for shift in range(1, n):
        alike = bucket[shift:] == bucket[:-shift]
        if not alike.any():
            break
        lanes = alike & (group[shift:] != group[:-shift])
        if not lanes.any():
            continue
        near = within(planes, _as_int(lanes), shift, radius)
        if near:
            size = (n + 7) // 8
            flags = np.unpackbits(np.frombuffer(near.to_bytes(size, "little"), np.uint8), bitorder="little")
            for i in np.flatnonzero(flags).tolist():
                a, b = group[i], group[i + shift]
                if a != b:
                    group[group == max(a, b)] = min(a, b)
                    found.append((i, i + shift))
    return found


def _compare(radius: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "key", "i", "j", "mark"], kind="stable")
        marks = pdf["mark"].to_numpy().view(np.uint64)
        same = np.ones(len(pdf), bool)
        for c in ("t", "key", "i", "j"):
            values = pdf[c].to_numpy()
            same[1:] &= values[1:] == values[:-1]
        same[0] = False
        bucket = np.cumsum(~same)
        starts = np.flatnonzero(~same)
        left, right, at = [], [], 0
        while at < len(pdf):
            # Whole buckets only; one bucket has at most 2 * MEMBERS rows.
            end = starts[np.searchsorted(starts, at + LANES, "right") - 1] if at + LANES < len(pdf) else len(pdf)
            if end <= at:
                end = starts[np.searchsorted(starts, at, "right")] if starts[-1] > at else len(pdf)
            for i, j in block_links(marks[at:end], bucket[at:end], radius):
                left.append(at + i)
                right.append(at + j)
            at = int(end)
        values = pdf["mark"].to_numpy()
        return pd.DataFrame({"a": values[left], "b": values[right]})

    return compare


def mark_links(marks: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most ``radius`` bits apart, enough to connect all that link.

    ``marks`` has one row per fingerprint in column ``mark``. Buckets beyond ``MEMBERS`` are cut into parts, and each
    two parts meet in one task, so no bucket is handled whole by one task.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the two-bit counters hold distances up to 3")
    tables = [F.struct(F.lit(t).alias("t"), F.col("mark").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(bucket_masks(radius))]
    entries = marks.select("mark", F.explode(F.array(*tables)).alias("e")).select("e.t", "e.key", "mark")
    sizes = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEMBERS)
    parts = stored(sizes.select("t", "key", F.ceil(F.col("n") / F.lit(MEMBERS / 2)).cast("int").alias("parts")), "buckets")
    count = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("mark", F.lit(1)), count).cast("int")
    placed = entries.join(parts, ["t", "key"], "left").withColumns({"_own": own, "_n": count})
    meets = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda k: F.struct(F.least(k, F.col("_own")).alias("i"), F.greatest(k, F.col("_own")).alias("j")),
    )
    dealt = placed.select("t", "key", "mark", F.explode(meets).alias("p")).select("t", "key", "p.i", "p.j", "mark")
    groups = group_count(marks.count() * len(tables), ENTRIES_PER_GROUP)
    grouped = dealt.groupBy(F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(groups)).alias("g"))
    return grouped.applyInPandas(_compare(radius), "a long, b long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Per row of ``docs``: ``key``, ``mark`` (fingerprint as a long) and ``component_id``, the smallest key reachable over
    fingerprints at most ``radius`` bits apart.

    Equal fingerprints are one node, whatever the number of rows. Rows without words have fingerprint 0 and link
    like any other. Repeated rows stay. Rows with a null key take part; a component of only such rows has id null.
    """
    text_batches(docs.sparkSession)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    rows = docs.select(F.col(key).alias("_key"), fingerprint(F.col(text), shingle).alias("mark"), salt.alias("salt"))
    marked = stored(rows, "marks")
    return _with_components(marked, radius).select(F.col("_key").alias(key), "mark", "component_id")


def _with_components(marked: DataFrame, radius: int) -> DataFrame:
    """``marked`` (``_key``, ``mark``, ``salt``; written, so that salts are fixed) with ``component_id``."""
    nodes = stored(marked.groupBy(F.col("mark").alias("node")).agg(F.min("_key").alias("first")), "fingerprints")
    pairs = mark_links(nodes.select(F.col("node").alias("mark")), radius)
    table = smallest_keys(nodes, pairs).withColumnRenamed("node", "mark")
    return salted_lookup(marked, table, "mark", F.col("salt"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group left: the one with the smallest key, nulls last, ties by a hash of the row.

    Rows equal in all columns are one row as far as the choice goes, and one of them stays. The rows to drop are a
    written table of keys, so texts are shuffled only where that table is too large to broadcast.
    """
    columns = [F.col(c) for c in docs.columns]
    own = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(*columns).alias("h"), F.hash(*columns).alias("g"))
    keyed = docs.select(F.struct(*columns).alias("doc"), own.alias("own"))
    text_batches(docs.sparkSession)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    marked = stored(keyed.select(F.col("own").alias("_key"), fingerprint(F.col(f"doc.{text}"), shingle).alias("mark"), salt.alias("salt")), "marks")
    found = _with_components(marked, radius)
    chosen = F.col("_key").eqNullSafe(F.col("component_id"))
    sizes = found.groupBy(F.col("_key").alias("at"), chosen.alias("chosen")).agg(F.count(F.lit(1)).alias("rows"))
    affected = stored(sizes.where(~F.col("chosen") | (F.col("rows") > 1)).select("at", "chosen"), "affected")
    # Only groups with several rows are in the table; all others pass.
    placed = keyed.join(affected, F.col("own").eqNullSafe(F.col("at")), "left")
    single = placed.where(F.col("chosen").isNull()).select("doc")
    repeated = placed.where(F.col("chosen")).select("own", "doc").dropDuplicates(["own"]).select("doc")
    return single.union(repeated).select("doc.*")
