"""Repeats, tokenizer alignment and periodic runs against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plantcast.llm import alignment, periodic, repeats
from plantcast.llm.queries import planted_period
from plantcast.llm.shared import stored_by

DOCS = "doc_id long, text string, row long, stretches string, runs int, collapsed string, removed int, kept int, key string, block int, rank int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, 1, "s", 1, "c", 1, 1, "k", 1, 1) for i, t in texts], DOCS).repartition(parts)


# Repeats.


def brute_repeats(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [i for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(t), sum(gone), len(spans), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def found_repeats(df, length):
    rows = repeats.remove_repeats(df, length=length).collect()
    return {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in rows}, rows


@pytest.mark.parametrize("length", [40, 100])
def test_repeats_match_brute_force(spark, length):
    rnd = random.Random(length)
    base = ["".join(rnd.choice("ab" if k % 3 else "abcdé ") for _ in range(rnd.randint(1, 600))) for k in range(12)]
    texts = []
    for _ in range(40):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            b = rnd.choice(base)
            i = rnd.randrange(len(b))
            t += b[i : i + rnd.randint(1, 300)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 20)))
        texts.append(t)
    texts += [texts[5]] * 3 + ["", "a" * 900, "ab" * 300, "a" * (length - 1), "b" * length, "b" * length + "c", texts[7] + "!", "!" + texts[7]]
    found, _ = found_repeats(frame(spark, enumerate(texts)), length)
    expected = brute_repeats([t.encode() for t in texts], length)
    assert found == dict(enumerate(expected))
    assert any(0 < e[1] < e[0] for e in expected)


def test_repeats_of_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(300_000))
    rows = [(None, None), (1, None), (2, ""), (3, long), (3, long), (None, long[1000:3000]), (4, "short")]
    _, out = found_repeats(frame(spark, rows), 400)
    whole = [(r["doc_id"], r["n_bytes"], len(r["kept"])) for r in out]
    assert sorted(whole, key=str) == sorted([(None, 0, 0), (1, 0, 0), (2, 0, 0), (3, 300_000, 0), (3, 300_000, 0), (None, 2000, 0), (4, 5, 5)], key=str)
    assert repeats.remove_repeats(frame(spark, []), length=400).count() == 0
    with pytest.raises(ValueError):
        repeats.Search(8)


def test_a_class_over_many_partitions_has_one_rank(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") + 100).cast("long").alias("a"), F.col("id").alias("row"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repeats.rerank(rows, ["a"], repeats._NUMBERS).collect()
        every = repeats.rerank(rows, ["a"], repeats._NUMBERS, unique=True).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 2000 and len({r["rank"] for r in found}) == 1 and 1 <= sum(r["leader"] for r in found) <= 8
    assert len(every) == 3000 and len({r["rank"] for r in every}) == 1001 and sum(r["many"] for r in every) == 2000


# Alignment.


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.ByteTokens(A).bytes_of


def brute_groups(text, tokenizers):
    a, b, bytes_of = tokenizers
    if not text:
        return None
    ids_a, ids_b, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_of[i] for i in ids_a) != whole or b"".join(pieces) != whole:
        return None
    ends_a, ends_b = list(np.cumsum([len(bytes_of[i]) for i in ids_a])), list(np.cumsum([len(p) for p in pieces]))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
        for x in range(i, k):
            for y in range(j, m):
                if max(ends_a[x - 1] if x else 0, ends_b[y - 1] if y else 0) < min(ends_a[x], ends_b[y]):
                    links.append((ids_a[x], ids_b[y]))
        i, j = k, m
    return len(ids_a), len(ids_b), ";".join(groups), links


ALIGNED = [
    "plain words here, and others.", "a  b", " x", "x ", "a\n \nb c", "▁ q", "", None, "a \t b", "x　y z ﬁ 日本 語 😀😀", "b" * 3000, "q " * 900, "\0", "<|endoftext|> <s> <0x41>",
    "naïve façade " * 30, "한국어 텍스트", "unbelievable internationalisation " * 20, "plain words here, and others.", "don't we'll", "١٢٣ ½ Ⅷ", "\r\n\r\n  indented\n\tcode",
]


def test_byte_tokens_of_both_encoders_are_alike(tokenizers):
    own = alignment.ByteTokens(A)
    assert own.fast is not None and own.lossless
    for text in ALIGNED:
        if text:
            assert own.ids(text).tolist() == tokenizers[0].encode(" " + text, add_special_tokens=False).ids


def test_alignment_matches_brute_force(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "SPAN_BYTES", 50)
    rows = [*enumerate(ALIGNED), (None, "no key"), (3, "x ")]
    docs = frame(spark, rows)
    whole = alignment.align_texts(docs, A, B)
    found = alignment.link_counts(whole).collect()
    each = [(k, brute_groups(t, tokenizers)) for k, t in rows]
    count = Counter(pair for _, e in each if e for pair in e[3])
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    expected = []
    for k, e in each:
        n = (e[0], e[1], e[2].count(";") + 1, len(e[3]), sum(count[p] == highest[p[1]] for p in e[3]), sum(count[p] for p in e[3]), e[2]) if e else (0, 0, 0, 0, 0, 0, "")
        expected.append((None if k is None else str(k), *n))
    got = [(r["key"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert alignment.link_counts(alignment.align_texts(frame(spark, []), A, B)).count() == 0


def test_blocks_do_not_change_counts(spark, monkeypatch):
    texts = [(i, f"word{i % 7} shared words and more {i % 3}") for i in range(60)]
    columns = ["key", "n_links", "n_best", "count_sum"]
    whole = alignment.link_counts(alignment.align_texts(frame(spark, texts, 1), A, B)).select(*columns)
    # Blocks are cut in the Python workers, so one partition per few texts stands for small blocks.
    parts = alignment.link_counts(alignment.align_texts(frame(spark, texts, 12), A, B)).select(*columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def plain_parts(parts):
    return [None if p is None else (*p[:4], sorted(p[4].tolist())) for p in parts]


def test_words_side_by_side_give_what_whole_texts_give(monkeypatch):
    rnd = random.Random(12)
    bits = ["a", "the", "é", "日本", " ", " ", "  ", "\n", " \n ", "\t", "\x1c", "\u180e", "\u2581", "\u00a0", "'s", "12", "?!", "\u0301", "<unk>", "🙂", "\x00"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(600)]
    texts += [None, "", " ", "x" * 3000, "ab " * 900, "ab" * 1200 + " c d"]
    whole, by_word = alignment.Aligner(A, B), alignment.Aligner(A, B)
    whole.by_word = False
    assert by_word.by_word
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "TEXTS_TOGETHER", 20)
    expected = plain_parts(whole.parts(texts))
    assert plain_parts(by_word.parts(texts)) == expected
    assert None in expected and len({str(e) for e in expected}) > 100


def test_words_aligned_before_are_not_tokenized_again(monkeypatch):
    aligner, texts = alignment.Aligner(A, B), ["some words, then others", "others then some words"]
    found = plain_parts(aligner.parts(texts))
    monkeypatch.setattr(aligner, "align", lambda text: pytest.fail(f"aligned again: {text}"))
    assert plain_parts(aligner.parts(texts)) == found
    assert plain_parts(aligner.parts(["then some words, others"]))[0][3].count(";") >= 3


# Periodic runs.


def brute_runs(w):
    out, seen = [], set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q) and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 5, 20])) for _ in range(rnd.randint(0, 160))]
        for _ in range(rnd.randint(0, 3)):
            if len(w) > 5:
                a, p = rnd.randrange(len(w)), rnd.randint(1, 40)
                for i in range(a, min(len(w), a + rnd.randint(1, len(w)))):
                    w[i] = w[a + (i - a) % p]
        assert periodic.periodic_runs(w) == brute_runs(w)


def test_frequency_splits_keep_only_words_that_can_repeat():
    words = np.array([1, 2] * 15 + [99] + [3, 4, 5] * 10 + list(range(100, 140)))
    assert periodic.split_by_frequency(words) == [(0, 30), (31, 61)]
    assert periodic.split_by_frequency(words, depth=0) == [(0, len(words))]


def test_runs_of_long_texts_take_seconds():
    rnd = random.Random(2)
    for words in (["a"] * 300_000, [rnd.randrange(50) for _ in range(300_000)], [rnd.randrange(90_000) for _ in range(100_000)] * 3):
        runs = periodic.periodic_runs(words)
        assert len(runs) < 2 and all(length == 300_000 for _, length, _ in runs)


def test_find_runs_of_odd_rows(spark):
    rows = [(1, "x y " * 12), (1, "x y " * 12), (2, None), (3, " \t\n"), (None, "a " * 30 + "b c d"), (4, "a b c " * 8 + "a b"), (5, "é  é\t" * 12)]
    out = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in periodic.find_runs(frame(spark, rows)).collect()}
    assert out == {
        (1, "x y"): [(0, 24, 2)], (2, ""): [], (3, ""): [], (None, "a b c d"): [(0, 30, 1)], (4, "a b c"): [(0, 26, 3)], (5, "é"): [(0, 24, 1)],
    }
    assert periodic.find_runs(frame(spark, [])).count() == 0


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40)) + "\t ") for i in range(300)] + [(None, "a b"), (7000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", planted_period(F.col("doc_id"), F.col("text"))).collect()}
    import zlib

    for i, text in rows:
        h = zlib.crc32(str(i).encode())
        if i is None or text is None or h % 10 or not text.split():
            assert got[i] == text
            continue
        w, g = text.split(), h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert got[i] == " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(len(w)))


def best_run(runs):
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_texts_that_go_on_are_sorted_once_with_their_first_stretches(spark, monkeypatch):
    from plantcast.llm import repeats

    joined, texts_with = [], repeats._texts_with
    monkeypatch.setattr(repeats, "_texts_with", lambda texts, stretches: joined.append(texts) or texts_with(texts, stretches))
    text = " ".join(f"word{i}" for i in range(40)).encode()
    rows = [(0, text), (1, b"other " + text), (2, b"short")]
    table = spark.createDataFrame(rows, "row long, text binary").coalesce(1)
    found, near = repeats.repeated_windows(table, table.select("row").where("false"), 40)
    assert joined[0] is table and sorted(r.row for r in near.collect()) == [0, 1] and near.columns == ["row", "text"]
    assert {r.row for r in found.collect()} == {0, 1}


def test_texts_in_buckets_are_not_shuffled_again(spark):
    texts = spark.createDataFrame([(i, b"text %d" % i) for i in range(40)], "row long, text binary")
    table = stored_by(texts, "row", 6, "bucketed")
    stretches = spark.createDataFrame([(i, 0, i) for i in range(0, 40, 3)], "row long, lo long, hi long")
    beside = repeats._texts_with(table, stretches)
    assert sorted((r.row, bytes(r.text), len(r.stretches)) for r in beside.collect()) == [(i, b"text %d" % i, 1) for i in range(0, 40, 3)]
    plan = beside._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SelectedBucketsCount: 6 out of 6" in plan and plan.count("Exchange hashpartitioning") == 1
    # The same buckets again cost no shuffle of the texts either.
    near = stored_by(beside, "row", 6, "bucketed-again")
    assert near.count() == 14 and sorted(r.row for r in near.select("row").collect()) == list(range(0, 40, 3))
