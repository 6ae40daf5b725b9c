"""Bounded memory, long texts, odd bytes, full formats, vectors of several lengths, and samples that depend on rows alone."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plantcast.llm import id_files, neighbours, pii, secrets, tokens, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


# Word tables.


def test_word_table_is_bounded_in_bytes_and_ids_do_not_depend_on_it(monkeypatch):
    library = tokens.WordIds(PATH)._library
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(300)) + " the and " for _ in range(60)]
    texts += ["日本語の文章" * 300, "A" * 5000 + "=", "x" * 64 + " " + "y" * 65, "the and the"]
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    ids = tokens.WordIds(PATH)
    for text in texts * 2:
        assert ids.encode(text.encode()) == library(text)
        assert len(ids._words) <= 500 + 305 and all(len(w) <= tokens.LONGEST for w in [*ids._words, *ids._older])
    monkeypatch.setattr(tokens, "REMEMBERED", 10**9)
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 50_000)
    ids = tokens.WordIds(PATH)
    for text in texts:
        assert ids.encode(text.encode()) == library(text)
        assert ids._bytes <= 50_000


def test_bytes_that_are_no_utf8_do_not_fail():
    raw = b"plain \xff\xfe words \xc3( token=abcdefghijklmnop\xff"
    assert tokens.WordIds(PATH).encode(raw)
    base, spans = secrets.scan_text(raw, {})
    assert base == spans != "" and secrets.redacted(raw, {}).endswith("[secret]�")
    assert toxicity.word_features(b"ab\xffcd")


# Files of ids.


def test_files_count_by_number(spark):
    names = [f"file:/x/blocks/part-{n}-u-c000.txt" for n in ("00002", "99999", "100000")]
    got = spark.createDataFrame([(n,) for n in names], "path string").select(id_files.file_number(F.col("path")).alias("n")).collect()
    assert [r["n"] for r in got] == [2, 99_999, 100_000]


def test_texts_are_coded_together_as_one_by_one():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 4, 5, 0, 3, 1000, 0, 7])
    ranks = rng.integers(0, 1 << 26, sizes.sum()).astype(np.uint32) >> rng.integers(0, 26, sizes.sum()).astype(np.uint32)
    coded, at = id_files.encode_texts(ranks, sizes), 0
    for (control, data), n in zip(coded, sizes.tolist()):
        assert len(control) == (n + 3) // 4 and id_files.decode_ranks(control, data, n).tolist() == ranks[at : at + n].tolist()
        at += n
    whole = id_files.decode_texts(b"".join(c for c, _ in coded), b"".join(d for _, d in coded), sizes)
    assert whole.tolist() == ranks.tolist()


def test_long_files_are_decoded_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words " * (i % 9)) for i in range(200)], "doc_id long, text string").repartition(4)
    path = id_files.write_id_files(docs, PATH, 1)
    whole = {r["key"]: (r["start"], r["n_tokens"], bytes(r["ids"])) for r in id_files.read_id_files(spark, path).collect()}
    content = b"".join(bytes(r["value"]) + b"\n" for r in spark.read.option("lineSep", "\n").text(f"{path}/blocks").select(F.col("value").cast("binary").alias("value")).collect())
    assert len(whole) == 200 and content
    at = 0
    for i in range(200):
        assert whole[i][0] == at
        at += whole[i][1]
    slim = id_files.read_id_files(spark, path, check=F.crc32("ids"))
    assert slim.columns == ["key", "start", "n_tokens", "check"]


# Secrets.


def brute_candidates(raw, base):
    spans, at = [], 0
    allowed = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while at < len(raw):
        end = at
        while end < len(raw) and raw[end] in allowed:
            end += 1
        if end - at >= secrets.CANDIDATE_LENGTH and not any(at < e and s < end for s, e, *_ in base):
            spans.append((at, end, raw[at:end]))
        at = max(end, at + 1)
    return spans


def test_every_token_is_a_candidate_and_added_by_likelihood_alone():
    rnd = random.Random(4)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(32)) for _ in range(150)]
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(12, 16))) for _ in range(150)]
    models = secrets.learn([("hex", h) for h in hexes] + [("word", w) for w in words])
    for _ in range(80):
        parts = [rnd.choice([rnd.choice(hexes), rnd.choice(words), "token=" + rnd.choice(hexes), "AKIA" + "Q7" * 8, "plain", "A" * 12, "0" * 13]) for _ in range(rnd.randint(0, 12))]
        raw = rnd.choice([" ", ",", ":"]).join(parts).encode()
        base = secrets.base_matches(raw)
        assert list(secrets.candidates(raw, base)) == brute_candidates(raw, base)
        added = [f"format:{s}:{e}" for s, e, t in brute_candidates(raw, base) if any(secrets.likelihood(m, secrets.symbols(t)) >= least for m, least in models.values())]
        assert [x for x in secrets.scan_text(raw, models)[1].split(",") if x.startswith("format")] == added
    for w in words:
        assert secrets.scan_text(w.encode(), models) == ("", "")


def test_many_finds_in_a_long_text_take_seconds():
    rnd = random.Random(5)
    raw = b" ".join(b"%020x some-token-x%d" % (rnd.getrandbits(80), i) for i in range(100_000))
    start = time.monotonic()
    base, spans = secrets.scan_text(raw, {})
    assert len(raw) > 4_000_000 and base == spans and base.count(",") > 90_000
    assert time.monotonic() - start < 60


def test_sampled_credentials_are_those_of_lowest_hash(spark, monkeypatch):
    rows = [(i, f"token={i:016d}abc and internationalword{'abcdefghij'[i % 10]}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = secrets.labelled_secrets(docs, sample=20)
    every = sorted({f"{i:016d}abc" for i in range(400)}, key=lambda s: secrets._draw("assign", s.encode()))
    assert {s for k, s in got if k == "assign"} == set(every[:20])
    assert {s for k, s in got if k == "word"} == {f"internationalword{c}" for c in "abcdefghij"}


# Surrogates.


def test_permuted_addresses_stay_distinct_and_of_their_network():
    every = {pii.surrogate(b"k", "ip", f"192.168.{a}.{b}", pii.PERMUTED) for a in range(256) for b in range(256)}
    assert len(every) == 1 << 16 and all(e.startswith("192.168.") for e in every)
    some = [pii.surrogate(b"k", "ip", f"8.{a}.{b}.1", pii.PERMUTED) for a in range(60) for b in range(60)]
    assert len(set(some)) == 3600 and not any(s.startswith(("10.", "127.", "192.168.")) for s in some)
    assert pii.canonical("008.8.8.08", "ip") == "8.8.8.8"


def test_a_used_up_network_is_permuted_and_fails_nothing(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_DRAWS", 1)
    text = " ".join(f"192.168.{a}.{b}" for a in range(40) for b in range(256)) + " 8.8.8.8 ann.lee@corp.example.org"
    out = pii.replace_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"k").first()
    assert out["n_entities"] == 10_242 and len(set(out["text"].split())) == 10_242
    assert sum(w.startswith("192.168.") for w in out["text"].split()) == 10_240


def test_many_entities_in_a_long_text_take_seconds():
    start = time.monotonic()
    assert len(pii.find_entities(" ".join(f"user{i}@mail{i}.example.org" for i in range(30_000)))) == 30_000
    names = " ".join("Mr. N" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + " said" for i in range(10_000))
    assert len(pii.find_entities(names)) == 10_000
    assert time.monotonic() - start < 30


# Toxicity.


def test_sample_has_one_row_per_key_and_does_not_depend_on_order(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(500)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 60, i % 2) for i in range(240)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    one = sorted(map(tuple, toxicity.labelled_sample(docs.repartition(5), labels, rows=30).collect()))
    two = sorted(map(tuple, toxicity.labelled_sample(docs.repartition(3, "text"), labels.repartition(4), rows=30).collect()))
    assert one == two and len(one) <= 30
    assert toxicity.labelled_sample(docs.where("false"), labels).count() == 0
    extra = docs.withColumns({"toxic": F.lit(5), "_key": F.lit("k")})
    assert toxicity.labelled_sample(extra, labels.withColumn("text", F.lit("t")), rows=30).columns == ["text", "toxic"]


# Vectors of several lengths.


def test_each_length_has_answers_of_its_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).astype(float).tolist()) for i in range(120)] + [(150, [1.0, 2.0]), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows if v}
    for q in [i for i in vectors if i % 10 == 0]:
        others = [i for i in vectors if i != q and len(vectors[i]) == len(vectors[q])]
        cosine = {i: float(vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i])) for i in others}
        expected = sorted(others, key=lambda i: (-cosine[i], i))[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [v for _, v, _ in got] == expected
        assert [s for _, _, s in got] == pytest.approx([cosine[i] for i in expected])


def test_words_are_learned_with_one_handle_of_the_model(monkeypatch):
    ids, text = tokens.WordIds(PATH), "Plain words, ÉTÉ... naïve; ſtrange K. 12,3 it's <|endoftext|> !? ñ%%%"
    expected = ids._library(text)
    handle = ids.tokenizer

    class WithoutModel:
        encode = handle.encode

    monkeypatch.setattr(ids, "tokenizer", WithoutModel())
    assert ids.encode(text.encode()) == expected
