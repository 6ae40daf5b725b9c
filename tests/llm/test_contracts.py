"""The registered queries themselves: columns, types and values against brute force on the smallest folder."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.conftest import FOLDER
from tests.llm.test_alignment_runs_repeats import best_run, brute_groups, brute_repeats, brute_runs, sha, tokenizers  # noqa: F401

TYPES = {
    "op1_warc_segments": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_mix_sources_by_weight": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_lattice_near_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_nn_descent_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_secret_grammar_inference": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_pack_first_fit_decreasing": {
        "doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_simhash_bit_sliced": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_frequency_ranked_ids": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11_prefix_doubling_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op12_tokenizer_alignment": {
        "doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op13_periodic_runs": {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string",
        "collapsed_sha256": "string"},
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in TYPES[name]} == TYPES[name]
    return df.select(*TYPES[name]).collect()


@pytest.fixture(scope="module")
def word_ids():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3(spark, texts):
    rows = run(spark, "op3_mix_sources_by_weight")
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6 for r in rows)
    targets = {(r["source_size"], r["target"]) for r in rows}
    assert sum(t for _, t in targets) == pytest.approx(sum(r["size"] for r in rows))


def test_op4_op5(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    usable = [r for r in rows if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    x = np.array([r["embedding"] for r in usable], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine, ids, labels = unit @ unit.T, np.array([r["vec_id"] for r in usable]), [r["label"] for r in usable]
    same = np.array([[a is not None and a == b for b in labels] for a in labels]) & ~np.eye(len(ids), dtype=bool)
    links = dict(zip(ids.tolist(), ((cosine >= 0.98) & same).sum(axis=1).tolist()))
    for r in run(spark, "op4_lattice_near_vectors"):
        assert r["n_links"] == links.get(r["vec_id"], 0) and r["kept"] == (r["vec_id"] == r["component_id"])
    np.fill_diagonal(cosine, -2)
    hits = total = 0
    found = Counter()
    place = {v: i for i, v in enumerate(ids.tolist())}
    for r in run(spark, "op5_nn_descent_search"):
        found[r["query_id"]] += 1
        i, j = place[r["query_id"]], place[r["vec_id"]]
        assert 1 <= r["rank"] <= 5 and r["score"] == pytest.approx(cosine[i, j], abs=1e-9)
        hits += cosine[i, j] >= np.sort(cosine[i])[-5] - 1e-12
        total += 1
    assert set(found) == {v for v in ids.tolist() if v % 50 == 0} and set(found.values()) == {5}
    assert hits / total >= 0.9


def test_op7(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for r in run(spark, "op7_secret_grammar_inference"):
        text = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]
        kinds = Counter(s.split(":")[0] for s in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == sha(",".join(base).encode())
        assert set(base) <= set(r["spans"].split(",")) | {""}


def test_op8(spark, texts, word_ids):
    rows = run(spark, "op8_pack_first_fit_decreasing")
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        ids = [*word_ids(text), 2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 4096


def test_op10(spark, texts, word_ids):
    rows, at = {r["doc_id"]: r for r in run(spark, "op10_frequency_ranked_ids")}, 0
    for i in sorted(texts):
        ids = [*word_ids(texts[i]), 1]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op11(spark, texts):
    keys = list(texts)
    expected = dict(zip(keys, brute_repeats([(texts[i] or "").encode() for i in keys], 400)))
    for r in run(spark, "op11_prefix_doubling_repeats"):
        n, gone, spans, kept = expected[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, sha(kept))


def test_op12(spark, texts, tokenizers):  # noqa: F811
    found = {i: brute_groups(t, tokenizers) for i, t in texts.items()}
    count = Counter(p for e in found.values() if e for p in e[3])
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    for r in run(spark, "op12_tokenizer_alignment"):
        e = found[r["doc_id"]]
        if e is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        best, total = sum(count[p] == highest[p[1]] for p in e[3]), sum(count[p] for p in e[3])
        assert tuple(r)[1:] == (e[0], e[1], e[2].count(";") + 1, len(e[3]), best, total, sha(e[2].encode()))


def test_op13(spark, texts):
    for r in run(spark, "op13_periodic_runs"):
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if len(w) > 4000:
            continue  # brute force would take minutes
        runs = brute_runs(w)
        best, gone = best_run(runs), set()
        for s, length, q in runs:
            gone.update(range(s + q, s + length))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None, None, None)))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode())
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
