"""The stages of the pipeline, one after the other, against brute force on the smallest folder."""

import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plantcast.llm.shared import stored
from tests.conftest import FOLDER
from tests.llm.test_texts import PATH, brute_base, brute_mark, words


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["start"] = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
        out[name] = docs.toPandas()
    return out


def test_columns_stay_until_the_last_stage(steps):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(steps[name].columns) == list(steps["start"].columns)


def test_toxicity_keeps_documents_as_they_are(steps, spark):
    before, after = (dict(zip(steps[s]["doc_id"], steps[s]["text"])) for s in ("start", "toxicity"))
    assert all(before[i] == t for i, t in after.items())
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    clean = set(labels.loc[labels["toxic"] == 0, "doc_id"])
    assert len(clean - set(after)) <= 0.02 * len(clean)


def test_one_document_of_each_group_stays(steps):
    docs = sorted(zip(steps["toxicity"]["doc_id"], steps["toxicity"]["text"]))
    marks = np.array([brute_mark(t) for _, t in docs], np.uint64)
    low = np.arange(len(docs))
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 3
    for _ in docs:
        low = np.where(near, low[None, :], len(docs)).min(axis=1)
    assert sorted(steps["simhash_near_dedup"]["doc_id"]) == [docs[i][0] for i in sorted(set(low.tolist()))]


def test_secrets_are_hidden(steps):
    before = dict(zip(steps["simhash_near_dedup"]["doc_id"], steps["simhash_near_dedup"]["text"]))
    assert set(before) == set(steps["secret_scan"]["doc_id"])
    for i, text in zip(steps["secret_scan"]["doc_id"], steps["secret_scan"]["text"]):
        assert brute_base(text) == ""
        if not brute_base(before[i]):
            assert text == before[i]
        else:
            kept = re.split(re.escape("[secret]"), text)
            assert before[i].startswith(kept[0]) and before[i].endswith(kept[-1])


def test_mix_comes_near_its_targets(steps):
    before, after = steps["secret_scan"], steps["mixing"]
    size = {i: len(words(t)) for i, t in zip(before["doc_id"], before["text"])}
    sources = {s: [size[i] for i in part["doc_id"]] for s, part in before.groupby("source")}
    taken = {s: sum(size[i] for i in part["doc_id"]) for s, part in after.groupby("source")}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sources))}
    target, full, total = {}, set(), sum(size.values())
    while True:
        rest = total - sum(3 * sum(sources[s]) for s in full)
        target = {s: 3 * sum(v) if s in full else rest * weight[s] / sum(weight[x] for x in sources if x not in full) for s, v in sources.items()}
        over = {s for s in sources if s not in full and target[s] > 3 * sum(sources[s])}
        if not over:
            break
        full |= over
    for s, sizes in sources.items():
        assert abs(taken.get(s, 0) - target[s]) <= max(sizes)
    assert max(Counter(after["doc_id"]).values()) <= 3


def test_packing_holds_every_token_once(steps):
    library = Tokenizer.from_file(PATH)
    docs, packed = steps["mixing"], steps["packing"]
    expected = Counter()
    for i, text in zip(docs["doc_id"], docs["text"]):
        expected[i, len(library.encode(text, add_special_tokens=False).ids) + 1] += 1
    tokens = packed.groupby(["doc_id", "doc_tokens"])["length"].sum()
    assert {k: n // k[1] for k, n in tokens.items()} == dict(expected)
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
