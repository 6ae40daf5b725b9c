"""The registered query of each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantcast.llm.alignment import align_texts, link_counts
from plantcast.llm.id_files import read_id_files, write_id_files
from plantcast.llm.lattice import near_vectors
from plantcast.llm.mixing import mix, mix_table
from plantcast.llm.neighbours import nearest
from plantcast.llm.packing import pack_documents
from plantcast.llm.periodic import find_runs
from plantcast.llm.pii import replace_entities
from plantcast.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from plantcast.llm.repeats import remove_repeats
from plantcast.llm.secrets import KINDS, count_kind, find_secrets
from plantcast.llm.shared import read_table, stored
from plantcast.llm.simhash import fingerprint_hex, simhash_groups
from plantcast.llm.toxicity import fit_severity, labelled_sample, score_toxicity
from plantcast.llm.warc import archive_round_trip, page_key

VOCABULARY = "word_bpe_49k.json"
# Key of the registered query; a real run takes its own from a secret store.
SURROGATE_KEY = b"registered query"


# Base32 of the digest: each five hexadecimal digits are four digits of base 32.
WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(encode(coalesce(html, '')))) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, array_to_string([
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)] FOR i IN range(32)
], '') AS payload_digest, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM d
"""


@query("op1_warc_segments", WARC_SQL)
def op1_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    read = archive_round_trip(read_table(spark, folder, "pages", ["page_id", "url", "html"]))
    return read.select(
        page_key(F.col("id")).cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        page_key(F.col("refers_to")).cast("long").alias("refers_to"),
    )


@query("op2_pii_surrogates")
def op2_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    return replace_entities(docs, SURROGATE_KEY).select("doc_id", "n_entities", "spans", "text")


@query("op3_mix_sources_by_weight")
def op3_mix_sources_by_weight(spark: SparkSession, folder: str) -> DataFrame:
    table = stored(mix_table(read_table(spark, folder, "documents", ["doc_id", "text", "source"])), "mix")
    mixed = mix(table, table)
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op9_simhash_bit_sliced")
def op9_simhash_bit_sliced(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    found = simhash_groups(docs)
    return found.select("doc_id", fingerprint_hex(F.col("mark")).alias("fingerprint"), "component_id")


@query("op4_lattice_near_vectors")
def op4_lattice_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read_table(spark, folder, "embeddings", ["vec_id", "embedding", "label"]))


@query("op5_nn_descent_search")
def op5_nn_descent_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(read_table(spark, folder, "embeddings", ["vec_id", "embedding"]), F.col("vec_id") % 50 == 0)


@query("op6_toxicity_ordinal_regression")
def op6_toxicity_ordinal_regression(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    labels = read_table(spark, folder, "labels", ["doc_id", "toxic"])
    scored = score_toxicity(docs, fit_severity(labelled_sample(docs, labels)))
    kept = (~F.col("toxic")).alias("kept")
    return scored.select("doc_id", "toxic_chance", "severity", F.round("severity").cast("int").alias("grade"), "toxic", kept)


@query("op7_secret_grammar_inference")
def op7_secret_grammar_inference(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(read_table(spark, folder, "documents", ["doc_id", "text"]))
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op8_pack_first_fit_decreasing")
def op8_pack_first_fit_decreasing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    packed = pack_documents(docs, public_tokenizers.path(VOCABULARY), end_id=2)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op10_frequency_ranked_ids")
def op10_frequency_ranked_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    path = write_id_files(docs, public_tokenizers.path(VOCABULARY), end_id=1)
    read = read_id_files(spark, path, ids_crc32=F.crc32("ids"))
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op11_prefix_doubling_repeats")
def op11_prefix_doubling_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(read_table(spark, folder, "documents", ["doc_id", "text"]))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    aligned = align_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    counted = link_counts(aligned.select("*", digest).drop("groups"))
    return counted.select(F.col("key").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def planted_period(key: Column, text: Column) -> Column:
    """The text of every tenth key with its words from one place on replaced by repeats of the words there."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    times = F.ceil((n - a) / p).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & text.isNotNull() & (n > 0), planted).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", ["doc_id", "text"])
    found = find_runs(docs.withColumn("text", planted_period(F.col("doc_id"), F.col("text"))))
    # length / period from high to low, without rounding.
    share = lambda x, y: y["length"] * x["period"] - x["length"] * y["period"]
    order = lambda x, y: F.coalesce(*(F.nullif(d, F.lit(0)) for d in (share(x, y), x["start"] - y["start"], x["period"] - y["period"])), F.lit(0))
    best = F.get(F.array_sort("runs", lambda x, y: F.signum(order(x, y)).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    return named.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
