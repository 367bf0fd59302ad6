"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight.llm import ann, bpe, exact_dedup, html_text, line_dedup, near_dedup, packing, substring_dedup, token_counts, toxicity
from tidelight.llm.common import materialize, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_line_dedup(spark, sf_dir):
    return line_dedup.mark_lines(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_exact(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    """Every document is entered with an estimate for two tokenizer versions; real counts then take the estimates' place.

    One version's estimates are revised, the other's deleted before its counts are
    inserted; two batches are sent twice, and all are folded. Texts are tokenized once.
    """
    docs, totals = table(spark, sf_dir, "documents"), token_counts.TokenTotals(spark, new_path(spark, "token-totals"))
    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    counts = materialize(token_counts.count_tokens(docs, {v: (public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN) for v in (first, second)}), "token-counts")
    real = {v: counts.filter(F.col("tokenizer") == v) for v in (first, second)}
    entered = {v: token_counts.estimated(real[v]) for v in real}
    batches = {
        "entered": token_counts.signed(token_counts.estimated(counts), 1),
        "revised": token_counts.revised(entered[first], real[first]),
        "deleted": token_counts.signed(entered[second], -1),
        "inserted": token_counts.signed(real[second], 1),
    }
    for name in (*batches, "revised", "deleted"):
        totals.commit(name, batches[name])
    totals.compact("all")
    return totals.totals()


def op5_toxicity(spark, sf_dir):
    return toxicity.label_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(50)) == 0, k=5)


def op8_bpe(spark, sf_dir):
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.mark_repeats(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark, sf_dir):
    return near_dedup.label_near(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_html": op6_html,
    "op7_ann": op7_ann,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text""",
    "op7_ann": """
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, e.vec_id,
                     list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS score
              FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
