"""Exact deduplication that no hot text can skew.

Rows are deduplicated where they are read, merged by (digest, text, salt), and
the salts' winners are combined by (digest, text). Text is a grouping key at
every stage, so full contents are compared and no digest collision can join two
texts. A text that a third of all rows share sends one row for each task and
salt, not one for each copy.

Defined results: null text counts as empty, so null and empty texts are equal;
of equal texts the largest ``doc_id`` stays (a null id only if all are null);
rows that repeat a ``doc_id`` are the same document and share its fate, and each
counts in ``group_size``; an empty table gives no rows; other columns are
ignored by :func:`mark_exact` and carried by :func:`drop_exact`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelight.llm.common import materialize, text_or_empty

SALTS = 8


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: ``text_sha256``, ``keep_id``, ``group_size`` and ``variant``.

    ``variant`` is 0 but for texts that differ and share a digest; there it is
    the text's rank among them, so that (digest, variant) names a text.
    """
    rows = text_or_empty(docs, id_col, text_col).withColumn("text_sha256", F.sha2("text", 256))
    local = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    salted = local.groupBy("text_sha256", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("text_sha256", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def mark_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Groups of one text need no join by content; only digests that several texts
    share (none are known for SHA-256) are joined by digest and text.
    """
    groups = text_groups(docs, id_col, text_col, salts)
    by_digest = materialize(
        groups.groupBy("text_sha256").agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "exact-groups",
    )
    rows = text_or_empty(docs, id_col, text_col).withColumn("text_sha256", F.sha2("text", 256))
    plain = rows.drop("text").join(by_digest.filter("texts = 1").drop("texts"), "text_sha256")
    shared = by_digest.filter("texts > 1").select("text_sha256")
    if shared.isEmpty():
        marked = plain
    else:
        theirs = groups.join(shared, "text_sha256", "left_semi")
        marked = plain.unionByName(rows.join(theirs, ["text_sha256", "text"]).drop("text"))
    return marked.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, which must be orderable.

    The winner's other columns travel with the combining stages, so nothing is
    joined back. Rows that repeat a kept id and text are given once, the greatest
    by the remaining columns.
    """
    rest = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(F.col(id_col).cast("long").alias("k"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col(text_col).isNull().alias("n")).alias("r"))
    salted = (
        docs.select(F.sha2(text, 256).alias("_sha"), text.alias("_text"), F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("_salt"), row.alias("_row"))
        .groupBy("_sha", "_salt", "_text")
        .agg(F.max("_row").alias("_row"))
    )
    won = salted.groupBy("_sha", "_text").agg(F.max("_row").alias("_row"))
    value = {c: F.col(f"_row.r.c{i}") for i, c in enumerate(rest)} | {text_col: F.when(~F.col("_row.r.n"), F.col("_text"))}
    return won.select(*[value[c].alias(c) for c in docs.columns])
