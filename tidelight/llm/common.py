"""What the training-data operators share: written tables in the shared folder, and their input columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelight.sources.shared import delete_path, drop_table, materialize, new_path, release_shuffles, shared_dir

__all__ = ["delete_path", "drop_table", "materialize", "new_path", "one_text_an_id", "release_shuffles", "shared_dir", "small_batches", "text_or_empty"]


#: Rows of an Arrow batch of texts: documents are long, so the default of 10,000 would be far more memory than a task needs.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session sends texts to Python in small batches."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def text_or_empty(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, as ``doc_id`` and ``text``; null text is empty."""
    small_batches(df)
    plain = id_col == "doc_id" and df.schema[id_col].dataType.simpleString() == "bigint"  # no alias, so that equal plans stay equal
    return df.select(
        F.col("doc_id") if plain else F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def one_text_an_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` (``doc_id, text`` and more) in a form where an id stands for one text, and ``key, named``: the ids its new ids stand for.

    Mostly no id has two rows, and ``docs`` comes back as it is, with None. Otherwise
    each distinct (id, text) gets a new id; their order is that of (id, digest of
    the text), so the least new id is that of the least id. Null ids stay null.
    """
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if again.isEmpty():
        return docs, None
    named = docs.withColumn("digest_", F.sha2("text", 256))
    distinct = named.filter("doc_id is not null").select(F.col("doc_id").alias("named"), "digest_").distinct().orderBy("named", "digest_")
    names = materialize(distinct.select("named", "digest_", F.monotonically_increasing_id().alias("key")), "names")
    keyed = named.join(names, (F.col("doc_id") == F.col("named")) & (named["digest_"] == names["digest_"]), "left")
    keyed = keyed.select(*[F.col("key").alias("doc_id") if c == "doc_id" else docs[c] for c in docs.columns])
    return materialize(keyed, "keyed"), names.select("key", "named")
