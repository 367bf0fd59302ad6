"""Token totals kept up to date by signed deltas.

A batch is a table of signed rows: an insert adds a document's count, a delete
takes it away, a revised count is the old row taken away and the new one added.
A batch is summed by (source, language, tokenizer version) before anything is
shuffled far, and its sums are the only thing written: one folder for each batch
id. Totals are the sum over the folders that were committed.

A commit is idempotent: a batch id that has been committed is not applied again. A
batch is written to a folder of its own and then renamed to its name, which fails
where the name exists, so of two drivers that commit a batch at once one is refused,
and a write that broke off never counts. Compaction folds committed batches
into one folder that names them; a reader takes a folded batch only once.

Defined results: a null text counts as empty (0 tokens); null source, language
or version form groups of their own; a null sign or count adds nothing; a group
whose documents and tokens both come to 0 is left out; an empty batch commits
and changes nothing; very long texts are counted whole; repeated rows count as often
as they occur; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight.llm.bpe import read_json_ranks, read_ranks
from tidelight.llm.common import small_batches

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = read_ranks(path) if path.endswith(".tiktoken") else read_json_ranks(path)
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens, n_bytes`` of every whole text, in one pass over the texts; ``tokenizers``: version to (file, pattern)."""

    def run(batches):
        encodings = {k: _encoding(*v) for k, v in tokenizers.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(3).to_pylist()
                sizes = pc.binary_length(part.column(3).cast(pa.binary())).cast(pa.int64())
                for version, enc in encodings.items():
                    n = pa.array([len(enc.encode_ordinary(t)) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([version] * len(texts)), n, sizes], ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_bytes"])

    rows = small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_bytes long")


def estimated(counts: DataFrame) -> DataFrame:
    """The same rows with a first estimate in place of the count: a token for every four bytes."""
    return counts.withColumn("n_tokens", F.expr("(n_bytes + 3) div 4"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as inserts (1) or deletes (-1)."""
    return counts.withColumn("sign", F.lit(sign))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that take the place of others."""
    return signed(old, -1).unionByName(signed(new, 1))


def _safe(name: str) -> str:
    """A name as part of a path."""
    return quote(name, safe="")


class TokenTotals:
    """Additive totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _committed(self) -> dict[str, list[str]]:
        """Folders whose write ended, each with the batch ids it holds."""
        fs, top = self._fs(f"{self.path}/sums")
        if not fs.exists(top):
            return {}
        found = {}
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[name] = self._folded(name)
        inside = {b for name, ids in found.items() if name.startswith("fold=") for b in ids}
        return {name: ids for name, ids in found.items() if name.startswith("fold=") and not self._covered(name, ids, found) or not name.startswith("fold=") and ids[0] not in inside}

    @staticmethod
    def _covered(name: str, ids: list[str], found: dict[str, list[str]]) -> bool:
        return any(other != name and other.startswith("fold=") and set(ids) < set(more) for other, more in found.items())

    def _folded(self, name: str) -> list[str]:
        if not name.startswith("fold="):
            return [unquote(name.removeprefix("batch="))]
        row = self.spark.read.text(f"{self.path}/folds/{name.removeprefix('fold=')}").first()
        return json.loads(row[0])

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Apply a batch (``source, lang, tokenizer, n_tokens, sign``); False if it had been applied."""
        if any(batch_id in ids for ids in self._committed().values()):
            return False
        sums = (
            deltas.filter("sign is not null and n_tokens is not null")
            .groupBy(*KEYS)
            .agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign").cast("long") * F.col("n_tokens")).alias("n_tokens"))
        )
        return self._publish(sums, f"batch={_safe(batch_id)}")

    def _publish(self, sums: DataFrame, name: str) -> bool:
        """Write sums under a new name and rename them; False if the name was taken."""
        jvm = self.spark._jvm
        written = f"{self.path}/writing/{uuid.uuid4().hex}"
        sums.write.parquet(written)
        fs, top = self._fs(f"{self.path}/sums")
        fs.mkdirs(top)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs(written)[1], self._fs(f"{self.path}/sums/{name}")[1], no_options)
        except Py4JJavaError as e:
            fs.delete(self._fs(written)[1], True)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def compact(self, name: str) -> None:
        """Fold what is committed into one folder; its list of batches is written before its sums count."""
        now = self._committed()
        ids = sorted({b for more in now.values() for b in more})
        self.spark.createDataFrame([(json.dumps(ids),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/folds/{_safe(name)}")
        self._publish(self._sum(now), f"fold={_safe(name)}")

    def _sum(self, folders: dict[str, list[str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*[f"{self.path}/sums/{name}" for name in sorted(folders)])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        return self._sum(self._committed()).filter("n_docs <> 0 or n_tokens <> 0")
