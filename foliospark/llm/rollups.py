"""Token counts as rollups that deltas keep up to date.

Changes are signed: an insert adds its count, a delete takes it away, a revision adds the difference. A batch is
summed by key, written beside the batches and renamed into its own folder, which one writer alone can do.
Handing in a batch again, after a lost driver or by mistake or from two writers at once, finds that folder and changes nothing; one that broke
off never got there and is written anew. Totals are sums of what committed batches hold, so no order of arrival matters.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import cut

KEYS = ("source", "lang", "tokenizer")
#: op of a change: how n_docs and n_tokens move.
INSERT, DELETE, REVISE = "insert", "delete", "revise"


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version, in a folder that all nodes share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def exists(self, path: str) -> bool:
        fs, at = self._path(path)
        return fs.exists(at)

    def batches(self, under: str = "batches") -> list[str]:
        """The committed batches' ids, sorted."""
        fs, at = self._path(f"{self.folder}/{under}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _publish(self, staged: str, at: str) -> bool:
        """Rename a finished folder, the one step that counts. False, and the staged folder is dropped, if another one is there."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        fs, source = self._path(staged)
        _, target = self._path(at)
        fs.mkdirs(target.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        plainly = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(source), fs.makeQualified(target), plainly)
        except Py4JJavaError:
            if not self.exists(at):
                raise
            fs.delete(source, True)
            return False
        return True

    def _staged(self) -> str:
        return f"{self.folder}/staged/{uuid.uuid4().hex}"

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` once: (source, lang, tokenizer, op, n_tokens, old_tokens). False if the batch was in already.

        old_tokens counts for revisions only. Null keys are keys; null counts are 0; a null or unknown op fails the
        batch, which then has no effect. Repeated rows are repeated changes; an empty batch is committed as such; other columns
        play no part.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError("a batch id is made of letters, digits, _ . and -")
        at = f"{self.folder}/batches/{batch_id}"
        if self.exists(at):
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
        unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
        docs = F.when(F.col("op") == INSERT, 1).when(F.col("op") == DELETE, -1).when(F.col("op") == REVISE, 0).otherwise(unknown.cast("int"))
        tokens = F.when(F.col("op") == INSERT, n).when(F.col("op") == DELETE, -n).otherwise(n - old)
        signed = changes.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.alias("n_tokens"), F.lit(1).cast("long").alias("n_changes"))
        staged = self._staged()
        _summed(signed).write.parquet(staged)
        return self._publish(staged, at)

    def _parts(self) -> tuple[str | None, list[str]]:
        """The newest snapshot, if there is one, and the batches that it does not hold."""
        newest = (self.batches("snapshots") or [None])[-1]
        held = {r.batch for r in self.spark.read.parquet(f"{self.folder}/snapshots/{newest}/held").collect()} if newest else set()
        return newest, [b for b in self.batches() if b not in held]

    def _sum(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        return _summed(self.spark.read.parquet(*([f"{self.folder}/snapshots/{snapshot}/totals"] if snapshot else []), *(f"{self.folder}/batches/{b}" for b in batches)))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_changes) of all committed batches; keys with no changes are absent."""
        snapshot, batches = self._parts()
        if not snapshot and not batches:
            raise ValueError("no batch is committed")
        return self._sum(snapshot, batches)

    def compact(self) -> bool:
        """Fold the batches committed by now into a snapshot that names them. False if there are none or another writer was first.

        A snapshot is the sum of the one before and of just the batches that it names, and gets its place with one rename, so a batch
        that is committed meanwhile is counted beside it.
        """
        snapshot, batches = self._parts()
        if not batches:
            return False
        staged = self._staged()
        self._sum(snapshot, batches).write.parquet(f"{staged}/totals")
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        if snapshot:
            names = names.union(self.spark.read.parquet(f"{self.folder}/snapshots/{snapshot}/held"))
        names.coalesce(1).write.parquet(f"{staged}/held")
        return self._publish(staged, f"{self.folder}/snapshots/{int(snapshot or -1) + 1:012d}")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_changes")))


#: Two tokenizer versions that SQL has too: words, and runs of ASCII letters or digits and other visible characters alone.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-2": r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"}


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(source, lang, tokenizer, n_tokens) of documents; a null text has none."""
    n = F.coalesce(F.regexp_count("text", F.lit(TOKENIZERS[tokenizer])), F.lit(0))
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), n.cast("long").alias("n_tokens"))


def bpe_counted(docs: DataFrame, tokenizer: str, vocabulary: str, pattern: str) -> DataFrame:
    """As ``counted``, under a byte-level BPE whose version ``tokenizer`` names: its vocabulary file and the pattern of its pieces."""
    encoded = bpe.encode_texts(docs.select("source", "lang", "text"), vocabulary, pattern, keep=["source", "lang"], with_ids=False)
    return encoded.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_tokens")


#: Documents of under so many words-1 tokens are deleted by the third batch of op4.
LEAST_TOKENS = 50


def replay(docs: DataFrame, rollup: TokenRollup) -> DataFrame:
    """op4: all documents as four batches of changes, one of them handed in twice; the totals after.

    Batch 1 inserts each document's count under words-1, 2 inserts those under marks-2 as a first estimate of one
    token for each four bytes, 3 revises the estimates to counts, 4 deletes documents short of LEAST_TOKENS words
    from both versions. Texts are counted once; the counts are stored for the batches. Null texts have no tokens, null sources and languages
    are keys, repeated rows count each, and an empty table leaves no keys.
    """
    words, marks = (F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long") for p in TOKENIZERS.values())
    first, second = TOKENIZERS
    rows = cut(docs.select("source", "lang", words.alias("words"), marks.alias("marks"), F.expr("coalesce(octet_length(text), 0) div 4").alias("guess")))

    def changes(frame: DataFrame, tokenizer: str, op: str, n: str, old: str | None = None) -> DataFrame:
        return frame.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    short = rows.filter(F.col("words") < LEAST_TOKENS)
    batches = {
        "1-words": changes(rows, first, INSERT, "words"),
        "2-guesses": changes(rows, second, INSERT, "guess"),
        "3-marks": changes(rows, second, REVISE, "marks", "guess"),
        "4-short": changes(short, first, DELETE, "words").union(changes(short, second, DELETE, "marks")),
    }
    for batch_id, frame in batches.items():
        rollup.commit(batch_id, frame)
    rollup.commit("3-marks", batches["3-marks"])
    return rollup.totals()


SQL = rf"""
WITH docs AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) AS marks FROM documents),
both_versions AS (SELECT source, lang, words, 'words-1' AS tokenizer, words AS n, 2 AS changes FROM docs UNION ALL SELECT source, lang, words, 'marks-2', marks, 3 FROM docs)
SELECT source, lang, tokenizer, CAST(count(*) FILTER (WHERE words >= {LEAST_TOKENS}) AS BIGINT) AS n_docs, CAST(coalesce(sum(n) FILTER (WHERE words >= {LEAST_TOKENS}), 0) AS BIGINT) AS n_tokens,
  CAST(sum(CASE WHEN words < {LEAST_TOKENS} THEN changes ELSE changes - 1 END) AS BIGINT) AS n_changes
FROM both_versions GROUP BY source, lang, tokenizer
"""
