"""Token counts by a digest cache: contents are joined with the counts that are stored for their digest and the tokenizer's version; only
distinct contents without one are encoded, and their counts are appended.

The digest of a content is sha256 of its text, a null taken as the empty text. Counts of a tokenizer version are a folder of Parquet files; what is
in it is never changed. Two runs at once may both append a content: equal rows, of which one is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm._session import checkpoint, fresh, python_stage
from sievelake.llm._text import flat
from sievelake.llm._tokens import Memory, PieceModel, Source, pieces, tiles

STORED = "digest binary, n_tokens long"


def content() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def digest() -> F.Column:
    return F.unhex(F.sha2(content(), 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of a tokenizer version in a cache; no rows if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/{version}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(f"{cache}/{version}")


def encoded(texts: DataFrame, tokenizer: Source) -> DataFrame:
    """(digest, n_tokens) for (digest, text), once for each digest in an Arrow batch."""
    python_stage(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer.load()
        tiled = isinstance(model, PieceModel) and model.tiled
        known = Memory(lambda found: map(len, model.of_pieces(found)))
        for batch in batches:
            seen = batch.column("digest").dictionary_encode()
            rows = np.unique(seen.indices.to_numpy(zero_copy_only=False), return_index=True)[1]
            batch = batch.take(pa.array(rows))
            if tiled:
                data, offsets = flat(batch.column("spaced"))
                starts = tiles(data, offsets)
                name, found = pieces(data, starts)
                total = np.concatenate([[0], np.cumsum(np.array(known(found), dtype=np.int64)[name])])
                counts = np.diff(total[np.searchsorted(starts, offsets)])
            else:
                counts = [len(x) for x in model.encode([(x or " ")[1:] for x in batch.column("spaced").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    spaced = F.when(content() == "", "").otherwise(F.concat(F.lit(" "), content()))
    return texts.select("digest", spaced.alias("spaced")).mapInArrow(run, STORED)


def count_tokens(docs: DataFrame, tokenizer: Source, cache: str) -> DataFrame:
    """Every row of ``docs``, its ``doc_id`` with n_bytes (UTF-8) and n_tokens; no special tokens are added, nothing is cut off.

    A null text is empty: no bytes, no tokens. Equal texts are encoded once, in all runs on ``cache`` together; of copies the row with
    the least doc_id gives its text (null ids first), so the copies' texts are not shuffled onto one key. Texts of any length are taken whole. Repeated rows
    count each; columns other than doc_id and text, whatever their names, are not carried; an empty table gives no rows and adds none.
    """
    spark, version = docs.sparkSession, tokenizer.version()
    named = docs.select("doc_id", "text", digest().alias("digest"))
    # a long alone: the text itself never leaves the scan here
    own = checkpoint(named.select("doc_id", "digest", F.octet_length(content()).cast("long").alias("n_bytes")))
    first = own.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least"))
    before = stored(spark, cache, version)
    misses = checkpoint(first.join(before, "digest", "left_anti").select(F.col("digest").alias("_digest"), F.col("least.doc_id").alias("_doc")))
    if not misses.isEmpty():
        same = (named["digest"] == misses["_digest"]) & named["doc_id"].eqNullSafe(misses["_doc"])
        # repeated rows of one id and text may be encoded in several tasks
        counts = encoded(named.join(misses, same, "left_semi"), tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        counts.write.mode("append").parquet(f"{cache}/{version}")
        before = stored(spark, cache, version)
    # written down before the join: straight on an aggregate, a join can't split the rows of a text that is a third of them all
    counts = checkpoint(before.join(own.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return own.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def over_limit(counted: DataFrame, limit: int) -> DataFrame:
    """Adds ``over_limit``: more than ``limit`` tokens."""
    return counted.withColumn(fresh("over_limit", counted), F.col("n_tokens") > limit)
