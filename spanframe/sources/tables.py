"""Reading and writing: tables, task JSON, embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TASK, TOKENS
from .providers import EmbeddingProvider

#: Characters of text whose tokens are made at once.
PIECE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a few files or row groups would leave most of them idle; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def read_tasks(raw: DataFrame, value: str = "value", schema: str = TASK) -> DataFrame:
    """raw with a task struct parsed from a JSON column; null where it can't be read."""
    return raw.withColumn("task", F.from_json(value, schema))


def write_tasks(df: DataFrame, path: str, task: str = "task") -> None:
    """One JSON task a line."""
    df.select(F.to_json(task).alias("value")).write.text(path)


def token_arrays(texts: Iterator[pa.Array], cut, most: int = PIECE_CHARS) -> Iterator[pa.Array]:
    """Arrays of tokens for batches of texts, each for at most `most` characters or a single text: tokens take over ten times the memory of their text."""
    kind = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("idx", pa.int32())])
    for batch in texts:
        bounds = np.cumsum(np.concatenate([[0], np.asarray(pc.fill_null(pc.utf8_length(batch), 0), np.int64)]))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
            words, starts, ends, offsets, valid = [], [], [], [0], []
            for t in batch.slice(i, j - i).to_pylist():
                for w, a, b in cut(t) if t is not None else ():
                    words.append(w)
                    starts.append(a)
                    ends.append(b)
                offsets.append(len(words))
                valid.append(t is not None)
            idx = np.arange(len(words), dtype=np.int32) - np.repeat(np.array(offsets[:-1], np.int32), np.diff(offsets))
            values = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(idx, pa.int32())], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([not v for v in valid]))
            i = j


def tokens(provider: EmbeddingProvider | None = None):
    """Arrow-batched function from texts to arrays of tokens with offsets, in batches bounded by their text."""
    from ..functions import kernels

    cut = provider.tokenize if provider else kernels.tokenize

    @F.arrow_udf(TOKENS)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from token_arrays(texts, cut)

    return run


def embed(df: DataFrame, provider: EmbeddingProvider, text: str = "text", by_word: bool = False) -> DataFrame:
    """df with tokens, vectors (a row for each subword, or word) and word_idx: every text is embedded once."""

    @F.arrow_udf("struct<tokens:%s,vectors:array<array<float>>,word_idx:array<int>>" % TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            found, vectors, index = provider.embed_text(t or "", by_word)
            rows.append({"tokens": [{"text": w, "start": a, "end": b, "idx": i} for i, (w, a, b) in enumerate(found)], "vectors": np.asarray(vectors, np.float32).tolist(), "word_idx": index})
        token = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("idx", pa.int32())])
        return pa.array(rows, pa.struct([("tokens", pa.list_(token)), ("vectors", pa.list_(pa.list_(pa.float32()))), ("word_idx", pa.list_(pa.int32()))]))

    read = df.withColumn("_embedded", run(F.col(text)))
    return read.select(*[c for c in df.columns if c not in ("tokens", "vectors", "word_idx")], "_embedded.*")


def subword_range(word_idx: Column, first: Column, last: Column) -> Column:
    """Struct (start, end) of the subwords of words first..last-1: 0 and all where there is none at or after a bound."""
    at = lambda bound: F.get(F.filter(F.transform(word_idx, lambda w, i: F.when(w >= bound, i)), lambda i: i.isNotNull()), F.lit(0))
    return F.struct(F.coalesce(at(first), F.lit(0)).alias("start"), F.coalesce(at(last), F.size(word_idx)).alias("end"))
