"""Token files: ids in one array, document boundaries in Elias-Fano form.

File, little-endian: magic "SFTOK1\\0\\0", width of an id in bytes (u4), low bits of a bound (u4), documents n (u8), ids m
(u8), words of the upper part (u8), then the ids, the low bits of the n + 1 bounds packed into words, the upper bits (bit
(bound >> low) + i is set for bound i) as words, and for every `SELECT`-th set bit its place (u4 in units of one bit,
u8 files beyond 2^32 bits). With log2(m / n) + 2 bits a bound this is near the least space; a bound is found by one
sample, a few popcounts and one low field, without a table of 64-bit offsets.

Documents are tokenized where they are read and dealt to shards by ranges of their id. The ranges come from a sketch of the
ids with at most `MOST_SHARDS` bounds, whatever the size of the input. A shard is sorted in its task and cut into files of
about `FILE_BYTES` while it streams by; a file is a row of a table in shared storage, with its place in the shard. `start`
is the ids of earlier shards (one number a shard), those of earlier files in the shard, and the bound within the file.

Defined cases: null is an empty text, its only id is the end id; order is by id (nulls first), equal ids by their tokens,
so reruns agree; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MAGIC = b"SFTOK1\0\0"
END_ID = 1
SELECT = 256
#: Text of a shard, unless there are more than MOST_SHARDS of them, and ids of a file.
SHARD_BYTES = 16 << 20
FILE_BYTES = 16 << 20
MOST_SHARDS = 1 << 15
#: Text that is encoded at once.
TEXT_BYTES = 4 << 20
#: Distinct words whose ids a worker remembers.
CACHE = 400_000
#: Words that are encoded in one run.
_RUN = 2000
_HEAD = struct.Struct("<8sIIQQQ")
#: ASCII marks but the apostrophe, which can begin a piece of its own, after a letter or digit.
_MARKS = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)")


class EliasFano:
    """Ascending integers up to a maximum; select(i) is the i-th."""

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.samples = n, low, lower, upper, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        field = values & np.uint64((1 << low) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low)
        lower = np.zeros(n * low // 64 + 2, np.uint64)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        if low:
            np.bitwise_or.at(lower, word, field << shift)
            over = shift + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(lower, word[over] + 1, field[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        bits = int(ones[-1]) + 1 if n else 0
        upper = np.zeros(bits // 64 + 1, np.uint64)
        np.bitwise_or.at(upper, (ones >> np.uint64(6)).astype(np.int64), np.uint64(1) << (ones & np.uint64(63)))
        return cls(n, low, lower, upper, ones[::SELECT].astype(np.uint64))

    def select(self, i: int) -> int:
        at = int(self.samples[i // SELECT])
        word, left = at >> 6, i % SELECT
        bits = int(self.upper[word]) >> (at & 63) << (at & 63)
        while (n := bits.bit_count()) <= left:
            left -= n
            word += 1
            bits = int(self.upper[word])
        for _ in range(left):
            bits &= bits - 1
        high = 64 * word + (bits & -bits).bit_length() - 1 - i
        at = i * self.low
        both = int(self.lower[at >> 6]) | int(self.lower[(at >> 6) + 1]) << 64
        return high << self.low | (both >> (at & 63) & ((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        ones = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))[: self.n].astype(np.uint64)
        high = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        if not self.low:
            return high
        at = np.arange(self.n, dtype=np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        up = (np.uint64(64) - shift) & np.uint64(63)
        field = self.lower[word] >> shift | np.where(shift > 0, self.lower[word + 1] << up, np.uint64(0))
        return high | field & np.uint64((1 << self.low) - 1)


def write_file(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """ids: of all documents, as unsigned 16- or 32-bit; bounds: where each starts, and the end."""
    ef = EliasFano.build(bounds)
    wide = np.uint64 if 64 * len(ef.upper) >= 1 << 32 else np.uint32
    head = _HEAD.pack(MAGIC, ids.dtype.itemsize, ef.low, len(bounds) - 1, len(ids), len(ef.upper))
    return b"".join([head, ids.tobytes(), b"\0" * (-ids.nbytes % 8), ef.lower.tobytes(), ef.upper.tobytes(), ef.samples.astype(wide).tobytes()])


def read_file(data: bytes) -> tuple[np.ndarray, EliasFano]:
    """The ids and the bounds of a file; ValueError if it is damaged."""
    try:
        magic, width, low, n, m, words = _HEAD.unpack_from(data)
        if magic != MAGIC or width not in (2, 4):
            raise ValueError("no token file")
        ids = np.frombuffer(data, {2: "<u2", 4: "<u4"}[width], m, at := _HEAD.size)
        at += -(-ids.nbytes // 8) * 8
        lower = np.frombuffer(data, np.uint64, (n + 1) * low // 64 + 2, at)
        upper = np.frombuffer(data, np.uint64, words, at := at + lower.nbytes)
        samples = np.frombuffer(data, np.uint64 if 64 * words >= 1 << 32 else np.uint32, n // SELECT + 1, at + upper.nbytes)
    except struct.error as e:
        raise ValueError("damaged token file") from e
    return ids, EliasFano(n + 1, low, lower, upper, samples)


def document(ids: np.ndarray, bounds: EliasFano, i: int) -> np.ndarray:
    return ids[bounds.select(i) : bounds.select(i + 1)]


# Tokenizing ---------------------------------------------------------------------------------------


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, {}, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def encoder(path: str, dtype):
    """A function from texts to the bytes of their ids.

    For tokenizers that drop white space no token crosses a blank or newline, so the ids of a text are those of its words,
    which are remembered. Where such a tokenizer also cuts between a letter and a punctuation mark, a blank put there
    changes nothing and lets a word be remembered with any mark after it. `tests` compare this with whole texts.
    """
    tokenizer, words, added = _tokenizer(path)
    ends = _piece_ends(path)

    def learn(new: list[str]) -> None:
        alone = new
        if ends is not None:  # words of letters are one piece each: encoded in runs and cut where pieces end
            plain, alone = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
            runs = [plain[i : i + _RUN] for i in range(0, len(plain), _RUN)]
            for run, e in zip(runs, tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype)
                at = np.flatnonzero(ends[ids]) + 1
                if len(at) != len(run):
                    alone += run
                    continue
                at, raw = (at * ids.itemsize).tolist(), ids.tobytes()
                words.update(zip(run, map(raw.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))
        for w, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            words[w] = np.array(e.ids, dtype).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        # an added token within a text has marks of its own
        split = [(t if any(a in t for a in added) else _MARKS.sub(r" \1", t)).replace("\n", " ") for t in texts]
        split = pc.split_pattern(pa.array(split, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        here = coded.dictionary.to_pylist()
        new = [w for w in here if w not in words]
        if len(words) + len(new) > CACHE:  # those at hand are the frequent ones
            kept = {w: words[w] for w in here if w in words}
            words.clear()
            words.update(kept)
        learn(new)
        found = list(map(words.__getitem__, here))
        size = np.fromiter(map(len, found), np.int64, len(found)) // dtype().itemsize
        start = np.cumsum(size) - size
        which = np.asarray(coded.indices)
        ids = np.frombuffer(b"".join(found), dtype)[C.concat_ranges(start[which], (start + size)[which])]
        bounds = np.concatenate([[0], np.cumsum(size[which])])[np.asarray(split.offsets)] * dtype().itemsize
        raw, bounds = ids.tobytes(), bounds.tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    return encode


@lru_cache(1)
def _piece_ends(path: str) -> np.ndarray | None:
    """For each id whether it ends a piece, for vocabularies that say so."""
    tokenizer = _tokenizer(path)[0]
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    out = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.endswith(suffix)
    return out


def drops_white_space(path: str) -> bool:
    tokenizer = _tokenizer(path)[0]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return ids("a \n b") == ids("a") + ids("b") and ids("ab.,!b") == ids("ab") + ids(".,!") + ids("b")


def tokenize(docs: DataFrame, path: str, doc_id: str, text: str, bounds: list, dtype) -> DataFrame:
    """(shard, id, ids): the shard is the range of `bounds` that the id falls in."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("id", docs.schema[doc_id].dataType), T.StructField("ids", T.BinaryType())])
    arrow, end = to_arrow_schema(schema), np.array([END_ID], dtype).tobytes()

    def run(batches):
        by_word, encode = drops_white_space(path), encoder(path, dtype)
        whole = _tokenizer(path)[0]
        for batch in C.split_batches(batches, "text", TEXT_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = encode(texts) if by_word else [np.array(e.ids, dtype).tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
            key = batch.column(0)
            shard = np.searchsorted(np.array(bounds), key.fill_null(bounds[0] if bounds else 0).to_numpy(zero_copy_only=False), "left") if bounds else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), key.cast(arrow.field(1).type), pa.array([x + end for x in ids], pa.binary())], schema=arrow)

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _pack(dtype, file_bytes: int):
    """Files from rows that come sorted by shard, id and ids; a file ends with its shard or once it has file_bytes of ids."""

    def run(batches):
        shard, part, before, size, ids, counts, keys = None, 0, 0, 0, [], [], []

        def done():
            bounds = np.concatenate([[0], np.cumsum(counts)])
            data = write_file(np.frombuffer(b"".join(ids), dtype), bounds)
            cols = [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([before]), pa.array([int(bounds[-1])]), pa.array([keys]), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "part", "before", "n_ids", "doc_ids", "file"])

        for batch in batches:
            for s, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != shard or size >= file_bytes:
                    if counts:
                        yield done()
                    part, before = (part + 1, before + sum(counts)) if s == shard else (0, 0)
                    shard, size, ids, counts, keys = s, 0, [], [], []
                ids.append(x)
                size += len(x)
                counts.append(len(x) // dtype().itemsize)
                keys.append(k)
        if counts:
            yield done()

    return run


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, most_shards: int = MOST_SHARDS) -> DataFrame:
    """A table in shared storage: shard, part, before (ids of earlier parts of the shard), n_ids, doc_ids and file, for integer ids."""
    vocabulary = _tokenizer(path)[0].get_vocab_size()
    dtype = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    shards = min(max(1, math.ceil(C.input_bytes(docs, text) / shard_bytes)), most_shards)
    # bounds by ids alone: one small scan instead of tokenizing twice for a range partitioning
    bounds = sorted(set(docs.approxQuantile(doc_id, [i / shards for i in range(1, shards)], 0.1 / shards))) if shards > 1 else []
    bounds = [int(b) for b in bounds]
    rows = tokenize(docs, path, doc_id, text, bounds, dtype)
    sorted_rows = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "ids")
    kind = docs.schema[doc_id].dataType.simpleString()
    return C.write_table(sorted_rows.mapInArrow(_pack(dtype, file_bytes), f"shard int, part int, before long, n_ids long, doc_ids array<{kind}>, file binary"), "tokens")


def read_shards(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: start (ids of all before it), n_tokens and ids_crc32, from the files."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").toArrow()  # one number a shard, MOST_SHARDS at most
    shards, n = (np.asarray(totals[c].combine_chunks()).astype(np.int64) for c in ("shard", "n"))
    base = files.sparkSession.sparkContext.broadcast((shards, np.cumsum(n) - n))
    kind = files.schema["doc_ids"].dataType.elementType

    def run(batches):
        known, first = base.value
        for batch in batches:
            for shard, before, keys, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                ids, bounds = read_file(data.as_buffer())
                at = bounds.all().astype(np.int64)
                start = at[:-1] + int(first[np.searchsorted(known, shard)]) + before
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=[doc_id, "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "before", "doc_ids", "file").mapInArrow(run, f"`{doc_id}` {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_output(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_shards(write_shards(docs.select("doc_id", "text"), path or _path()))


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    return token_output(C.table(spark, sf_dir, "documents"))


def output_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token files of all documents, and where each lies in them."""
    return token_output(docs)


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
