import zlib

import numpy as np
import pytest

from spanframe.llm import tokens as K

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["áb c", "क़x y", "İstanbul ΣΑΣ ς ß", "it's don't 'SALL", "x_y a1b2 12,3 é.è", "ÅΩ ok", "日本語テキスト です。", "<|endoftext|>a <|startoftext|>.b", "a b c\x1cd\x85e", "ȩ́. f≠g≠", "ﬁne ǅ ʰx", "", "  \n\n ", "word word, WORD! word's", "a" * 5000]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    for most in (0, 1, 3, 1000, 10**6):
        bounds = np.concatenate([[0], np.cumsum(rng.integers(0, most + 1, n))])
        ef = K.EliasFano.build(bounds)
        assert (ef.all() == bounds).all() and all(ef.select(i) == bounds[i] for i in range(0, n + 1, 1 + n // 40))
        ids = rng.integers(0, 65536, min(int(bounds[-1]), 10**6)).astype(np.uint16)
        data = K.write_file(ids, bounds)
        again, ef = K.read_file(data)
        assert (again == ids).all() and (ef.all() == bounds).all() and ef.select(n) == bounds[n]
        if n > 1000 and most == 1000:
            assert (len(data) - ids.nbytes) * 8 / n < np.log2(most / 2) + 4  # bits a document


def test_damaged_file():
    with pytest.raises(ValueError):
        K.read_file(b"nothing of the kind, but long enough to have a head")
    with pytest.raises(ValueError):
        K.read_file(b"")


def test_words_encode_as_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    want = [whole.encode(t, add_special_tokens=False).ids for t in ODD]
    assert K.drops_white_space(PATH)
    for cache in (K.CACHE, 3):
        monkeypatch.setattr(K, "CACHE", cache)
        encode = K.encoder(PATH, np.uint16)
        for texts, ids in ((ODD, want), *(([t], [i]) for t, i in zip(ODD, want, strict=True))):
            assert [np.frombuffer(x, np.uint16).tolist() for x in encode(texts)] == ids


@pytest.mark.parametrize("shard_bytes,file_bytes,most_shards", [(1 << 24, 1 << 24, 1 << 15), (40, 1 << 24, 1 << 15), (1 << 24, 30, 1 << 15), (40, 30, 3)])
def test_files(spark, shard_bytes, file_bytes, most_shards):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(5, None), (5, None), (None, "null id"), (2, "twice"), (2, "twice")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    files = K.write_shards(df, PATH, shard_bytes=shard_bytes, file_bytes=file_bytes, most_shards=most_shards)
    assert min(shard_bytes, file_bytes) > 100 or files.count() > 1
    assert files.select("shard").distinct().count() <= most_shards
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in K.read_shards(files).collect()))
    assert [g[1] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start = 0
    for s, _, n, _ in got:
        assert s == start
        start += n
    ids = [(i, whole.encode(t or "", add_special_tokens=False).ids + [K.END_ID]) for i, t in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((g[1], g[2], g[3]) for g in got), key=repr) == sorted(((i, len(x), crc(x)) for i, x in ids), key=repr)
    assert K.token_output(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    assert not K.drops_white_space(path)
    got = K.token_output(spark.createDataFrame([(1, "a  b\n c")], "doc_id long, text string"), path).first()
    assert got.n_tokens == len(Tokenizer.from_file(path).encode("a  b\n c", add_special_tokens=False).ids) + 1
