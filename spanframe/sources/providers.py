"""Embedding providers: subclass EmbeddingProvider to plug in a model.

A provider is sent to the workers and used there batch by batch; heavy models are loaded once in each worker process.
The ones that need other packages or a network are optional and import them on first use.
"""

from __future__ import annotations

import json
import re
import zlib
from abc import ABC, abstractmethod
from collections.abc import Sequence
from typing import Any

import numpy as np

from ..functions import kernels

_MODELS: dict[tuple, Any] = {}


class EmbeddingProvider(ABC):
    """Vectors for subwords, and which word each subword belongs to."""

    def tokenize(self, text: str) -> list[tuple[str, int, int]]:
        """(token, start, end): words and single other characters."""
        return kernels.tokenize(text)

    @abstractmethod
    def embed(self, words: Sequence[str]) -> np.ndarray:
        """A row for each subword of the words."""

    def subwords(self, words: Sequence[str]) -> tuple[list[str], list[int]]:
        """Subwords and the index of the word of each; by default every word is one."""
        return list(words), list(range(len(words)))

    def embed_text(self, text: str, by_word: bool = False) -> tuple[list[tuple[str, int, int]], np.ndarray, list[int]]:
        """Tokens, vectors and word indices; by_word: the mean of a word's subwords (zeros where there are none)."""
        tokens = self.tokenize(text)
        words = [t[0] for t in tokens]
        if not words:
            return [], np.zeros((0, 0)), []
        vectors, index = np.asarray(self.embed(words), float), self.subwords(words)[1]
        index = index[: len(vectors)]
        if not by_word:
            return tokens, vectors[: len(index)], index
        return tokens, word_means(vectors[: len(index)], index, len(words)), list(range(len(words)))


def word_means(vectors: np.ndarray, index: Sequence[int], n: int) -> np.ndarray:
    sums, count = np.zeros((n, vectors.shape[1] if vectors.ndim == 2 else 0)), np.zeros(n)
    np.add.at(sums, np.asarray(index, int), vectors)
    np.add.at(count, np.asarray(index, int), 1)
    return sums / np.maximum(count, 1)[:, None]


class LetterCounts(EmbeddingProvider):
    """Counts of a-z, 0-9 and everything else: exact in any engine, for tests and SQL comparison."""

    ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"

    def embed(self, words: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.ALPHABET) + 1))
        for row, w in zip(out, words, strict=True):
            for c in w.lower():
                row[self.ALPHABET.find(c)] += 1  # -1: the last column
        return out


class LetterPieces(LetterCounts):
    """LetterCounts of pieces of words, `size` characters each: a model with subwords, exact in any engine."""

    def __init__(self, size: int = 3):
        self.size = size

    def subwords(self, words: Sequence[str]) -> tuple[list[str], list[int]]:
        pieces = [(w[i : i + self.size], n) for n, w in enumerate(words) for i in range(0, len(w), self.size)]
        return [p for p, _ in pieces], [n for _, n in pieces]

    def embed(self, words: Sequence[str]) -> np.ndarray:
        return super().embed(self.subwords(words)[0])


class _Crc(dict):
    """CRC-32 of strings, remembered."""

    def __missing__(self, gram: str) -> int:
        self[gram] = value = zlib.crc32(gram.encode(errors="replace"))
        return value


class HashedNgrams(EmbeddingProvider):
    """Signed hashed character n-grams of words and a little of their neighbours: meaningful without a model."""

    def __init__(self, dim: int = 64, sizes: tuple[int, ...] = (1, 2, 3), context: float = 0.1):
        self.dim, self.sizes, self.context = dim, sizes, context

    def _vectors(self, words: Sequence[str]) -> np.ndarray:
        """Signed counts of the hashed n-grams of marked words: one pass over all of them."""
        grams = _MODELS.setdefault("grams", _Crc())
        if len(grams) > 500_000:
            grams.clear()
        codes, sizes = [], []
        for w in words:
            marked, before = f"<{w.lower()}>", len(codes)
            for n in self.sizes:
                codes += [grams[marked[i : i + n]] for i in range(len(marked) - n + 1)]
            sizes.append(len(codes) - before)
        hashes, row = np.array(codes, np.int64), np.repeat(np.arange(len(words)), sizes)
        return np.bincount(row * self.dim + hashes % self.dim, np.where(hashes >> 31, 1.0, -1.0), len(words) * self.dim).reshape(len(words), self.dim)

    def _own(self, words: Sequence[str]) -> np.ndarray:
        """The words' own vectors; workers remember those of many words, as rows of one matrix."""
        rows, matrix = _MODELS.get(key := ("ngrams", self.dim, self.sizes), ({}, np.zeros((0, self.dim))))
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            if len(rows) + len(new) > 50_000:
                rows, matrix, new = {}, matrix[:0], list(dict.fromkeys(words))
            if len(rows) + len(new) > len(matrix):
                matrix = np.concatenate([matrix[: len(rows)], np.zeros((max(1024, len(rows) + len(new)), self.dim))])
            matrix[len(rows) : len(rows) + len(new)] = self._vectors(new)
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            _MODELS[key] = rows, matrix
        return matrix[[rows[w] for w in words]]

    def embed(self, words: Sequence[str]) -> np.ndarray:
        out = self._own(words)
        near = np.zeros_like(out)
        near[1:] += out[:-1]
        near[:-1] += out[1:]
        return out + self.context * near


class ByWhiteSpace(EmbeddingProvider):
    """Another provider's vectors for the words between white space, punctuation and all."""

    def __init__(self, inner: EmbeddingProvider):
        self.inner = inner

    def tokenize(self, text: str) -> list[tuple[str, int, int]]:
        return [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]

    def embed(self, words: Sequence[str]) -> np.ndarray:
        return self.inner.embed(words)

    def subwords(self, words: Sequence[str]) -> tuple[list[str], list[int]]:
        return self.inner.subwords(words)


class Transformer(EmbeddingProvider):
    """Hidden states of a transformers model, long texts in chunks of whole words."""

    ALIASES = {"bert": "bert-base-multilingual-cased", "xlmr": "xlm-roberta-base", "xlmr-large": "xlm-roberta-large"}

    def __init__(self, model: str = "bert", device: str = "cpu", layer: int = 8):
        self.model, self.device, self.layer = self.ALIASES.get(model, model), device, layer

    def _load(self):
        if (key := (self.model, self.device)) not in _MODELS:
            from transformers import AutoModel, AutoTokenizer

            model = AutoModel.from_pretrained(self.model, output_hidden_states=True).eval().to(self.device)
            _MODELS[key] = model, AutoTokenizer.from_pretrained(self.model)
        return _MODELS[key]

    def subwords(self, words: Sequence[str]) -> tuple[list[str], list[int]]:
        pieces = [self._load()[1].tokenize(w) for w in words]
        return [p for ps in pieces for p in ps], [i for i, ps in enumerate(pieces) for _ in ps]

    def embed(self, words: Sequence[str]) -> np.ndarray:
        import torch

        model, tokenizer = self._load()
        most = min(tokenizer.model_max_length if tokenizer.model_max_length <= 100_000 else 512, 100_000) - 2
        sizes = [len(tokenizer.tokenize(w)) for w in words]
        chunks, now, size = [], [], 0
        for w, n in zip(words, sizes, strict=True):
            if now and size + n > most:
                chunks.append(now)
                now, size = [], 0
            now.append(w)
            size += n
        out = []
        for chunk in [*chunks, now]:
            inputs = tokenizer([chunk], is_split_into_words=True, return_tensors="pt", truncation=True).to(self.device)
            with torch.no_grad():
                states = model(**inputs)["hidden_states"]
            if self.layer >= len(states):
                raise ValueError(f"the model has {len(states) - 1} layers")
            out.append(states[self.layer][0, 1:-1].cpu().numpy())
        return np.concatenate(out)


class HttpEmbeddings(EmbeddingProvider):
    """Vectors from an embedding server: POST {base}/api/embed, up to `chunk` words a request."""

    def __init__(self, model: str = "nomic-embed-text", base: str = "http://localhost:11434", chunk: int = 500, timeout: float = 60):
        self.model, self.base, self.chunk, self.timeout = model, base.rstrip("/"), chunk, timeout

    def embed(self, words: Sequence[str]) -> np.ndarray:
        from urllib.request import Request, urlopen

        out = []
        for i in range(0, len(words), self.chunk):
            body = json.dumps({"model": self.model, "input": list(words[i : i + self.chunk])}).encode()
            with urlopen(Request(f"{self.base}/api/embed", body, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
                out += json.load(answer)["embeddings"]
        return np.array(out, np.float32)


class SentenceModel(EmbeddingProvider):
    """Vectors from a sentence-transformers model, each word encoded by itself."""

    def __init__(self, model: str = "paraphrase-multilingual-MiniLM-L12-v2", device: str = "cpu", chunk: int = 250):
        self.model, self.device, self.chunk = model, device, chunk

    def embed(self, words: Sequence[str]) -> np.ndarray:
        if (key := ("sentence", self.model, self.device)) not in _MODELS:
            from sentence_transformers import SentenceTransformer

            _MODELS[key] = SentenceTransformer(self.model, device=self.device)
        return np.concatenate([_MODELS[key].encode(list(words[i : i + self.chunk])) for i in range(0, len(words), self.chunk)])
