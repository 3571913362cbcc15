"""Models behind small interfaces, and deterministic stand-ins for tests and offline use."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    """Scores how well texts answer a question."""

    def score(self, question: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    """Completes a prompt, at once or in pieces."""

    def complete(self, system: str, prompt: str) -> str: ...

    def stream(self, system: str, prompt: str) -> Iterator[str]: ...


class TokenCounter(Protocol):
    def count(self, text: str) -> int: ...


class PageReader(Protocol):
    """Reads the page texts of a stored file."""

    def pages(self, content: bytes) -> list[str]: ...


class HashingEmbedder:
    """Signed feature hashing of words; unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            raise ValueError("no texts to embed")
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class OverlapScorer:
    """The number of distinct words of the question that a text has."""

    def score(self, question: str, texts: list[str]) -> list[float]:
        asked = set(question.lower().split())
        return [float(len(asked & set(t.lower().split()))) for t in texts]


class ExtractiveGenerator:
    """Answers with the first excerpt of its prompt."""

    def complete(self, system: str, prompt: str) -> str:
        return "".join(self.stream(system, prompt))

    def stream(self, system: str, prompt: str) -> Iterator[str]:
        body = prompt.partition("Excerpts:\n")[2] or prompt
        for word in body.split("\n\n")[0].split(" "):
            yield word + " "


class WordCounter:
    """Words between white space."""

    def count(self, text: str) -> int:
        return len(text.split())


class BpeCounter:
    """Tokens of a byte-pair vocabulary (a file of the tokenizers library), opened by each worker that counts; special tokens are plain text."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "tokenizer": None}

    def count(self, text: str) -> int:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


class PlainPages:
    """Form feeds between the pages of a text file."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")


def pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of texts (texts, tokens, dim): the mean over unmasked tokens."""
    weight = mask[..., None].astype(np.float32)
    mean = (tokens * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(norm > 0, norm, 1)


def with_retries(call, tries: int = 3, wait=lambda n: min(10.0, 4.0 * 2**n), sleep=None):
    """Calls until it succeeds, at most `tries` times, waiting longer each time."""
    import time

    for n in range(tries):
        try:
            return call()
        except Exception:
            if n + 1 == tries:
                raise
            (sleep or time.sleep)(wait(n))
