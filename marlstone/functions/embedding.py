"""Text embedding by an injectable function; a local one hashes words with signs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts to vectors, one row each.
Embedder = Callable[[list[str]], np.ndarray]
# The instruction that goes before queries of an asymmetric model, and a model's dimension.
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
DIMENSION = 768
#: Words whose places a worker remembers, and texts that are embedded at one time.
CACHE_WORDS, BATCH = 200_000, 256


class HashingEmbedder:
    """Counts of words, each at the place and with the sign that its MD5 gives: the first four bytes modulo the dimension,
    and the lowest bit of the fifth (one: minus). Words are runs without ASCII white space, in lower case.
    """

    def __init__(self, dimension: int = DIMENSION) -> None:
        self.dimension, self.known = dimension, {}

    def _place(self, word: str) -> tuple[int, int]:
        if (found := self.known.get(word)) is None:
            digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()
            found = int.from_bytes(digest[:4], "big") % self.dimension, -1 if digest[4] & 1 else 1
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().encode("utf-8", "surrogatepass").split():
                place, sign = self._place(word.decode("utf-8", "surrogatepass"))
                row[place] += sign
        return out


def embed(rows: DataFrame, embedder: Embedder, dimension: int, text: str = "text", instruction: str = "", normalize: bool = True, name: str = "embedding") -> DataFrame:
    """rows with the column `name`: the vector of instruction and text, at length one if normalize is set (a vector
    without a direction stays as it is).

    A null text, one of white space alone, a vector of another length than dimension, or of anything but finite numbers
    fails the query, as it would be found by no search. Chunks are embedded bare; queries with their model's instruction.
    """
    kinds = dict(rows.dtypes)
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(place).to_pylist()
                if any(t is None or not t.strip() for t in texts):
                    raise ValueError("an empty text cannot be embedded")
                vectors = np.asarray(embedder([instruction + t for t in texts]), float)
                if vectors.shape != (len(texts), dimension) or not np.isfinite(vectors).all():
                    raise ValueError(f"vectors of shape {vectors.shape} instead of {(len(texts), dimension)}, or not finite")
                if normalize:
                    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                    vectors = vectors / np.where(norm > 0, norm, 1)
                made = pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), dimension).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    return rows.select(*(F.col(f"`{c}`") for c in rows.columns)).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + f", `{name}` array<double>")
