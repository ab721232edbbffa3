"""Token counts: batches of about equal bytes go to the library, which returns lengths only.

A text is cut where a space follows a character that is no space: no piece of such a model holds the space mark after
another character, so no merge crosses the cut, and the model's dummy prefix stands for the space that the cut takes
away. Pieces that a batch holds many times are encoded once. Null and empty texts count 0; repeated rows, ties and
further columns need no care, since each row is counted by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import by_bytes, id_text

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_models: dict = {}


def model(path: str):
    """The model, loaded once in each worker; only one whose pieces allow the cut."""
    if path not in _models:
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [found.id_to_piece(i) for i in range(found.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of this model goes over the end of a word")
        _models[path] = found
    return _models[path]


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a piece starts: each row's start, and each space after a character that is neither space nor space mark."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = data == 0x20
    cut[1:] &= data[:-1] != 0x20
    if (data == 0x96).any():
        mark = np.zeros(len(data), bool)
        mark[3:] = (data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81)
        cut &= ~mark
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


def counted(batch: pa.RecordBatch, path: str, limit: int) -> pa.RecordBatch:
    data, offsets = K.buffer(batch.column("text"))
    starts = safe_cuts(data, offsets)
    ends = np.append(starts[1:], len(data))
    at_start = np.isin(starts, offsets)
    starts = starts + ~at_start  # the dummy prefix stands for this space
    codes, item = K.factorize(K.range_hashes(data, starts, ends), ends - starts)
    raw = data.tobytes()
    texts = [raw[s:e].decode() for s, e in zip(starts[item].tolist(), ends[item].tolist(), strict=True)]
    lengths = np.fromiter(map(len, model(path).encode(texts, num_threads=1)), np.int64, len(texts))
    # A cut before a space that ends the text leaves an empty piece, which still is the mark of that space.
    lengths[(ends - starts)[item] == 0] = len(model(path).encode("a ")) - len(model(path).encode("a"))
    sums = np.concatenate([[0], np.cumsum(lengths[codes])]) if len(codes) else np.zeros(1, np.int64)
    first = np.searchsorted(starts - ~at_start, offsets)
    tokens = sums[first[1:]] - sums[first[:-1]]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text, by the model at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield counted(batch, path, limit)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
