"""Encoding of texts with a byte-level BPE vocabulary, through a sentencepiece model written here.

The vocabulary file gives byte strings and ranks. Each becomes a sentencepiece piece whose
characters stand one for each byte and whose score is the negative rank, so that sentencepiece's
merge order is the vocabulary's. The model has the identity normalisation and no dummy prefix; the
regular expression that splits a text comes first, and each distinct pre-token is encoded once.

Defined results: an empty and a null text have the empty list; strings that look like special
tokens are ordinary text; each row gives one row, in whatever order, repeated ids included.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the published pre-token pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens kept by a worker before it starts anew, and the longest one kept.
CACHE, CACHED_LENGTH = 400_000, 64
_BYTE_CHARS = "".join(chr(0x100 + b) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file, by rank; the ranks must run from 0 without a gap."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    by_rank = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError(f"{path}: ranks have gaps")
    return [by_rank[i] for i in range(len(by_rank))]


def as_model(ranks: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; piece ids are the ranks, the unknown piece has the id after them."""
    import struct

    pieces = []
    for rank, token in enumerate(ranks):
        text = codecs.charmap_decode(token, "strict", _BYTE_CHARS)[0].encode()
        pieces.append(_field(1, _field(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2)))
    minus = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(n, minus) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encodes texts by a rank file; decode is the inverse."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=as_model(self.ranks))
        self._split = regex.compile(PATTERN).findall
        self._known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self._split(t) if t else [] for t in texts]
        if len(self._known) > CACHE:
            self._known = {}
        known = self._known
        new = list({t for tokens in split for t in tokens if t not in known})
        ids = self._model.encode([codecs.charmap_decode(t.encode(), "strict", _BYTE_CHARS)[0] for t in new], out_type=int, num_threads=1) if new else []
        fresh = dict(zip(new, ids))
        known.update(fresh)
        out = []
        for tokens in split:
            row: list[int] = []
            for t in tokens:
                row += known[t]
            out.append(row)
        for t in new:
            if len(t) > CACHED_LENGTH:
                del known[t]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.ranks[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _vocabulary(df: DataFrame, name: str, folder: str) -> str:
    """Name of the rank file among those given to all executors."""
    path = os.path.join(folder, f"{name}.tiktoken")
    sc = df.sparkSession.sparkContext
    given = getattr(sc, "_papergrid_files", {})
    if given.setdefault(os.path.basename(path), path) != path:
        raise ValueError(f"another folder's {os.path.basename(path)} was given to the executors before")
    if not hasattr(sc, "_papergrid_files") or path not in sc._papergrid_sent:
        sc._papergrid_files, sc._papergrid_sent = given, getattr(sc, "_papergrid_sent", set()) | {path}
        sc.addFile(path)
    return os.path.basename(path)


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids array<int>) of each row's text."""
    name = _vocabulary(df, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = pa.array(own.encode_batch(part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["k", "ids"])

    kept = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return kept.mapInArrow(run, f"k {kept.schema['k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, text) of each row's ids; null ids give null."""
    name = _vocabulary(df, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["k", "text"])

    kept = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    return kept.mapInArrow(run, f"k {kept.schema['k'].dataType.simpleString()}, text string").withColumnRenamed("k", key)
