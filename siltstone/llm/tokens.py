"""Encoding of whole tables with a public byte-level BPE, by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged, so the
place between them is a certain cut. Texts are cut there, the fragments (which repeat a lot)
are encoded independently and their ids put together again.

Cuts are used only where the pre-tokenizer cannot tell the difference either: not after white
space (a run of it is split by what follows), not before an apostrophe (contractions are
looked for at the start of a piece), not inside a character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments that a Python worker remembers; then it starts afresh.
REMEMBERED = 400_000
#: Bytes of text that are cut at once.
SLICE = 4 << 20


def merge_ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def certain_cuts(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """never[a * 256 + b]: a then b occurs inside no token; the bytes a cut may follow; may precede."""
    never = np.ones(1 << 16, bool)
    for token in ranks:
        for a, b in zip(token, token[1:]):
            never[a << 8 | b] = False
    code = np.arange(256)
    # White space of several bytes ends with one of these; such places stay uncut.
    spaces = np.isin(code, [0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)])
    after = (code > 0x20) & (code != 0x7F) & ~spaces
    before = ((code < 0x80) | (code >= 0xC0)) & (code != ord("'"))
    return never, after, before


class Encoder:
    """Encodes Arrow string arrays; lives once in each Python worker."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = merge_ranks(vocabulary)
        self.never, self.after, self.before = certain_cuts(ranks)
        self.bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, tuple[int, ...]] = {}

    def fragments(self, data: bytes, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The fragments of texts that lie end to end, and where each text ends among them."""
        u = np.frombuffer(data, np.uint8)
        pair = u[:-1].astype(np.uint16) << 8 | u[1:]
        at = np.flatnonzero(self.never[pair] & self.after[u[:-1]] & self.before[u[1:]]) + 1
        edges = np.union1d(at, ends)
        edges = edges[edges > 0]
        where = edges.tolist()
        return [data[a:b] for a, b in zip([0, *where], where)], np.searchsorted(edges, ends, "right")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids up to the end of each text); null and empty texts have none."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data = texts.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()
        pieces, counts = self.fragments(data, offsets[1:] - offsets[0])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for x in set(pieces).difference(known):
            known[x] = tuple(self.bpe.encode_ordinary(x.decode()))
        ids = [known[x] for x in pieces]
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        return np.fromiter(chain.from_iterable(ids), np.int32, int(upto[-1])), upto[counts]


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of about SLICE bytes, each at least one text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, int(offsets[start]) + SLICE, "right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, sent once to each executor: under 1 MB whatever the data's size."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str, text_col: str | Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens.

    Null and empty texts give an empty list; blank text is encoded as it is; strings of
    special tokens are ordinary text. Rows are neither grouped nor moved: repeated ids and null
    ids come out as they went in, and an empty table gives an empty table.
    """
    words = _vocabulary(df, vocabulary)
    text = df[text_col] if isinstance(text_col, str) else text_col
    rows = df.select(df[id_col].alias("id"), text.alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(words.value)
        for batch in batches:
            start = 0
            for texts in _slices(batch.column(1).cast(pa.string())):
                ids, upto = coder.encode(texts)
                ends = pa.array(np.concatenate([[0], upto]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(ends, pa.array(ids))], ["id", "ids"])
                start += len(texts)

    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids")


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens bigint) of every row, as `encode` would give them; 0 for null and empty texts."""
    words = _vocabulary(df, vocabulary)
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(words.value)
        for batch in batches:
            start = 0
            for texts in _slices(batch.column(1).cast(pa.string())):
                _, upto = coder.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(np.diff(upto, prepend=0))], ["id", "tokens"])
                start += len(texts)

    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "tokens")
