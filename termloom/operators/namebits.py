"""Which runs of tokens may be names: a filter of the names' hashes, asked before anything is shuffled.

A run's hash rolls over the hashes of its tokens, so all runs of a text are asked for as arrays and none is spelled out
but those that the filter lets through. The filter never misses a name; what it lets through in error goes out in
the exact join that follows. Bits follow the number of names, 64 MB at most; beyond that it only lets more runs through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T

#: Segments by the highest byte of a hash, and the least and most bits of one; 256 of the largest have 64 MB.
SEGMENTS, LEAST_BITS, MOST_BITS, BITS_PER_NAME = 256, 1 << 10, 1 << 21, 32
#: Characters of text that are looked at together, so long texts need no more memory than short ones.
PORTION = 1 << 21
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _token_hashes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and whether it is empty or a stop word."""
    coded = flat.dictionary_encode()
    own = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    at = coded.indices.to_numpy(zero_copy_only=False)
    stop = np.isin(own.astype(str), ["", *T.STOPWORDS])
    return pd.util.hash_array(own, categorize=False)[at], stop[at]


def _split(keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(keys.cast(pa.large_string()), " ")
    return lists.flatten(), lists.offsets.to_numpy()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _places(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Segment of each hash and three places, still to be masked by the segment's size."""
    m = _mixed(h)
    return (m >> np.uint64(56)).astype(np.int64), [m.astype(np.int64), (m >> np.uint64(21)).astype(np.int64), ((m * _ROLL) >> np.uint64(20)).astype(np.int64)]


def name_hashes(keys: pa.Array) -> np.ndarray:
    """Hash of each key as a whole."""
    flat, offsets = _split(keys)
    token, _ = _token_hashes(flat)
    sizes, h = np.diff(offsets), np.zeros(len(keys), np.uint64)
    for n in range(int(sizes.max(initial=0))):
        more = np.flatnonzero(sizes > n)
        h[more] = h[more] * _ROLL + token[offsets[:-1][more] + n]
    return h


def name_bits(names: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, first byte of each segment, mask of each segment) of the keys of names (key)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = name_hashes(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(_places(h)[0].astype(np.int32)), pa.array(h.astype(np.int64))], ["segment", "h"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for s, part in b.groupby("segment")["h"]:
                held.setdefault(int(s), []).append(part.to_numpy())
        out = []
        for s, parts in held.items():
            h = np.concatenate(parts).astype(np.uint64)
            size = min(MOST_BITS, max(LEAST_BITS, 1 << (len(h) * BITS_PER_NAME - 1).bit_length()))
            bits = np.zeros(size, bool)
            for at in _places(h)[1]:
                bits[at & (size - 1)] = True
            out.append((s, np.packbits(bits, bitorder="little").tobytes()))
        yield pd.DataFrame(out, columns=["segment", "bits"])

    found = names.where("key is not null").select("key").mapInArrow(hashed, "segment int, h long").repartition("segment").mapInPandas(merged, "segment int, bits binary")
    bits = {r.segment: bytes(r.bits) for r in found.toLocalIterator()}
    parts = [bits.get(s, bytes(LEAST_BITS // 8)) for s in range(SEGMENTS)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes * 8 - 1


def may_be_name(h: np.ndarray, bits: np.ndarray, first: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter holds."""
    left = np.arange(len(h))
    for i in range(3):
        segment, places = _places(h[left])
        at = places[i] & mask[segment]
        left = left[bits[first[segment] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1 == 1]
    return left


def possible(docs: DataFrame, names: DataFrame, most_tokens: int) -> DataFrame:
    """(doc, start, key, size, content) of the runs of at most ``most_tokens`` tokens in docs (doc, text) that may be among
    names (key), none with a stop word at its edge; size and content are the document's tokens and those of them that are
    no stop words."""
    held = docs.sparkSession.sparkContext.broadcast(name_bits(names))

    def runs(doc: pa.Array, keys: pa.Array, types: pa.Schema) -> pa.RecordBatch:
        flat, offsets = _split(keys)
        token, stop = _token_hashes(flat)
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(keys)), sizes)
        left = offsets[1:][row] - np.arange(len(row))
        told = np.concatenate([[0], np.cumsum(~stop)])
        content = told[offsets[1:]] - told[offsets[:-1]]
        at, h, starts, lengths = np.flatnonzero(~stop), np.zeros(int((~stop).sum()), np.uint64), [], []
        for n in range(1, most_tokens + 1):
            there = left[at] >= n
            at, h = at[there], h[there]
            h = h * _ROLL + token[at + n - 1]
            ends = np.flatnonzero(~stop[at + n - 1])
            hit = at[ends[may_be_name(h[ends], *held.value)]]
            starts.append(hit)
            lengths.append(np.full(len(hit), n))
        start, length = np.concatenate(starts), np.concatenate(lengths)
        key = [" ".join(flat.slice(s, n).to_pylist()) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
        own = row[start]
        columns = [doc.take(pa.array(own)), start - offsets[:-1][own] + 1, key, sizes[own], content[own]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.not_equal(b.column("key"), ""), False))
            types = pa.schema([("doc", b.schema.field("doc").type), ("start", pa.int32()), ("key", pa.string()), ("size", pa.int32()), ("content", pa.int32())])
            portion = np.cumsum(pc.binary_length(b.column("key")).to_numpy(zero_copy_only=False).astype(np.int64)) // PORTION
            edges = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), b.num_rows]
            for a, e in zip(edges, edges[1:], strict=False):
                if e > a:
                    yield runs(b.column("doc").slice(a, e - a), b.column("key").slice(a, e - a), types)

    kept = docs.select("doc", T.normalized_key(F.col("text")).alias("key"))
    return kept.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, start int, key string, size int, content int")
