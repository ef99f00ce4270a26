"""Records that differ only in formatting: one row per record, with its copies.

Two passes over the keys. The first puts every canonical key into Bloom filters of keys seen once and keys seen
repeatedly, built per batch and merged per segment of the bit space. The second sends only rows whose key the
"repeated" filter may hold into the exact grouping; all others are singletons and are never shuffled. A filter
never misses a repeated key, so the result is exact whatever its size; a crowded filter only lets more rows
through. It is not let to crowd: its bits follow the number of distinct keys, and where these need more than the
segments that may be broadcast, the keys are taken share by share, each with a filter of its own. Only the 16-byte
keys and ids are read once a share; the rows are not.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import cut

_NOISE = regex.compile(r"(?<=\d)\.(?=\d)(*SKIP)(*FAIL)|[^\p{L}\p{N}\p{M},;|]+")
_PARTS = regex.compile(r"[,;|]")


def content(text: str | None) -> str | None:
    """What a field says: letters (accents count, case and compatibility forms do not), digits and points between
    two digits; parts divided by comma, semicolon or bar in any order. None if null or without content."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    parts = sorted(p for p in _PARTS.split(_NOISE.sub("", text)) if p)
    return "|".join(parts) or None


def content_column(field: Column) -> Column:
    @F.pandas_udf("string")
    def convert(text: pd.Series) -> pd.Series:
        return pd.Series([content(t) for t in text], dtype=object)

    return convert(field)


def canonical_key(exact: list[Column], field: Column) -> Column:
    """128-bit key of a record: its exact columns and the content of ``field``; null if any of them is null or the
    field has no content, since such rows never match."""
    fields = [c.cast("string") for c in exact] + [content_column(field)]
    sane = F.lit(True)
    for c in fields[:-1]:
        sane = sane & c.isNotNull()
    joined = F.concat_ws("\u001f", *fields)
    return F.when(sane & fields[-1].isNotNull(), F.md5(joined))


#: Bits of a segment; segments are merged one by one, so no task holds more than a few of them.
SEGMENT_BITS = 1 << 20
#: At most so many segments (64 MB of bits in all) are broadcast at a time; more keys are taken in several shares.
MAX_SEGMENTS = 512
BITS_PER_KEY = 12


def _positions(keys: np.ndarray, segments: int) -> np.ndarray:
    """Two bit positions of each key, both in the key's own segment."""
    h1 = keys & np.uint64(0xFFFFFFFF)
    h2 = keys >> np.uint64(32)
    seg = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(segments)
    return np.stack([seg * np.uint64(SEGMENT_BITS) + h % np.uint64(SEGMENT_BITS) for h in (h1, h2)])


def _pack(sorted_positions: np.ndarray) -> bytes:
    return zlib.compress(np.diff(sorted_positions.astype("<i4"), prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"))


def filter_shares(keys: int) -> int:
    """How many filters of at most MAX_SEGMENTS the distinct keys need."""
    return max(1, -(-keys * BITS_PER_KEY // (SEGMENT_BITS * MAX_SEGMENTS)))


def repeated_filter(keys: DataFrame, column: str, rows: int) -> tuple[int, dict[int, bytes]]:
    """(number of segments, bits by segment) of a filter that holds every value of ``column`` occurring twice."""
    segments = max(1, min(MAX_SEGMENTS, -(-rows * BITS_PER_KEY // SEGMENT_BITS)))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            out = []
            for flag, chosen in ((False, values), (True, values[counts > 1])):
                if len(chosen):
                    pos = np.unique(_positions(chosen, segments).ravel())
                    seg, at = np.unique(pos // np.uint64(SEGMENT_BITS), return_index=True)
                    for s, part in zip(seg, np.split(pos % np.uint64(SEGMENT_BITS), at[1:]), strict=True):
                        out.append((int(s), flag, _pack(part)))
            return pd.DataFrame(out, columns=["segment", "repeated", "bits"])

        for b in batches:
            held.append(np.frombuffer(b"".join(bytes.fromhex(k[:16]) for k in b["k"]), ">u8").astype(np.uint64))
            if sum(map(len, held)) >= 1 << 20:
                yield flush()
        if held and sum(map(len, held)):
            yield flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for b in batches:
            for s, flag, data in zip(b["segment"], b["repeated"], b["bits"], strict=True):
                if s not in once:
                    once[s], twice[s] = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                at = _unpack(data)
                if not flag:
                    twice[s][at] |= once[s][at]
                    once[s][at] = True
                else:
                    twice[s][at] = True
        yield pd.DataFrame([(s, np.packbits(t).tobytes()) for s, t in twice.items() if t.any()], columns=["segment", "bits"])

    parts = keys.where(F.col(column).isNotNull()).select(F.col(column).alias("k")).mapInPandas(local, "segment int, repeated boolean, bits binary")
    merged = parts.repartition(min(segments, 64), "segment").mapInPandas(merge, "segment int, bits binary")
    return segments, {r.segment: bytes(r.bits) for r in merged.toLocalIterator()}


def may_repeat(keys: DataFrame, column: str, segments: int, bits: dict[int, bytes]) -> Column:
    """Whether the filter may hold ``column``; never false for a value that occurs twice."""
    held = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(k: pd.Series) -> pd.Series:
        have = k.notna().to_numpy()
        out = np.zeros(len(k), bool)
        if have.any():
            h = np.frombuffer(b"".join(bytes.fromhex(x[:16]) for x in k[have]), ">u8").astype(np.uint64)
            ok = np.ones(len(h), bool)
            for pos in _positions(h, segments):
                seg, at = (pos // np.uint64(SEGMENT_BITS)).astype(int), (pos % np.uint64(SEGMENT_BITS)).astype(int)
                for s in np.unique(seg):
                    rows = seg == s
                    data = held.value.get(int(s))
                    ok[rows] &= False if data is None else (np.frombuffer(data, np.uint8)[at[rows] >> 3] >> (7 - (at[rows] & 7)) & 1).astype(bool)
            out[have] = ok
        return pd.Series(out)

    return test(F.col(column))


def collapse(rows: DataFrame, id_column: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """(records, members) of rows by canonical ``key``.

    records: ``row_id`` (the smallest of the copies) and ``n_copies``, one row a record; members: ``row_id`` of
    every further copy with the record it belongs to (``record``). Rows without a key are records of their own.
    Repeated ids count as separate rows. A group may hold any share of the rows: groups are counted by partial
    aggregation, and rows of the largest groups meet them by broadcast, not by a shuffle to one task.
    """
    keyed = cut(rows.select(F.col(f"`{id_column}`").alias("row_id"), key.alias("k")))
    n, distinct = keyed.agg(F.count("*"), F.approx_count_distinct("k", 0.02)).first()
    most = int(distinct * 1.05) + 1
    shares = filter_shares(most)
    # the digits that tell the share are none of those the filter goes by
    share = F.pmod(F.conv(F.substring("k", 17, 8), 16, 10).cast("long"), F.lit(shares))
    told = []
    for i in range(shares):
        part = keyed if shares == 1 else keyed.where(share == i)
        told.append(part.withColumn("repeats", may_repeat(part, "k", *repeated_filter(part, "k", -(-most // shares)))))
    told += [keyed.where("k is null").withColumn("repeats", F.lit(False))] if shares > 1 else []
    keyed = cut(reduce(DataFrame.unionByName, told))
    maybe = keyed.where("repeats")
    groups = cut(maybe.groupBy("k").agg(F.min("row_id").alias("record"), F.count("*").alias("n_copies")).where("n_copies > 1"))
    # at most HOT groups have this many rows, so they can be broadcast
    hot_size = max(10_000, n // HOT)
    hot = groups.where(F.col("n_copies") >= hot_size)
    big = maybe.join(F.broadcast(hot), "k")
    small = maybe.join(F.broadcast(hot.select("k")), "k", "left_anti").join(groups.where(F.col("n_copies") < hot_size), "k")
    inside = big.unionByName(small)
    # of equal ids one stands for the record and the others are its copies
    members = inside.where("row_id <> record").select("row_id", "record")
    single = keyed.where("not repeats")
    lone = maybe.join(F.broadcast(hot.select("k")), "k", "left_anti").join(groups.select("k"), "k", "left_anti")
    records = groups.select(F.col("record").alias("row_id"), "n_copies").unionByName(single.unionByName(lone).select("row_id", F.lit(1).cast("long").alias("n_copies")))
    return records, members


HOT = 1_000
