"""Evaluation texts inside training documents, found by greedy string tiling.

Words are compared whatever their case and whatever stands between them. A rolling (Karp-Rabin) hash of the words
of every document is looked up among the hashes of the test items; where seeds meet, the longest common runs are
marked first and never overlap, so reordered passages add up to the share of the item that the document covers.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run of words that is a tile.
MIN_TILE = 5
#: Words of test items in one broadcast; a larger test set is searched block by block.
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x100000001B3)


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


def _rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` ids."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        out = out * _BASE + mixed[j : j + len(out)]
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles: longest first, then leftmost, none overlapping."""
    runs = []
    where: dict[int, list[int]] = {}
    for j, h in enumerate(_rolling(item, least).tolist()):
        where.setdefault(h, []).append(j)
    seen = set()
    for i, h in enumerate(_rolling(doc, least).tolist()):
        for j in where.get(h, ()):
            if (i - 1, j - 1) in seen:  # inside a run that is already known
                seen.add((i, j))
                continue
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] >= 0:
                n += 1
            if n >= least:
                seen.add((i, j))
                runs.append((n, i, j))
    import heapq

    heap = [(-n, i, j) for n, i, j in runs]
    heapq.heapify(heap)
    in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = in_doc[i : i + n] | in_item[j : j + n]
        if taken.any():  # what is left of the run competes again
            free = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(int)))
            for a, b in zip(free[::2], free[1::2], strict=True):
                if b - a >= least:
                    heapq.heappush(heap, (-(int(b) - int(a)), i + int(a), j + int(a)))
            continue
        in_doc[i : i + n] = in_item[j : j + n] = True
        out.append((i, j, n))
    return out


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_tile: int = MIN_TILE) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_words, n_tiles) of every document that shares at least one run of
    ``min_tile`` words with a test item. ``covered`` counts words of the item in tiles.

    Null or empty texts share nothing, nor do items shorter than ``min_tile``. Repeated documents and items give
    their rows each. Ids keep their type.
    """
    sized = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    blocks: list[list[tuple]] = [[]]
    room = BLOCK_WORDS
    for r in sized.toLocalIterator():
        n = len(words(r.t))
        if n > room and blocks[-1]:
            blocks.append([])
            room = BLOCK_WORDS
        blocks[-1].append((r.i, r.t))
        room -= n
    out = [_search(docs, doc_id, text, b, items.schema[item_id].dataType.simpleString(), item_id, min_tile) for b in blocks]
    return reduce(DataFrame.unionByName, out)


def _search(docs: DataFrame, doc_id: str, text: str, block: list[tuple], item_type: str, item_id: str, least: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)
    name = f"{uuid.uuid4()}"

    def prepare() -> dict:
        import sys
        import types

        # one index a worker process, whatever number of tasks it runs; the last few blocks are kept
        kept = sys.modules.setdefault("_termloom_leaks", types.ModuleType("_termloom_leaks")).__dict__.setdefault("blocks", {})
        state = kept.get(name)
        if state is None:
            while len(kept) > 3:
                kept.pop(next(iter(kept)))
            state = kept[name] = {}
            vocab: dict[str, int] = {}
            ids, seeds, owner = [], [], []
            for n, (_, t) in enumerate(held.value):
                a = np.array([vocab.setdefault(w, len(vocab)) for w in words(t)], np.int64)
                ids.append(a)
                h = _rolling(a, least)
                seeds.append(h)
                owner.append(np.full(len(h), n))
            h, o = np.concatenate([*seeds, np.zeros(0, np.uint64)]), np.concatenate([*owner, np.zeros(0, int)])
            order = np.argsort(h, kind="stable")
            state.update(vocab=vocab, ids=ids, seeds=h[order], owner=o[order])
        return state

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = prepare()
        get = s["vocab"].get
        for batch in batches:
            rows = []
            for d, t in zip(batch["d"], batch["t"], strict=True):
                a = np.array([get(w, -1) for w in words(t)], np.int64)
                if len(a) < least or not len(s["seeds"]):
                    continue
                h = _rolling(a, least)
                known = np.convolve(a >= 0, np.ones(least, int), "valid") == least
                lo = np.searchsorted(s["seeds"], h[known])
                hi = np.searchsorted(s["seeds"], h[known], side="right")
                hit = hi > lo
                if not hit.any():
                    continue
                for n in sorted({int(x) for p, q in zip(lo[hit], hi[hit], strict=True) for x in s["owner"][p:q]}):
                    found = tiles(a, s["ids"][n], least)
                    if found:
                        rows.append((d, held.value[n][0], max(x[2] for x in found), sum(x[2] for x in found), len(s["ids"][n]), len(found)))
            yield pd.DataFrame(rows, columns=[doc_id, item_id, "longest", "covered", "item_words", "n_tiles"])

    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, `{item_id}` {item_type}, longest int, covered int, item_words int, n_tiles int"
    chosen = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).where("t is not null")
    return chosen.mapInPandas(run, schema)
