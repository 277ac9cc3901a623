"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

A window similar to an item shares a shingle with it, so only windows that overlap a shared shingle are fingerprinted;
this loses no window of similarity above 0. A window's 64-bit SimHash is cut into BLOCKS; fingerprints within RADIUS
agree to RADIUS // BLOCKS bits in one block at least, so probing each block's neighbourhood finds all of them.
Those are verified by weighted Jaccard similarity over multisets of shingles.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import NOT_WORD, beside, listed, shingles, small_batches, text_batches, words

RADIUS = 20
BLOCKS = 8
#: Items that are broadcast at once (about 1 KB each); more items take more passes over the documents.
ITEMS = 20_000

_BITS = np.arange(64, dtype=np.uint64)


def plain_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, ASCII punctuation between words, so capitals and marks hide no passage."""
    return words([(t or "").lower().encode() for t in texts], NOT_WORD)


def simhash(values: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, each weighted by how often it occurs; ties give 1."""
    ones = ((values[:, None] >> _BITS) & np.uint64(1)).sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BITS[2 * ones >= len(values)]).sum(dtype=np.uint64))


def _near_bytes(distance: int) -> list[list[int]]:
    return [[y for y in range(256) if (x ^ y).bit_count() <= distance] for x in range(256)]


class Index:
    """Items by id: their shingle multisets, fingerprints, and for each block the items by its 8 bits' neighbourhood."""

    def __init__(self, items: list[tuple[int, str]], k: int, radius: int) -> None:
        self.k, self.radius, self.items, self.prints = k, radius, [], []
        self.by_shingle: dict[int, list[int]] = {}
        hashes, bounds = plain_words([t for _, t in items])
        for (item, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            values = shingles(hashes[a:b], min(k, b - a))
            self.items.append((item, int(b - a), min(k, int(b - a)), Counter(values.tolist())))
            self.prints.append(simhash(values))
            for v in set(values.tolist()):
                self.by_shingle.setdefault(v, []).append(len(self.items) - 1)
        self.sizes = sorted({size for _, _, size, _ in self.items})
        self.known = np.array(sorted(self.by_shingle), np.uint64)
        near = _near_bytes(radius // BLOCKS)
        self.blocks: list[dict[int, set[int]]] = [{} for _ in range(BLOCKS)]
        for i, p in enumerate(self.prints):
            for j, table in enumerate(self.blocks):
                for y in near[(p >> 8 * j) & 255]:
                    table.setdefault(y, set()).add(i)

    def within(self, fingerprint: int) -> list[int]:
        """All items whose fingerprint is within the radius."""
        found = set().union(*(t.get((fingerprint >> 8 * j) & 255, ()) for j, t in enumerate(self.blocks)))
        return [i for i in found if (self.prints[i] ^ fingerprint).bit_count() <= self.radius]


def _weighted(a: Counter, b: Counter) -> tuple[int, int]:
    both = sum(min(n, b[v]) for v, n in a.items() if v in b)
    return both, sum(a.values()) + sum(b.values()) - both


def match_text(index: Index, hashes: np.ndarray, valid: dict[int, np.ndarray], num: int, den: int) -> dict[int, tuple[int, int, int, int]]:
    """Items found in one text: index of the item to the best (intersection, union, first word, words)."""
    best: dict[int, tuple[int, int, int, int]] = {}
    done: set[tuple[int, int]] = set()
    prints: dict[tuple[int, int, int], tuple[int, Counter]] = {}
    n_words = len(hashes)
    for size, values in valid.items():
        for at in np.flatnonzero(np.isin(values, index.known)).tolist():
            for i in index.by_shingle[int(values[at])]:
                item_words, item_size = index.items[i][1:3]
                if item_size != size:
                    continue
                width = min(item_words, n_words)
                for start in range(max(0, at + size - width), min(at, n_words - width) + 1):
                    if (i, start) in done:
                        continue
                    done.add((i, start))
                    key = (size, start, width)
                    if key not in prints:
                        window = values[start : start + width - size + 1]
                        prints[key] = simhash(window), Counter(window.tolist())
                    fingerprint, window = prints[key]
                    for j in index.within(fingerprint):
                        both, either = _weighted(window, index.items[j][3])
                        if den * both >= num * either and (j not in best or both * best[j][1] > best[j][0] * either):
                            best[j] = (both, either, start, width)
    return best


def _match(shared, num: int, den: int):
    def run(batches):
        index: Index = shared.value
        for batch in text_batches(batches):
            hashes, bounds = plain_words(batch.column("text").to_pylist())
            whole = {size: shingles(hashes, size) for size in index.sizes}
            hit = {size: np.flatnonzero(np.isin(v, index.known)) for size, v in whole.items()}
            texts = np.unique(np.concatenate([np.searchsorted(bounds, h, side="right") - 1 for h in hit.values()] or [np.zeros(0, np.int64)]))
            out = []
            for t in texts.tolist():
                a, b = int(bounds[t]), int(bounds[t + 1])
                valid = {size: v[a : b - size + 1] for size, v in whole.items() if b - a >= size}
                for i, (both, either, start, width) in match_text(index, hashes[a:b], valid, num, den).items():
                    out.append((t, index.items[i][0], start, width, both / either))
            rows, items, starts, widths, scores = zip(*out, strict=True) if out else ((),) * 5
            names = [c for c in batch.schema.names if c != "text"]
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(items, pa.int64()), pa.array(starts, pa.int64()), pa.array(widths, pa.int64()), pa.array(scores, pa.float64())], names=[*names, "item_id", "start_word", "n_words", "similarity"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: tuple[int, int] = (75, 100), radius: int = RADIUS, items: int = ITEMS) -> DataFrame:
    """Benchmark items found in documents: docs' columns but text, then item_id, start_word, n_words and similarity.

    A row for each document row and item of which some window of as many words reaches the threshold; the best
    window is reported, the first of equal ones. A text shorter than the item is one window. Words are lower-cased runs without
    ASCII white space and punctuation; items of fewer words than k are one shingle of their words.

    Null and empty texts and items match nothing. Items without id are left out, repeated items give repeated rows,
    empty tables give no rows. Of docs' columns those named like one of the result's go. The benchmark is read in blocks of ``items`` rows, each broadcast, so its size is
    bounded; documents are never shuffled.
    """
    small_batches(docs.sparkSession)
    num, den = threshold
    spark = docs.sparkSession
    rest = beside(docs, "text", "item_id", "start_word", "n_words", "similarity")
    docs = docs.select(*[f.name for f in rest], "text")
    schema = f"{listed(rest)}item_id long, start_word long, n_words long, similarity double"
    named = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-named.count() // items))
    placed = named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        block = [(r["item_id"], r["text"]) for r in placed.filter(F.col("block") == b).orderBy("item_id", "text").collect()]
        found = docs.mapInArrow(_match(spark.sparkContext.broadcast(Index(block, k, radius)), num, den), schema)
        out = found if out is None else out.unionByName(found)
    return out


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: the benchmark items found in each of the whole documents."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs.select("doc_id", "text"), benchmark)
