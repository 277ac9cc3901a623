"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

The pieces' lengths are counted; the program over *configurations* (multisets of lengths that fit one sequence) is solved
by multiplicative weights: lengths that lag behind in coverage get a higher price, and a knapsack dynamic program finds
the configurations worth most at these prices. The same prices bound every packing from below. The solution is brought to a
basis, so that few configurations have a fractional share, until it lies within a stated gap of the bound or no longer
improves; then it is rounded to whole sequences, and the rest, a few for each configuration, is packed by best fit. All of
that works on counts by length, whatever the number of documents; pieces then find their places by length and rank.
"""

from __future__ import annotations

import logging
import os
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialise, small_batches, text_batches

CAPACITY = 4096
END = 1
#: The program is solved once its solution is within this share of the dual bound.
GAP = 0.00001
#: Steps of the first pass of multiplicative weights, doubled by each further one, and of the last.
STEPS, FINEST = 4, 16
#: Configurations that enter the basis after one knapsack, and rounds without progress that end it.
ENTER, PATIENCE = 200, 20
PULL = 0.8
#: Chunks of text whose ids a worker remembers, and as many of before.
REMEMBER = 500_000

#: What str.split() takes for white space and a tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Between a letter or digit and punctuation, where such a tokenizer always splits; an apostrophe may belong to a word.
_EDGE = re.compile(r"(?<=[a-z0-9])(?=[!-&(-/:-@\[-`{-~])")
_CHUNK = re.compile(r"[^ \t\n\r\f\v]+")
_END = END.to_bytes(4, "little")
_worker: dict[str, list] = {}


def tokenizer(path: str):
    """[tokenizer, which ids end a word, chunks remembered, those remembered before] of a tokenizers file, loaded once in each worker."""
    if path not in _worker:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        vocabulary, suffix = tok.get_vocab(), getattr(tok.model, "end_of_word_suffix", None)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        _worker[path] = [tok, ends, {}, {}]
    return _worker[path]


def _encode(tok, ends: np.ndarray, new: list[str]) -> list[bytes]:
    """Ids of each chunk. Words of letters go many to a text, as the id that ends each shows where the next begins."""
    out: dict[str, bytes] = {}
    words = [c for c in new if c.isalpha()]
    for lo in range(0, len(words), 2000):
        some = words[lo : lo + 2000]
        ids = np.array(tok.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
        stops = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(stops) == len(some):
            raw, stops = ids.tobytes(), stops.tolist()
            out.update(zip(some, [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
    rest = [c for c in new if c not in out]
    out.update((c, array("I", e.ids).tobytes()) for c, e in zip(rest, tok.encode_batch_fast(rest, add_special_tokens=False), strict=True))
    return [out[c] for c in new]


def chunks(text: str) -> list[str]:
    """The text between white space. Lower-cased and cut before punctuation where that can't change the ids, so that few chunks are new."""
    try:
        if "<|" not in text:  # may begin a special token
            text.encode("latin-1")
            text = _EDGE.sub(" ", text.lower())
    except UnicodeEncodeError:
        pass
    return _CHUNK.findall(text) if _SEPARATORS.search(text) else text.split()


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text without special tokens.

    For a tokenizer that drops white space and lower-cases: chunks between white space are encoded once and remembered.
    """
    known = tokenizer(path)
    tok, ends, memory, before = known
    split = [chunks(t) for t in texts]
    new = set().union(*split).difference(memory)
    if len(memory) + len(new) > REMEMBER:
        known[2:] = memory, before = {}, memory
        new = set().union(*split)
    memory.update((c, before[c]) for c in new if c in before)
    new = list(new.difference(memory))
    memory.update(zip(new, _encode(tok, ends, new), strict=True))
    return [np.frombuffer(b"".join(map(memory.__getitem__, c)), np.uint32) for c in split]


def _pieces(path: str, capacity: int):
    def run(batches):
        for batch in text_batches(batches, limit=1_000_000):
            found = token_ids([t or "" for t in batch.column("text").to_pylist()], path)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(found)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            crcs = [zlib.crc32(memoryview(x)[a : a + capacity]) if a + capacity <= len(x) else zlib.crc32(_END, zlib.crc32(memoryview(x)[a:])) for x, a in zip([found[i] for i in row.tolist()], start.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(np.minimum(capacity, sizes[row] - start)), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int, leads: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The highest total price of what fits the capacity, and for each lead (index of a length) the best configuration that has it.

    Configurations come as their prices and as (lead's position, index of a length), one for each piece; the price of a
    lead that can't be in one is -inf. Lengths ascend, none is 0 and prices aren't below 0.
    """
    by_size, which = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    by_size[lengths], which[lengths] = prices, np.arange(len(lengths))
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        gain = value[c - 1 :: -1] + by_size[1 : c + 1] if c else value[:0]
        best = int(gain.argmax())
        value[c] = value[c - 1]
        if gain[best] > value[c]:
            value[c], last[c] = gain[best], which[best + 1]
    # Places where nothing is taken lead straight to the next lower one where something is.
    down = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0))
    leads = np.arange(len(lengths)) if leads is None else leads
    room = capacity - lengths[leads]
    led, of, pieces = value[room] + prices[leads], [np.arange(len(leads))], [leads]
    at, room = of[0], down[room]
    while len(at := at[live := room > 0]):
        taken = last[room[live]]
        of.append(at)
        pieces.append(taken)
        room = down[room[live] - lengths[taken]]
    return float(value[capacity]), led, np.concatenate(of), np.concatenate(pieces)


def _each(of: np.ndarray, pieces: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, kinds and counts of the configurations' pieces, configuration by configuration."""
    kinds, counts = np.unique(of * m + pieces, return_counts=True)
    return np.searchsorted(kinds // m, np.arange(int(of.max(initial=-1)) + 2)), kinds % m, counts


def weigh(lengths: np.ndarray, demand: np.ndarray, capacity: int, steps: int, price: np.ndarray) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """The program by multiplicative weights: configurations (indices, ascending) with shares, the best prices, the dual bound.

    Coverage of all lengths rises in so many equal steps. In each the lengths are priced, and a knapsack finds for every
    length that is behind its best configuration; those worth at least 1 - 1 / (2 * steps) of the best of all are taken until
    a length in them is a step ahead. Then prices of lengths behind rise by a factor, and those of lengths ahead fall.
    A length that stays behind, as no configuration of it is worth enough, is made up for in the next steps, or at the end
    by best fit in fractions.
    """
    m, share, eps = len(lengths), {}, 0.5 / steps
    held, bound, cover, mean = price, 0.0, np.zeros(m), np.zeros(m)
    for step in range(1, steps + 1):
        target = step / steps
        for _ in range(steps):
            behind = np.flatnonzero(cover < target - 1e-9)
            if not len(behind):
                break
            best, led, of, pieces = knapsack(lengths, price, capacity, behind[::-1])
            if (least := float(demand @ price) / best) > bound:
                bound, held = least, price / best
            bounds, kinds, counts = _each(of, pieces, m)
            for k in np.flatnonzero(led >= (1 - eps) * best).tolist():
                i, n = kinds[bounds[k] : bounds[k + 1]], counts[bounds[k] : bounds[k + 1]]
                if cover[behind[-1 - k]] >= target - 1e-9:
                    continue
                times = float(((min(target + 1 / steps, 1) - cover[i]) * demand[i] / n).min())
                if times > 1e-9:
                    cover[i] += n * times / demand[i]
                    chosen = tuple(np.repeat(i, n).tolist())
                    share[chosen] = share.get(chosen, 0.0) + times
            mean += price / best
            price = price * np.exp(eps * np.clip((target - cover) * steps, -1, 1))
        best = knapsack(lengths, mean, capacity, behind[:0])[0]
        if (least := float(demand @ mean) / best) > bound:
            bound, held = least, mean / best
    rest = np.maximum(demand * (1 - cover), 0)
    kinds = np.flatnonzero(rest > 1e-9)
    for _, chosen, times in _fractional(lengths[kinds], rest[kinds], capacity):
        chosen = tuple(kinds[chosen].tolist())
        share[chosen] = share.get(chosen, 0.0) + times
    return share, held, bound


def _fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, list[int], float]]:
    """Best fit in fractions of sequences: each length, in the order in which they are used up, with the configuration that did it and its share.

    Each configuration holds its length and others that are used up later, so together they are a triangular basis.
    """
    out, left, live = [], demand.copy(), list(range(len(lengths)))
    sizes = lengths.tolist()
    while live:
        room, uses, keys = capacity, {}, [sizes[i] for i in live]
        at = len(live) - 1
        while at >= 0:
            i = live[at]
            if n := int(min(room // sizes[i], np.ceil(left[i]))):
                uses[i] = n
                room -= n * sizes[i]
            at = min(at - 1, bisect_right(keys, room) - 1)
        if not uses:
            return out + [(i, [i], 0.0) for i in live]
        times, first = min((left[i] / n, i) for i, n in uses.items())
        for i, n in uses.items():
            left[i] = max(0.0, left[i] - n * times)
        out.append((first, [i for i, n in uses.items() for _ in range(n)], times))
        live.remove(first)
    return out


def program(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """The fractional solution, as configurations (lengths, longest first) with their shares, and the dual bound on sequences.

    Multiplicative weights in ever smaller steps give configurations, prices and a bound. Their solution is then brought
    to a basis of as many configurations as there are lengths, which rounding needs: from best fit in fractions, those
    that the basis prices above a sequence enter it, and more that a knapsack finds at the same prices drawn to those of the
    best bound. It ends at the gap, or once PATIENCE rounds in a row close less of it than the gap.
    """
    lengths = np.array(sorted(k for k, n in counts.items() if n > 0), np.int64)
    m = len(lengths)
    if not m:
        return [], 0.0
    demand = np.array([counts[int(k)] for k in lengths], float)
    bound, held = float(demand @ lengths) / capacity, lengths / capacity
    # A little more of each length, so that no two are used up at once.
    wanted = demand * (1 + 1e-7 * np.random.default_rng(5).random(m))
    first = _fractional(lengths, wanted, capacity)
    solved, value = {tuple(c): x for _, c, x in first}, sum(x for _, _, x in first)

    def enough(value: float) -> bool:
        return value <= max((1 + gap) * bound, np.ceil(bound - 1e-6))  # no packing takes less than whole sequences

    pool: dict[tuple[int, ...], None] = {}
    price, steps, idle = held, STEPS, 0
    while not enough(value) and idle < 2 and steps <= FINEST:
        share, price, least = weigh(lengths, demand, capacity, steps, price)
        pool.update(dict.fromkeys(share))
        better = min(value, sum(share.values()))
        idle = 0 if value - better > 0.1 * (value - bound) or least - bound > 0.1 * (value - bound) else idle + 1
        if least > bound:
            bound, held = least, price
        if better < value:
            solved, value = share, better
        steps *= 2

    # The inverse of a triangular basis, length by length; sums of rows only, as threads of a linear algebra library may wait for each other.
    basis, inverse, shares = [[]] * m, np.eye(m), np.zeros(m)
    for i, chosen, times in first:
        kinds, uses = np.unique(chosen, return_counts=True)
        inverse[i] /= uses[kinds == i][0]
        for j, n in zip(kinds.tolist(), uses.tolist(), strict=True):
            if j != i:
                inverse[j] -= n * inverse[i]
        basis[i], shares[i] = chosen, times
    prices, idle = inverse.sum(axis=0), 0

    def enter(kinds: np.ndarray, uses: np.ndarray) -> bool:
        nonlocal prices
        worth = float(prices[kinds] @ uses) - 1
        if worth <= 1e-9:
            return False
        step = (inverse[:, kinds] * uses).sum(axis=1)
        falls = np.flatnonzero(step > 1e-9)
        ratio = shares[falls] / step[falls]
        out = int(falls[ratio.argmin()])
        times, row = float(ratio.min()), inverse[out] / step[out]
        moved = np.flatnonzero(np.abs(step) > 1e-12)
        shares[moved] = np.maximum(shares[moved] - times * step[moved], 0)
        inverse[moved] -= step[moved, None] * row
        inverse[out], shares[out] = row, times
        prices = prices - worth * row
        basis[out] = np.repeat(kinds, uses).tolist()
        return True

    # Prices are drawn to those of the best bound, which keeps them from swinging; as far as no configuration enters, less so.
    waiting, pull = [np.unique(c, return_counts=True) for c in pool], PULL
    while not enough(min(value, shares.sum())) and idle < PATIENCE:
        open_before, entered = shares.sum() - bound, 0
        if waiting:
            gains = np.array([prices[k] @ n for k, n in waiting])
            order = np.argsort(-gains)[:ENTER]
            entered = sum(enter(*waiting[j]) for j in order.tolist())
            if not entered:
                waiting = []
                continue
        else:
            drawn = pull * held + (1 - pull) * np.maximum(prices, 0)
            best, led, of, pieces = knapsack(lengths, drawn, capacity, np.arange(m))
            if (least := float(demand @ drawn) / best) > bound:
                bound, held = least, drawn / best
            if not pull and best <= 1 + 1e-9:
                break
            bounds, kinds, uses = _each(of, pieces, m)
            seen = set()
            for j in np.argsort(-led, kind="stable")[:ENTER].tolist():
                part = slice(bounds[j], bounds[j + 1])
                if (key := (kinds[part].tobytes(), uses[part].tobytes())) not in seen:
                    seen.add(key)
                    entered += enter(kinds[part], uses[part])
            pull = PULL if entered else pull / 2 if pull > 0.1 else 0
        idle = 0 if shares.sum() - bound < open_before - gap * bound else idle + 1
    if shares.sum() <= value * (1 + gap):
        drawn = np.maximum(prices, 0)
        bound = max(bound, float(demand @ drawn) / knapsack(lengths, drawn, capacity, np.arange(0))[0])
        solved = {tuple(c): x for c, x in zip(basis, shares, strict=True)}
    return [(tuple(sorted((int(lengths[i]) for i in chosen), reverse=True)), float(x)) for chosen, x in solved.items() if x > 0], bound


def configurations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths, longest first) and how many sequences take each; together they hold every piece once.

    The program's solution rounded: whole shares first, then once more those of the largest fractions that still find all
    their pieces, or none of these, and the rest by best fit, longest first; or best fit alone where that takes no more.
    """
    best = best_fit({k: n for k, n in counts.items() if n > 0}, capacity)
    if sum(t for _, t in best) * capacity < sum(k * n for k, n in counts.items()) + capacity:
        return best  # as few sequences as the tokens fill
    solved, bound = program(counts, capacity)
    for above in (1.0, 0.5, 0.0):
        left, kept = dict(counts), []
        for more in (False, True):
            for chosen, x in sorted(solved, key=lambda c: -(c[1] % 1)):
                kinds = {k: chosen.count(k) for k in chosen}
                times = min([int(x + 1e-4) if not more else int(x % 1 > above), *(left[k] // n for k, n in kinds.items())])
                if times:
                    kept.append((chosen, times))
                    for k, n in kinds.items():
                        left[k] -= n * times
        whole = kept + best_fit({k: n for k, n in left.items() if n > 0}, capacity)
        best = min(best, whole, key=lambda c: sum(t for _, t in c))
    logging.getLogger(__name__).info("packing: %d sequences; the program's solution has %.1f, the dual bound is %.1f", sum(t for _, t in best), sum(x for _, x in solved), bound)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Each sequence takes the longest piece left and then, again and again, the longest that still fits; equal ones are counted once."""
    counts, out = dict(counts), []
    keys = sorted(counts)
    while keys:
        room, chosen = capacity, []
        taken: dict[int, int] = {}
        at = len(keys) - 1
        while at >= 0:
            k = keys[at]
            n = min(room // k, counts[k] - taken.get(k, 0)) if k <= room else 0
            if n:
                taken[k] = taken.get(k, 0) + n
                chosen += [k] * n
                room -= k * n
            at = min(at - 1, int(np.searchsorted(keys, room, side="right")) - 1)
        times = min(counts[k] // n for k, n in taken.items())
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                keys.remove(k)
        out.append((tuple(chosen), times))
    return out


def plan(configs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Slots by (length, first rank): pieces of that length and of ranks from there on go to sequence ``base`` on, at ``offset``."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for chosen, times in configs:
        offset = 0
        for k in chosen:
            rows.append((k, rank.get(k, 0), base, offset))
            rank[k] = rank.get(k, 0) + times
            offset += k
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "base", "offset"), table.T, strict=True))


def _place(shared):
    def run(batches):
        slots = shared.value
        key = (slots["length"] << 44) + slots["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            names = [c for c in batch.schema.names if c not in ("rank", "shard")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(slots["base"][at] + rank - slots["rank"][at]), pa.array(slots["offset"][at])], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most ``capacity`` tokens; a row for each piece.

    A document is its ids and then id 1; only longer ones are cut, at multiples of the capacity. Rows: doc_id, piece,
    start, length, ids_crc32, sequence_id and offset; sequences are gapless from 0. Null and empty texts are one piece of
    id 1. Repeated rows, and rows with null or equal ids, are packed each by itself. An empty table gives no rows.
    Other columns are ignored. The driver sees a count for each length up to the capacity, nothing that grows with the rows.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # Ranks within a length: by shard and then within it, so that no length is one task's work.
    pieces = materialise(pieces.withColumn("shard", F.spark_partition_id()), "pieces")
    by_shard = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = by_shard.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    within = Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("at", F.row_number().over(within) - 1).join(by_shard.select("length", "shard", "first"), ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("first")).cast("long").alias("rank"))
    slots = spark.sparkContext.broadcast(plan(configurations(counts, capacity)))
    return ranked.mapInArrow(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all whole documents packed into sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
