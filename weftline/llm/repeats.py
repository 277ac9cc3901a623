"""Removal of byte strings that repeat from earlier documents, by suffix sorting of what can repeat.

A suffix array of the whole corpus moves many times the input between machines, so only places that can repeat are
sorted, and nothing that can is left out:

1. Every LENGTH-byte window holds exactly one *anchor*, its least 16-byte hash, so equal windows have equal anchors.
   Consecutive windows of one anchor form a *context* of at most 84 bytes. Contexts are dealt by anchor (one entry for
   each distinct context of a block of text, that of the least document: the others of the block are settled there).
2. Equal contexts settle each other. Contexts that share an anchor and differ may still share windows: these go on.
3. The bytes of those contexts are dealt by anchor; each bucket's concatenation is sorted by the difference-cover
   suffix array, and windows whose neighbours have an equal LENGTH-byte prefix are grouped and compared by document.
4. The covered spans come back to their documents, are merged and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import _BYTE, materialise, mix, partitions, release, small_batches, text_batches, utf8
from weftline.llm.suffixarray import suffix_array

GRAM = 16
LENGTH = 50
_SIDE = LENGTH - GRAM
_HALF = _SIDE // 2
#: Anchors that a map task holds before it settles them among themselves and passes on the rest.
BLOCK = 600_000
#: Bytes that are suffix-sorted at once; bounds a worker's memory.
SORTED_BYTES = 400_000
_B = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _grams(buf: np.ndarray) -> np.ndarray:
    h, s = _BYTE[buf], 1
    while s < GRAM:
        h = h[:-s] * _power(s) + h[s:]
        s *= 2
    return h


def contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each context: its text's index, anchor hash, context hash, first byte in the text, length."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(buf) < LENGTH:
        return empty
    stops = np.cumsum(sizes)
    h = _grams(buf)
    m = (mix(h) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, s = _SIDE + 1, 1
    while s * 2 <= span:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    m = np.minimum(m[: len(m) - (span - s)], m[span - s :])
    anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + LENGTH <= stops[text]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(anchor)] - 1
    good = whole[new]
    first, last = new[good], last[good]
    if not len(first):
        return empty
    end, p = last + LENGTH, anchor[first]

    def wide(i: np.ndarray) -> np.ndarray:
        return h[i] * _power(32) + h[i + 16] * _power(16) + h[i + 32]

    code = mix(mix(wide(first)) + wide(end - 48) * np.uint64(3) + (end - first).astype(np.uint64))
    return text[first], mix(h[p]), code, first - (stops - sizes)[text[first]], end - first


class _Refs:
    """Documents of a block: id and mark (32 bits of the text's hash, to tell texts of one id apart) by index."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray, marks: np.ndarray) -> int:
        self.ids.append(ids)
        self.marks.append(marks)
        self.n += len(ids)
        return self.n - len(ids)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(self.ids), np.concatenate(self.marks)) if self.ids else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


#: A bucket's anchors are told apart by 32 bits and contexts of one anchor by 48 more. Anchors that fall together cost
#: a comparison and no more, as contexts of one anchor that differ are compared byte by byte.
_COLUMNS = {"docs": np.int64, "marks": np.uint32, "counts": np.uint32, "anchor": np.uint32, "code": np.uint32, "code_top": np.uint16, "start": np.uint32, "size": np.uint32, "bytes": np.uint8}
_ENTRY_COLUMNS = ("anchor", "code", "code_top", "start", "size")
_PACKED = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in _COLUMNS]])
#: Kinds of packed rows: contexts to compare; spans found covered; contexts whose bytes are asked for (code: their bucket).
_ENTRY, _SPAN, _ASK = 0, 1, 2


def _pack(bucket: int, kind: int, ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, data: bytes = b"", **columns) -> pa.RecordBatch:
    """One packed row. doc: each entry's index into ids and marks, ascending."""
    used, counts = np.unique(doc, return_counts=True)
    columns |= {"docs": ids[used], "marks": marks[used], "counts": counts}
    row = {c: np.ascontiguousarray(columns[c], t).tobytes() if c in columns else b"" for c, t in _COLUMNS.items()}
    row["bytes"] = data
    return pa.RecordBatch.from_pylist([{"bucket": bucket, "kind": kind, **row}], schema=_PACKED_ARROW)


def _unpack(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    row = {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in _COLUMNS.items()}
    row["doc"] = np.repeat(np.arange(len(row["docs"])), row["counts"])
    return row


def _joined(rows: list[dict], columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Packed rows put together: document ids, marks, and the entries' columns with doc as an index into those."""
    base = np.cumsum([0, *[len(r["docs"]) for r in rows]])
    out = {c: np.concatenate([r[c] for r in rows]) for c in columns}
    out["doc"] = np.concatenate([r["doc"] + b for r, b in zip(rows, base[:-1], strict=True)])
    return np.concatenate([r["docs"] for r in rows]), np.concatenate([r["marks"] for r in rows]), out


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys in sorted columns."""
    if not len(keys[0]):
        return []
    cuts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]).tolist()
    return list(zip(cuts, [*cuts[1:], len(keys[0])], strict=True))


def _deal(kind: int, key: np.ndarray, buckets: int, ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, columns: dict[str, np.ndarray]):
    """Packed rows of the entries by bucket; key is taken modulo buckets."""
    to = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((columns["start"], doc, to))
    for lo, hi in _runs(to[order]):
        part = order[lo:hi]
        yield _pack(int(to[part[0]]), kind, ids, marks, doc[part], **{c: v[part] for c, v in columns.items()})


def _shard(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64) + np.uint64(77))


def _spans(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each document as one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), start[order].astype(np.int64) + size[order].astype(np.int64)
    if not len(doc):
        return doc, start, stop
    lift = doc * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + lift)
    new = np.r_[True, (start + lift)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.r_[first[1:], len(doc)] - 1] - lift[first]


def _deal_spans(buckets: int, ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray):
    doc, start, stop = _spans(doc, start, size)
    yield from _deal(_SPAN, _shard(ids)[doc], buckets, ids, marks, doc, {"start": start, "size": stop - start})


def _least(key: list[np.ndarray], doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by key and document, and for each entry in that order the least document of its key."""
    order = np.lexsort((doc_id, *key[::-1]))
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)] if len(order) else np.zeros(0, bool)
    return order, doc_id[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc_id


def _find(buckets: int, shards: int):
    """Texts to contexts: those settled within a block as spans, one document's of each distinct other as entries."""

    def settle(refs: _Refs, held: list[tuple]):
        if not held:
            return
        ids, marks = refs.arrays()
        doc, anchor, code, start, size = (np.concatenate([h[j] for h in held]) for j in range(5))
        order, least = _least([anchor, code], ids[doc])
        doc, anchor, code, start, size = (x[order] for x in (doc, anchor, code, start, size))
        done = least < ids[doc]
        yield from _deal_spans(shards, ids, marks, doc[done], start[done], size[done])
        doc, anchor, code, start, size = (x[~done] for x in (doc, anchor, code, start, size))
        columns = {"anchor": anchor // np.uint64(buckets) & _LOW, "code": code & _LOW, "code_top": code >> np.uint64(48), "start": start, "size": size}
        yield from _deal(_ENTRY, anchor, buckets, ids, marks, doc, columns)

    def run(batches):
        refs, held, n = _Refs(), [], 0
        for batch in text_batches(batches):
            base = refs.add(batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy().astype(np.uint32))
            found = contexts(utf8(batch.column("text")))
            held.append((found[0] + base, *found[1:]))
            n += len(found[0])
            if n >= BLOCK:
                yield from settle(refs, held)
                refs, held, n = _Refs(), [], 0
        yield from settle(refs, held)

    return run


def _by_bucket(work):
    """Run work on all entry rows of each bucket of a sorted partition; other rows pass."""

    def run(batches):
        held, at = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("kind")[i].as_py() != _ENTRY:
                    yield batch.slice(i, 1)
                    continue
                bucket = batch.column("bucket")[i].as_py()
                if bucket != at and held:
                    yield from work(held, at)
                    held = []
                at = bucket
                held.append(_unpack(batch, i))
        if held:
            yield from work(held, at)

    return run


def _compare(buckets: int):
    def work(rows: list[dict], bucket: int):
        ids, marks, e = _joined(rows, _ENTRY_COLUMNS)
        code = e.pop("code").astype(np.uint64) | e.pop("code_top").astype(np.uint64) << np.uint64(32)
        order, least = _least([e["anchor"], code], ids[e["doc"]])
        e, code = {c: v[order] for c, v in e.items()}, code[order]
        docs = ids[e["doc"]]
        done = least < docs
        yield from _deal_spans(buckets, ids, marks, e["doc"][done], e["start"][done], e["size"][done])
        new = np.r_[True, e["anchor"][1:] != e["anchor"][:-1]]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
        differ = np.minimum.reduceat(code, first) < np.maximum.reduceat(code, first)
        ask = (several & differ)[group] & ~done
        yield from _deal(_ASK, _shard(ids)[e["doc"][ask]], buckets, ids, marks, e["doc"][ask], {"code": np.full(int(ask.sum()), bucket), **{c: e[c][ask] for c in ("anchor", "start", "size")}})

    return _by_bucket(work)


def _per_document(kind: int):
    """Packed rows of one partition to a row for each document, with the entries of one kind."""

    def run(batches):
        rows = [_unpack(b, i) for b in batches for i in range(b.num_rows) if b.column("kind")[i].as_py() == kind]
        if not rows:
            return
        ids, marks, e = _joined(rows, ("anchor", "code", "start", "size") if kind == _ASK else ("start", "size"))
        order = np.lexsort((e["start"], marks[e["doc"]], ids[e["doc"]]))
        e = {c: v[order] for c, v in e.items()}
        i, m = ids[e["doc"]], marks[e["doc"]]
        bounds = _runs(i, m)
        for lo in range(0, len(bounds), 4096):
            some = bounds[lo : lo + 4096]
            heads = [a for a, _ in some]
            packs = [pa.array([np.ascontiguousarray(e[c][a:b]).tobytes() if c in e else b"" for a, b in some], pa.binary()) for c in ("anchor", "code", "start", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(i[heads]), pa.array(m[heads].astype(np.int64)), *packs], names=["doc_id", "mark", "anchor", "code", "start", "size"])

    return run


_PER_DOCUMENT = "doc_id long, mark long, anchor binary, code binary, start binary, size binary"


def _cut_out(batches):
    """Documents with their asked contexts to packed entries with the contexts' bytes, dealt by the bucket that asked."""

    def flush(refs: _Refs, held: list[tuple]):
        ids, marks = refs.arrays()
        doc, anchor, bucket, start, size, text, begin = (np.concatenate([h[j] for h in held]) for j in range(7))
        order = np.lexsort((start, doc, bucket))
        for lo, hi in _runs(bucket[order]):
            part = order[lo:hi]
            n = size[part].astype(np.int64)
            at = np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield _pack(int(bucket[part[0]]), _ENTRY, ids, marks, doc[part], text[at].tobytes(), anchor=anchor[part], start=start[part], size=size[part])

    refs, held, n, total = _Refs(), [], 0, 0
    for batch in text_batches(batches):
        base = refs.add(batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy().astype(np.uint32))
        for i in range(batch.num_rows):
            anchor, bucket, start, size = (np.frombuffer(batch.column(c)[i].as_buffer(), _COLUMNS[c]) for c in ("anchor", "code", "start", "size"))
            raw = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
            m = size.astype(np.int64)
            at = np.repeat(start.astype(np.int64) - (np.cumsum(m) - m), m) + np.arange(m.sum())
            held.append((np.full(len(anchor), base + i), anchor, bucket, start, size, raw[at], total + np.cumsum(m) - m))
            total += int(m.sum())
            n += len(anchor)
        if n >= BLOCK // 8:
            yield from flush(refs, held)
            refs, held, n, total = _Refs(), [], 0, 0
    if held:
        yield from flush(refs, held)


def _poly(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * _B + _BYTE[text[at + j]]
    return mix(out)


def _sort_suffixes(buckets: int):
    def work(rows: list[dict], bucket: int):
        ids, marks, e = _joined(rows, ("anchor", "start", "size"))
        text = np.concatenate([r["bytes"] for r in rows])
        size = e["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        # A window reaches _HALF bytes or more to one side of its anchor; contexts that share no such side share no window.
        place = np.zeros(len(size), np.int64)
        step = begin // SORTED_BYTES
        for lo, hi in _runs(step):
            some = text[begin[lo] : begin[hi - 1] + size[hi - 1]]
            least = (mix(_grams(some)) & ~_LOW) | np.arange(len(some) - GRAM + 1, dtype=np.uint64)
            own = begin[lo:hi] - begin[lo]
            bounds = np.c_[own, own + size[lo:hi] - GRAM + 1].ravel()
            place[lo:hi] = (np.minimum.reduceat(np.r_[least, ~np.uint64(0)], bounds)[::2] & _LOW).astype(np.int64) - own
        keep = np.zeros(len(size), bool)
        for fits, at in ((place >= _HALF, begin + place - _HALF), (size - place >= GRAM + _HALF, begin + place)):
            which = np.flatnonzero(fits)
            code = _poly(text, at[which], GRAM + _HALF)
            _, back, count = np.unique(code, return_inverse=True, return_counts=True)
            keep[which] |= (count > 1)[back]
        which = np.flatnonzero(keep)
        # Anchors are whole within a part, so parts are sorted one by one; a single anchor makes a part of any size.
        parts = max(1, int(size[which].sum()) // SORTED_BYTES)
        part = e["anchor"][which] % np.uint32(parts)
        for k in range(parts):
            yield from sort(which[part == k], text, begin, e, ids, marks)

    def sort(which: np.ndarray, text: np.ndarray, begin: np.ndarray, e: dict, ids: np.ndarray, marks: np.ndarray):
        if len(which) < 2:
            return
        n = e["size"][which].astype(np.int64)
        fresh = np.cumsum(n + 1) - (n + 1)
        s = np.zeros(int((n + 1).sum()), np.int64)  # contexts with a 0 behind each; bytes are 1 to 256
        owner = np.repeat(np.arange(len(which)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        s[fresh[owner] + inside] = text[begin[which][owner] + inside].astype(np.int64) + 1
        order = suffix_array(s)
        own = np.searchsorted(fresh, order, side="right") - 1
        full = order + LENGTH <= fresh[own] + n[own]
        order, own = order[full], own[full]
        views = np.lib.stride_tricks.sliding_window_view(np.r_[s, np.zeros(LENGTH, np.int64)].astype(np.uint16), LENGTH)
        equal = np.zeros(len(order), bool)
        for lo in range(1, len(order), 200_000):
            step = slice(lo, min(lo + 200_000, len(order)))
            equal[step] = (views[order[step]] == views[order[lo - 1 : step.stop - 1]]).all(axis=1)
        doc = e["doc"][which][own]
        group = np.cumsum(~equal) - 1
        heads = np.flatnonzero(~equal)
        covered = np.minimum.reduceat(ids[doc], heads)[group] < ids[doc]
        at = e["start"][which][own].astype(np.int64) + order - fresh[own]
        yield from _deal_spans(buckets, ids, marks, doc[covered], at[covered], np.full(int(covered.sum()), LENGTH))

    return _by_bucket(work)


def _remove(batches):
    for batch in text_batches(batches):
        out = []
        for text, start, size in zip(utf8(batch.column("text")), batch.column("start"), batch.column("size"), strict=True):
            starts, sizes = (np.frombuffer(x.as_buffer() or b"", np.uint32) if x.is_valid else np.zeros(0, np.uint32) for x in (start, size))
            _, a, b = _spans(np.zeros(len(starts), np.int64), starts, sizes)
            kept, at = [], 0
            for lo, hi in zip(a.tolist(), b.tolist(), strict=True):
                kept.append(text[at:lo])
                at = hi
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((len(text), len(text) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if len(a) else None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], names=["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut out every byte covered by a 50-byte string that also starts in a document with a smaller id.

    One row per input row: doc_id, text_hash (xxhash64 of the text), n_bytes, n_removed, n_spans, kept_sha256 and
    kept_text (null where nothing is removed; characters cut in half are dropped from it, not from kept_sha256).

    Strings never cross documents and are judged on the input. Null texts are empty; texts under 50 bytes keep all.
    Rows with equal ids aren't earlier than each other, so repeated rows of one id keep what no smaller id has.
    Rows with a null id keep everything and count for no other. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    docs = docs.withColumn("mark", F.col("text_hash").bitwiseAND(F.lit(0xFFFFFFFF)))
    n, shards = 2 * partitions(docs), max(4, partitions(docs) // 4)  # packed rows: at most one for each pair of these
    files = docs.rdd.getNumPartitions()
    real = docs.filter("doc_id IS NOT NULL AND length(text) > 0").drop("text_hash")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "bucket").sortWithinPartitions("bucket")

    one = materialise(dealt(real.mapInArrow(_find(n, shards), _PACKED)).mapInArrow(_compare(shards), _PACKED), "contexts", files)
    release(spark)
    asked = one.filter(F.col("kind") == _ASK).repartition(n, "bucket").mapInArrow(_per_document(_ASK), _PER_DOCUMENT)
    cut = real.join(asked, ["doc_id", "mark"]).mapInArrow(_cut_out, _PACKED)
    two = materialise(dealt(cut).mapInArrow(_sort_suffixes(shards), _PACKED), "suffixes", files)
    release(spark)
    spans = one.unionByName(two).filter(F.col("kind") == _SPAN)
    spans = spans.repartition(n, "bucket").mapInArrow(_per_document(_SPAN), _PER_DOCUMENT).select("doc_id", "mark", "start", "size")
    both = docs.join(spans, ["doc_id", "mark"], "left")
    return both.select("doc_id", "text_hash", "text", "start", "size").mapInArrow(_remove, "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: what suffix-array de-duplication removes from each of the whole documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
