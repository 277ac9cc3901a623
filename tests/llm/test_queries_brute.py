"""The registered queries against brute force on small tables, on empty tables, and with columns of clashing names."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, texts
from weftline.llm import decontaminate, htmltext, language, neardup, packing, quality, queries, warc

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {"documents": DOCUMENTS, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string"}


def write(spark, path, **tables):
    for name, schema in TABLES.items():
        spark.createDataFrame(tables.get(name, []), schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def prose(seed, n, letters):
    rnd = random.Random(seed)
    known = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 8))) for _ in range(80)]
    return [" ".join(rnd.choice(known) for _ in range(rnd.randrange(3, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = [(i, t, lang, "s", 0) for i, t, lang in ODD] + [(100 + i, t, None, "s", 0) for i, t in enumerate(texts(60))]
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(prose(1, 60, "abcdefg"))] + [(2000 + i, t, "de", "s", 0) for i, t in enumerate(prose(2, 60, "efghijkä"))]
    rnd = random.Random(7)
    words = ["".join(rnd.choice("klmnop") for _ in range(rnd.randrange(2, 7))) for _ in range(300)]
    items = [" ".join(rnd.choice(words) for _ in range(n)) for n in (3, 8, 20, 45, 45)] + [None, ""]
    for i in range(120):  # passages of items with more and more words changed
        own = items[i % 5].split(" ")
        for _ in range(rnd.randrange(0, 2 + len(own) // 12)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        lead = [rnd.choice(words) for _ in range(rnd.randrange(0, 30))]
        rows.append((3000 + i, " ".join([*lead, *own, *lead[:7]]).upper() + "!", None, "s", 0))
    labels = [(i, i % 2, 0) for i in range(1000, 1060)] + [(1000, 0, 0), (None, 1, 0), (1001, None, 0)]
    path = write(spark, tmp_path_factory.mktemp("tables"), documents=rows, labels=labels, benchmark=list(enumerate(items)) + [(None, items[2])])
    return path, rows, items, labels


def collected(spark, name, path):
    return queries.QUERIES[name](spark, path).collect()


def test_media_payloads(spark, small):
    path, rows, _, _ = small

    def want(i, text):
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        return (i, len(raw), len(padded), sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))

    got = collected(spark, "op1_matroska_media", path)
    assert sorted([tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in got], key=repr) == sorted([want(r[0], r[1]) for r in rows], key=repr)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def _held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_language_by_a_plain_count(spark, small):
    path, rows, _, _ = small
    counts, words = {}, lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    for i, text, lang, _, _ in rows:
        if lang and text is not None and not _held(i):
            for w in words(text):
                marked = f"^{w}$"
                for size, gram in [(0, w), *[(s, marked[k : k + s]) for s in (5, 4, 3, 2, 1) for k in range(len(marked) - s + 1)]]:
                    counts.setdefault((lang, size), Counter())[gram] += 1
    langs = sorted({lang for lang, _ in counts})

    def value(lang, size, gram):
        c = counts.get((lang, size), Counter())
        return log((c[gram] if size or c[gram] > 1 else 0) + 0.5) - log(sum(c.values()) + 0.5 * (len(c) + 1))

    known = lambda size, gram: any(counts.get((lang, size), Counter())[gram] > (0 if size else 1) for lang in langs)

    def vector(w):
        if known(0, w):
            return [value(lang, 0, w) for lang in langs]
        marked, at, found = f"^{w}$", 0, []
        while at < len(marked):
            size = next((s for s in (5, 4, 3, 2, 1) if at + s <= len(marked) and known(s, marked[at : at + s])), 0)
            if size:
                found.append([value(lang, size, marked[at : at + size]) for lang in langs])
            at += max(1, size - 1)
        return [sum(x) / len(found) for x in zip(*found, strict=True)] if found else [0.0] * len(langs)

    def want(i, text):
        if not words(text):
            return (i, _held(i), "und", 0.0)
        total = [sum(x) for x in zip(*map(vector, words(text)), strict=True)]
        return (i, _held(i), langs[total.index(max(total))], round(1 / sum(exp(x - max(total)) for x in total), 6))

    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in collected(spark, "op3_language_id", path)]
    assert sorted(got, key=repr) == sorted([want(r[0], r[1]) for r in rows], key=repr)


def test_quality_by_one_solution_in_memory(spark, small):
    path, rows, _, labels = small
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    known = [(by_id[i], q) for i, q, _ in labels if i in by_id and q is not None and not _held(i)]
    stats = np.array([s for s in quality.statistics([t.encode() for t, _ in known])]).reshape(len(known), -1)
    scale = stats.std(axis=0)
    scale[scale < 1e-5] = 1.0
    f = quality.fourier((stats - stats.mean(axis=0)) / scale)
    weights = np.linalg.solve(f.T @ f + quality.RIDGE * np.eye(f.shape[1]), f.T @ np.array([q for _, q in known], float))
    docs = spark.createDataFrame([(t, q, k % 2) for k, (t, q) in enumerate(known)], "text string, label int, fold int")
    model = quality.train(quality.measured(docs.repartition(5)))
    assert np.allclose(model.raw(stats), f @ weights, atol=1e-6)
    got = collected(spark, "op4_quality_classifier", path)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == _held(r.doc_id) for r in got)


def test_a_large_group_of_near_copies_and_a_common_passage(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base, passage, rows = [word() for _ in range(140)], [word() for _ in range(25)], []
    for i in range(260):
        own = list(base)
        for _ in range(rnd.randrange(0, 9)):
            at, kind = rnd.randrange(len(own)), rnd.randrange(3)
            own[at : at + (kind != 0)] = [word()] if kind < 2 else []
        rows.append((i, " ".join(own)))
    for i in range(260, 340):
        own = [word() for _ in range(rnd.randrange(5, 60))]
        rows.append((i, " ".join([*own, *passage])))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}
    assert 5 < len({got[i] for i in range(260)}) < 200


def _words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def _all_windows(rows, items):
    out = {}
    for j, item in enumerate(items):
        own = _words(item)
        if not own:
            continue
        k = min(5, len(own))
        grams = lambda w: Counter(tuple(w[x : x + k]) for x in range(len(w) - k + 1))  # noqa: B023,E731
        target = grams(own)
        for i, text, *_ in rows:
            doc = _words(text)
            if len(doc) < k:
                continue
            width = min(len(own), len(doc))
            for at in range(len(doc) - width + 1):
                window = grams(doc[at : at + width])
                both = sum((window & target).values())
                score = both / (window.total() + target.total() - both)
                if score >= 0.75 and score > out.get((i, j), (0,))[0]:
                    out[i, j] = (score, at, width)
    return out


def test_contamination_by_all_windows(spark, small):
    path, rows, items, _ = small
    want = _all_windows(rows, items)
    assert len(want) > 25
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in collected(spark, "op7_benchmark_decontamination", path)}
    assert got == want


def test_windows_over_the_threshold_lie_within_the_radius():
    rnd, missed, near = random.Random(3), 0, 0
    for _ in range(3000):
        n = rnd.randrange(20, 150)
        item = [rnd.getrandbits(64) for _ in range(n)]
        window = [rnd.getrandbits(64) if rnd.random() < 0.14 * rnd.random() else x for x in item]
        a, b = Counter(item), Counter(window)
        both = sum((a & b).values())
        if both >= 0.75 * (a.total() + b.total() - both):
            near += 1
            prints = [decontaminate.simhash(np.array(x, np.uint64)) for x in (item, window)]
            missed += (prints[0] ^ prints[1]).bit_count() > decontaminate.RADIUS
    assert near > 2000 and missed <= 0.001 * near


def test_packing_by_the_tokenizer(spark, small):
    from tokenizers import Tokenizer

    path, rows, _, _ = small
    tok = Tokenizer.from_file(packing.tokenizer_file())
    want = []
    for i, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, k * 4096, len(part := ids[k * 4096 : (k + 1) * 4096]), zlib.crc32(part.tobytes())) for k in range(-(-len(ids) // 4096))]
    got = collected(spark, "op10_best_fit_packing", path)
    assert sorted([tuple(r[:5]) for r in got], key=repr) == sorted(want, key=repr)
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in full.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096
    assert len(full) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_repeats_of_a_host_by_all_substrings(spark):
    rnd = random.Random(5)
    sentence = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    menu, foot = sentence(), sentence()
    pages, blocks = [], {}
    for i in range(12):
        own = [sentence() for _ in range(3)]
        blocks[i] = [menu, *own, foot] if i % 3 else [menu, own[0], own[1] + " " + foot[:29]]
        pages.append((i, f"http://h{i % 2}.org/{i}", "".join(f"<div>{b}</div>" for b in blocks[i])))
    grams = {}
    for i, found in blocks.items():
        tokens = " ".join(found).split()
        for k in range(len(tokens) - htmltext.HEAD + 1):
            grams.setdefault((i % 2, *tokens[k : k + htmltext.HEAD]), set()).add(i)
    want = {}
    for i, found in blocks.items():
        tokens = " ".join(found).split()
        covered = set()
        for k in range(len(tokens) - htmltext.HEAD + 1):
            if len(grams[(i % 2, *tokens[k : k + htmltext.HEAD])]) > 1:
                covered |= set(range(k, k + htmltext.HEAD))
        at, kept = 0, []
        for b in found:
            n = len(b.split())
            if not set(range(at, at + n)) <= covered:
                kept.append(b)
            at += n
        want[i] = " ".join(kept)
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(pages, TABLES["pages"])).collect()}
    assert got == want and all(menu not in t for t in want.values())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    assert collected(spark, name, write(spark, tmp_path / "empty")) == []


def test_columns_of_clashing_names_give_way(spark):
    docs = spark.createDataFrame([(1, "eine kleine probe hier", "de"), (2, None, None)], "doc_id long, text string, lang string")
    odd = docs.select("*", *[F.lit("x").alias(c) for c in ("Score", "lang_pred", "stats", "item_id", "Similarity", "start_word", "node")])
    model = language.train(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    found = language.identify(odd, model)
    assert found.columns == ["doc_id", "lang", "stats", "item_id", "Similarity", "start_word", "node", "lang_pred", "score"]
    assert [(r.doc_id, r.lang_pred) for r in found.orderBy("doc_id").collect()] == [(1, "de"), (2, "und")]
    scored = quality.score(quality.measured(odd), quality.train(quality.measured(docs.selectExpr("text", "1 AS label", "0 AS fold"))))
    assert scored.columns == ["doc_id", "lang", "lang_pred", "item_id", "Similarity", "start_word", "node", "score"] and scored.filter("score BETWEEN 0 AND 1").count() == 2
    items = spark.createDataFrame([(5, "eine kleine probe hier")], "item_id long, text string")
    hit = decontaminate.contaminated(odd, items).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.node) for r in hit] == [(1, 5, 1.0, "x")]
    ints = spark.createDataFrame([(1, "a b", "x")], "doc_id int, text string, length string")
    assert [r.doc_id for r in packing.pack(ints, packing.tokenizer_file()).collect()] == [1]


def test_archives_of_many_members_inflate_whole(spark):
    rnd = random.Random(2)
    members = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, 300))) for _ in range(3000)] + [b"x" * 5_000_000]
    packed = b"".join(warc.deflate(m) for m in members)
    assert warc.inflate(packed) == b"".join(members) == warc.inflate(packed + bytes(512)) and warc.inflate(b"") == b""
    for broken in (packed[:-5], b"\0" + packed, packed + b"rest"):
        with pytest.raises(ValueError):
            warc.inflate(broken)
    rows = spark.createDataFrame([(1, bytearray(packed[:40]), "a", "b"), (2, None, "a", "b")], "n int, data binary, Index string, other string")
    found = warc.normalise_archives(rows)
    assert found.columns == ["n", "other", "data", "index", "error"] and [r.error is None for r in found.collect()] == [False, False]
