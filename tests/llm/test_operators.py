"""The training-data operators against brute force, round trips and edge cases, on small tables."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from weftline.llm import decontaminate, htmltext, language, licences, matroska, neardup, packing, quality, queries, repeats, suffixarray, warc

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty texts, ties, repeated rows and a long text.
ODD = [(None, "a b c d e f", "en"), (1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, "12 34!", "de"), (5, "one two", "en"), (5, "one two", "en"), (6, "word " * 20000, "en"), (7, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x") for i, t, lang in ODD], SCHEMA + ", node string")


def texts(n=160, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8)))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        own = [word() for _ in range(rnd.randrange(0, 60))]
        kind = rnd.randrange(4)
        if kind == 1 and out:
            own = rnd.choice(out).split(" ")
            if own:
                own[rnd.randrange(len(own))] = word()
        elif kind == 2:
            k = rnd.randrange(len(own) + 1)
            own = own[:k] + passage + own[k:]
        out.append(" ".join(own))
    return out


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(texts()))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", t)) else set() for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_near_duplicates_of_odd_rows(spark, odd):
    got = sorted(neardup.near_duplicates(odd).collect(), key=repr)
    assert len(got) == len(ODD)
    assert all(r.kept for r in got)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_bayes_limits_rise_and_keep_the_threshold():
    limits = list(neardup.bayes_limits(0.75, 1e-6).values())
    assert limits == sorted(limits) and limits[-1] < 96


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in range(40):
        for k in (1, 2, 9):
            s = rng.integers(0, k, n)
            assert suffixarray.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_repeats_match_brute_force(spark):
    rows = list(enumerate(texts(120, 2)))
    raw = {i: t.encode() for i, t in rows}
    first = {}
    for i, b in raw.items():
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    want = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_repeats_of_odd_rows(spark, odd):
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and all(r.n_removed == 0 for r in got)
    assert repeats.remove_repeats(odd.limit(0)).count() == 0


def test_decontamination_finds_changed_passages_and_no_others(spark, odd):
    rnd = random.Random(4)
    w = lambda n: [f"w{rnd.randrange(9999)}" for _ in range(n)]
    item = w(40)
    changed = [*item[:20], "other", *item[21:]]
    docs = [(1, " ".join(w(50) + item + w(30))), (2, " ".join(w(9) + changed).upper() + "!!"), (3, " ".join(w(200))), (4, " ".join(item[:12] + w(40))), (5, None), (6, "")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (None, "a b c")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 3)) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 7): (50, 1.0), (2, 7): (9, round(31 / 41, 3))}
    assert decontaminate.contaminated(odd.select("doc_id", "text"), bench.limit(0)).count() == 0


def test_packing_keeps_every_token(spark, odd):
    from tokenizers import Tokenizer

    path = packing.tokenizer_file()
    tok = Tokenizer.from_file(path)
    some = ["It's $5, isn't it?  <|endoftext|> NAÏVE\x1cx y", "Σας ΣΑΣ é", "a_b-c 12,5 «q»!!", "", "w." * 5000]
    assert [x.tolist() for x in packing.token_ids(some, path)] == [tok.encode(t, add_special_tokens=False).ids for t in some]
    got = packing.pack(odd, path).collect()
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in full.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    long = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 6)
    ids = np.array([*tok.encode("word " * 20000, add_special_tokens=False).ids, 1], "<u4")
    assert long == [(k, k * 4096, len(ids[k * 4096 : (k + 1) * 4096]), zlib.crc32(ids[k * 4096 : (k + 1) * 4096].tobytes())) for k in range(-(-len(ids) // 4096))]


def test_configurations_hold_every_piece():
    rng = np.random.default_rng(3)
    counts = dict(zip(*[x.tolist() for x in np.unique(rng.integers(1, 101, 3000), return_counts=True)], strict=True))
    packed = {}
    configs = packing.configurations(counts, 100)
    for lengths, times in configs:
        assert sum(lengths) <= 100
        for k in lengths:
            packed[k] = packed.get(k, 0) + times
    assert packed == counts
    assert sum(t for _, t in configs) <= sum(t for _, t in packing.best_fit(counts, 100))


def test_configurations_come_near_a_perfect_packing():
    rng, counts = np.random.default_rng(0), {}
    for _ in range(20):
        for k in np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, 512), int(rng.integers(2, 6)), replace=False)), 512]).tolist():
            counts[k] = counts.get(k, 0) + 10000
    configs, packed = packing.configurations(counts, 512), {}
    for lengths, times in configs:
        assert sum(lengths) <= 512
        for k in lengths:
            packed[k] = packed.get(k, 0) + times
    assert packed == counts
    assert sum(t for _, t in configs) <= 200_005
    solved, bound = packing.program(counts, 512)
    assert bound <= 200_000 + 1e-6 and sum(x for _, x in solved) <= (1 + packing.GAP) * bound


def test_configurations_beat_best_fit_where_three_fit_tightly():
    rng = np.random.default_rng(1)
    counts = dict(zip(*[x.tolist() for x in np.unique(rng.integers(1300, 1500, 20000), return_counts=True)], strict=True))
    solved, bound = packing.program(counts)
    configs = packing.configurations(counts)
    assert sum(len(lengths) * times for lengths, times in configs) == 20000
    assert bound <= sum(t for _, t in configs) <= 1.001 * bound < sum(t for _, t in packing.best_fit(counts, 4096))
    lengths = np.array(sorted(counts))
    share, price, least = packing.weigh(lengths, np.array([counts[k] for k in lengths.tolist()], float), 4096, 16, lengths / 4096)
    covered = np.zeros(len(lengths))
    for chosen, x in share.items():
        assert lengths[list(chosen)].sum() <= 4096
        np.add.at(covered, list(chosen), x)
    assert np.allclose(covered, [counts[k] for k in lengths.tolist()]) and least <= bound + 1e-6


def test_knapsack_finds_the_best_of_all():
    import itertools

    lengths, prices = np.array([3, 4, 7, 9]), np.array([3.1, 4.0, 7.5, 9.1])
    best, led, of, pieces = packing.knapsack(lengths, prices, 23)
    every = [c for n in range(8) for c in itertools.combinations_with_replacement(range(4), n) if lengths[list(c)].sum() <= 23]
    assert abs(best - max(prices[list(c)].sum() for c in every)) < 1e-9
    for k in range(4):
        assert abs(led[k] - max(prices[list(c)].sum() for c in every if k in c)) < 1e-9
        assert abs(prices[pieces[of == k]].sum() - led[k]) < 1e-9 and lengths[pieces[of == k]].sum() <= 23


def test_dual_bound_proves_what_tokens_do_not():
    solved, bound = packing.program({60: 1000, 50: 400, 45: 7}, 100)
    assert abs(bound - 1203.5) < 1e-6 and abs(sum(x for _, x in solved) - bound) < 0.02
    assert packing.configurations({}, 100) == [] and packing.program({}, 100) == ([], 0.0)


def test_language_held_out_accuracy(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = language.op3_language_id(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    found = language.identify(odd.select("doc_id", "text"), language.trained_on(docs)).collect()
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3, 4, 7)} == {"und"}


def test_quality_scores(spark):
    got = quality.op4_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == got.quality).mean() > 0.9
    assert quality.train(spark.createDataFrame([], "stats binary, label int, fold long")).score(quality.statistics([b"", b"x"])).tolist() == [0.5, 0.5]
    x, y = quality.isotonic(np.array([0.0, 1, 2]), np.array([3.0, 1, 4]), np.array([4.0, 4, 4]))
    assert (np.diff(y) >= 0).all() and len(x) == len(y)


@pytest.mark.parametrize("size", [0, 1, 64, 511, 513, 4096, 4097, 40000])
def test_matroska_round_trip(size):
    data = bytes(i * 7 % 251 for i in range(size))
    media = matroska.parse(matroska.write(matroska.padded(data)))
    assert matroska.payload(matroska.write(matroska.padded(data)), media, 1) == matroska.padded(data)
    assert media.tracks[1]["bits"] == 8 and len(media.cues) == media.packets[-1].cluster + 1


def test_matroska_lacing_and_damage(spark):
    frames = [b"a" * 300, b"b" * 2, b"c" * 700, b"d"]
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        body = matroska.block(5, -3, frames, lacing)
        track, relative, _, found = matroska.block_frames(body, 0, len(body))
        assert (track, relative, [body[a : a + n] for a, n in found]) == (5, -3, frames)
    good = matroska.write(b"\0" * 64)
    rows = matroska.packet_table(spark.createDataFrame([(1, good), (2, None), (3, b"no"), (4, good[:-20]), (5, b"")], "start int, media binary")).collect()
    assert [r.error is None for r in rows] == [True, False, False, False, False]


def test_long_licences_by_digest(spark):
    texts = Path("/usr/share/common-licenses")
    if not (texts / "Apache-2.0").exists():
        pytest.skip("no licence texts on this machine")
    apache, gpl = ((texts / n).read_text() for n in ("Apache-2.0", "GPL-3"))
    rows = [(1, apache), (2, "Copyright 2021 A. Body\n" + apache.upper().replace(",", " ,")), (3, gpl.replace("\n", " ")), (4, apache[:-40]), (5, apache), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licences.scan(docs).collect()}
    assert got[1] == got[2] == got[5] == "Apache-2.0" and got[4] is None and got[6] is None
    assert {r.license_id for r in licences.scan(docs, {}).collect()} == {None}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0]: r[3] for r in con.execute(licences.oracle_sql()).fetchall()} == got


def test_licences(spark):
    mit = licences.LICENCES["MIT"]
    rows = [(1, "Copyright (c) 2020 A\n\n" + mit.upper()), (2, "# " + mit.replace("\n", "\n# ").replace("sublicense", "sub-licence")), (3, None), (4, ""), (5, mit + " more")]
    got = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DIR), connect(DIR), queries.ORACLE_SQL[name]) == []


def test_warc_revisits_and_damage(spark):
    big = "é" * 80
    pages = spark.createDataFrame([(3, "http://a/\n", big), (1, None, big), (2, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (1, "v", big)], "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_pages(warc.normalise_archives(archives)).collect())
    assert got == [(0, "revisit", 1, 160), (1, "response", None, 160), (1, "response", None, 160), (2, "response", None, 5), (3, "revisit", 1, 160), (4, "response", None, 5), (5, "response", None, 0)]
    cut = spark.createDataFrame([(b"junk",), (None,), (warc.deflate(warc.record({"WARC-Type": "x"}, b"abc"))[:-9],)], "data binary")
    assert all(r.error and r.data is None for r in warc.normalise_archives(cut).collect())


def test_html_main_text(spark):
    nav = "<div>Home Shop Blog About Contact Help Jobs</div>"
    plain = "<html><body>" + nav + "<p>own text number {} goes on here for long</p></body></html>"
    pages = [
        (1, "http://h/1", "<nav>Menu<ul><li>x</nav><article><h1>T &amp; t</h1><p>a<b>b</b><br>c <div class='ad-box'>buy</div><section id=comments>no</section></article><footer>f"),
        (2, "http://h/2", plain.format(2)), (3, "http://h/3", plain.format(3)), (4, None, None), (5, "http://h/5", ""), (6, "http://g/6", "<p>a < b &lt;i&gt;<script>x</script>"),
    ]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & t ab c", 2: "own text number 2 goes on here for long", 3: "own text number 3 goes on here for long", 4: "", 5: "", 6: "a < b <i>"}


def test_html_copies_without_main_keep_their_text(spark):
    rnd = random.Random(8)
    passage = lambda n=30: " ".join(f"w{rnd.randrange(99999)}" for _ in range(n))
    nav = "<div>Home Shop Blog About Contact Help Jobs</div>"
    plain = lambda *p: f"<body>{nav}" + "".join(f"<p>{x}</p>" for x in p)
    same, shared, last, other, new = passage(), [passage() for _ in range(9)], passage(), passage(), passage()
    pages = [
        (1, "http://h/1", plain(same)), (2, "http://h/2", plain(same)), (2, "http://h/2", plain(same)), (3, "http://h/3", plain(same) + "<footer>printed today"), (4, "http://h/4", plain(other)),
        (5, "http://g/5", plain(*shared, last)), (6, "http://g/6", plain(*shared, new)), (7, "http://g/7", plain(*shared)), (8, "http://g/8", plain(other)),
        (9, "http://e/9", f"<article><div class=ad>buy</div></article><p>{other}</p>"), (10, "http://c/10", plain()), (11, "http://c/11", plain(other)),
        (12, "http://a/12", f"{nav}<article>{same}</article>"), (13, "http://a/13", f"{nav}<article>{other}</article>"), (14, "http://a/14", plain(last)),
    ]
    menu, whole = "Home Shop Blog About Contact Help Jobs", " ".join(shared)
    got = sorted((r.page_id, r.text) for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got == [
        (1, same), (2, same), (2, same), (3, same), (4, other), (5, f"{whole} {last}"), (6, f"{whole} {new}"), (7, whole), (8, other),
        (9, other), (10, menu), (11, other), (12, same), (13, other), (14, last),
    ]


def test_pipeline_runs_and_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(["The river of the and in her the thing on there is", "Der die und ein nicht mit", "12 34"])] + [(9, None, None, None, None)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, DIR)
    assert {r.doc_id for r in docs.collect()} == {0, 1, 2}
    assert corpus_pipeline.run(spark, DIR).agg(F.count("*")).first()[0] > 0
