"""MinHash near-duplicate groups with sequential Bayesian verification.

Steps, each over all rows:

1. One pass over the texts makes each document's set of k-word shingles, its MinHash signature, band keys and
   a 64-bit fingerprint of the set. Documents with equal sets are one *class*, so copies cost one row each.
2. Classes that share a band key are candidates. A bucket gives a star to its least class (linear in its size).
3. The signatures of a candidate pair are compared in batches; it is dropped once the posterior probability of a
   similarity at the threshold or above falls under ``miss``. Survivors are verified on the full sets.
4. Verified links make components. The members of buckets of three or more that still hold several components are told by
   how they differ from the bucket's leader; members that link must share differences, and the more so the farther they are
   from the leader, so an exact prefix-filter join over differences, across components only, finds the rest without a cap.
   Members of a large group that were each changed in their own way share none, and make no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialise, mix, shingle_sets, small_batches, text_batches, utf8
from weftline.llm.components import components

#: Bands and rows a band: a pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature values compared in one step of the sequential test.
STEP = 16
#: Leaders that a node is compared with; what stays apart goes on.
LEADERS = 4

_rng = np.random.default_rng(11)
_A = (_rng.integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_WEIGHTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)).reshape(BANDS, ROWS)
_NO_ID = -(2**63)


def bayes_limits(threshold: float, miss: float, hashes: int = HASHES, step: int = STEP, chance: float = 1 / 256) -> dict[int, int]:
    """Matches needed after each batch of n values so that P(similarity >= threshold | matches) is at least miss.

    The prior is uniform; of 8-bit values, a share ``chance`` of unequal ones match too.
    """
    t = threshold + (1 - threshold) * chance
    out = {}
    for n in range(step, hashes + 1, step):
        tail, need = 0.0, n
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                need = m
                break
        out[n] = need
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """HASHES minima of the set's values under as many multiplicative hashes, 32 bits each."""
    least = None
    for lo in range(0, len(values), 2048):  # a block stays in the processor's cache
        part = (values[lo : lo + 2048, None] * _A).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    return mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _WEIGHTS).sum(axis=1) + _WEIGHTS[:, 0]).view(np.int64)


def set_id(values: np.ndarray) -> int:
    """64-bit fingerprint of a set of hashes."""
    return int(mix(mix(values).sum(keepdims=True) + np.uint64(len(values))).view(np.int64)[0])


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sign(k: int):
    def run(batches):
        for batch in text_batches(batches):
            nodes, sizes, keys, sigs = [], [], [], []
            for s in shingle_sets(utf8(batch.column("text")), k):
                sizes.append(len(s))
                sig = signature(s) if len(s) else None
                nodes.append(set_id(s) if len(s) else None)
                keys.append(band_keys(sig) if len(s) else None)
                sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema=_SIGNED)

    return run


def _sets(k: int):
    def run(batches):
        for batch in text_batches(batches):
            sets = shingle_sets(utf8(batch.column("text")), k)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    return run


def _sequential(limits: dict[int, int], num: int, den: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            live = np.flatnonzero(den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b))
            hits = np.zeros(batch.num_rows, np.int64)
            for n, need in limits.items():
                hits[live] += (a[live, n - STEP : n] == b[live, n - STEP : n]).sum(axis=1)
                live = live[hits[live] >= need]
            kept = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept), pa.array(hits[live])], names=["a", "b", "hits"])

    return run


def _exact(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b, out = batch.column("set_a"), batch.column("set_b"), []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return run


def _differences(num: int, den: int):
    """Members of an open bucket as what they lack of its leader's set and what they have besides: one row a prefix place.

    For m shingles lacking and e added, cost = den * m + num * e. Two members of differences D and E are linked if and only
    if (num + den) * |D & E| >= cost + cost' - free, with free = (den - num) * |leader's set|; a member is linked with the
    leader if its cost is at most free. So of two members at least one costs more than free, and the costlier one needs an
    overlap of (cost - free) / den, the other one of what its own cost and the partner's least leave. Added shingles come
    first, as they are the rarer ones: all but so many of the last places make the prefix in which the two must meet.
    """

    def run(batches):
        for batch in batches:
            refs, comps, ref_comps = (batch.column(c).to_numpy() for c in ("ref", "comp", "ref_comp"))
            for i in range(batch.num_rows):
                own, base = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("set_node", "set_ref"))
                added, lacking = np.setdiff1d(own, base, assume_unique=True), np.setdiff1d(base, own, assume_unique=True)
                cost, free, n = den * len(lacking) + num * len(added), (den - num) * len(base), len(added) + len(lacking)
                light = n + 1 - max(1, -(-(cost + max(cost, free + 1) - free) // (num + den)))
                heavy = n + 1 - -(-(cost - free) // den) if cost > free else 0
                both = np.concatenate([added, lacking])[: max(light, heavy, 1)].view(np.int64)
                k, label = len(both), ref_comps[i] if cost <= free else comps[i]
                node = batch.column("node")[i].as_py()
                for lo in range(0, k, 65536):
                    part = both[lo : lo + 65536]
                    rest = [np.full(len(part), x) for x in (refs[i], node, label, comps[i] != ref_comps[i], len(own), n, cost, free, light, heavy)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, rest), pa.array(np.arange(lo + 1, lo + 1 + len(part))), pa.array(part)], names=["ref", "node", "label", "apart", "size", "n", "cost", "free", "light", "heavy", "rank", "shingle"])

    return run


_DIFFERENCES = "ref long, node long, label long, apart boolean, size long, n long, cost long, free long, light long, heavy long, rank long, shingle long"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (75, 100), miss: float = 1e-6) -> DataFrame:
    """Near-duplicate groups: per row its id, n_shingles, component_id, kept and text_hash (xxhash64 of the text).

    Texts are linked when ``den * |A & B| >= num * |A | B|`` for their sets of distinct k-word shingles, after
    lower-casing A-Z; words are split at ASCII white space. component_id is the least id reachable. Two candidates
    that no bucket joins are missed with probability 5e-6 at the threshold, a pair in the sequential test with ``miss``.

    Null and empty texts, and texts of white space, have no shingle and stand alone. Null ids take part but are never
    the least id of a group that has another; alone they give a null component_id. Repeated rows give repeated
    results; rows of equal id and different text are nodes of their own. An empty table gives no rows.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = materialise(docs.mapInArrow(_sign(k), "doc_id long, text_hash long, node long, n_shingles long, keys array<long>, sig binary"), "signed")
    files = len(signed.inputFiles())  # as many as docs has splits: what follows grows with it
    placed = F.coalesce("doc_id", F.lit(_NO_ID))
    first = F.min(F.struct(placed.alias("at"), "text_hash", "n_shingles", "keys", "sig"))
    nodes = materialise(signed.filter("node IS NOT NULL").groupBy("node").agg(first.alias("r"), F.min("doc_id").alias("least")).select("node", "least", "r.*"), "nodes", files)
    brief = nodes.select("node", "sig", F.col("n_shingles").alias("n"))

    placed_keys = nodes.select("node", F.explode("keys").alias("key"))
    shared = placed_keys.groupBy("key").agg(F.count("*").alias("n_bucket")).filter("n_bucket > 1")
    met = materialise(placed_keys.join(shared, "key"), "met", files)
    # The leader is the member that meets most others over all its buckets: of near copies the one that was changed least.
    weight = met.groupBy("node").agg(F.sum("n_bucket").alias("weight"))
    leaders = met.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).getField("node").alias("leader"))
    buckets = materialise(met.join(leaders, "key"), "buckets", files)

    sequential = _sequential(bayes_limits(num / den, miss), num, den)

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(brief.toDF("a", "sig_a", "n_a"), "a").join(brief.toDF("b", "sig_b", "n_b"), "b")
        return both.mapInArrow(sequential, "a long, b long, hits long")

    # Stars come first because they settle most buckets; a few leaders for each node do. Which pairs they hold doesn't
    # matter for the result: a bucket that keeps several components goes on, and a bucket of two is a pair itself.
    order = Window.partitionBy("b").orderBy(F.desc("bands"), "a")
    stars = buckets.filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("bands"), F.min("n_bucket").alias("least"))
    stars = stars.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= LEADERS) | (F.col("least") == 2)).select("a", "b")
    stars = materialise(likely(stars), "candidates", files)
    loose = buckets.filter("n_bucket > 2")
    needed = stars.select(F.col("a").alias("node")).union(stars.select("b")).union(loose.select("node")).distinct()
    wanted = nodes.join(needed, "node").select("node", "at", F.col("text_hash"))
    sets = materialise(docs.withColumn("at", placed).join(wanted, ["at", "text_hash"]).select("node", "text").mapInArrow(_sets(k), "node long, members binary").dropDuplicates(["node"]), "sets", files)

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return materialise(both.mapInArrow(_exact(num, den), "a long, b long"), "links", files)

    def labelled(df: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(comp.toDF(node, name), node, "left").withColumn(name, F.coalesce(name, node))

    links = linked(stars)
    comp = materialise(components(links, most=files), "components", files)

    known = labelled(loose, comp, "node", "comp")
    open_keys = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    unresolved = known.join(open_keys, "key").select(F.col("leader").alias("ref"), "node", "comp").filter("node <> ref").distinct()
    unresolved = labelled(unresolved, comp, "ref", "ref_comp").join(sets.toDF("node", "set_node"), "node").join(sets.toDF("ref", "set_ref"), "ref")
    places = materialise(unresolved.mapInArrow(_differences(num, den), _DIFFERENCES), "differences", files)
    direct = places.filter("rank = 1 AND cost <= free AND apart").select(F.col("ref").alias("a"), F.col("node").alias("b"))
    light = places.filter("rank <= light").select("ref", "shingle", F.col("node").alias("a"), F.col("label").alias("la"), F.col("size").alias("sa"), F.col("n").alias("na"), F.col("cost").alias("ca"), F.col("rank").alias("ra"))
    heavy = places.filter("rank <= heavy").select("ref", "shingle", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("n").alias("nb"), F.col("cost").alias("cb"), F.col("rank").alias("rb"), "free")
    fits = f"(ca < cb OR ca = cb AND a < b) AND la <> lb AND {den} * least(sa, sb) >= {num} * greatest(sa, sb) AND (1 + least(na - ra, nb - rb)) * {num + den} >= ca + cb - free"
    same = (light["ref"] == heavy["ref"]) & (light["shingle"] == heavy["shingle"])
    pairs = light.join(heavy, same & F.expr(fits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.unionByName(direct).unionByName(linked(likely(pairs)))
    comp = components(links, most=files)

    least = labelled(nodes.select("node", "least"), comp, "node", "comp")
    group = materialise(least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id"), "groups", files)
    out = signed.select("doc_id", "text_hash", "node", "n_shingles").join(group, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def op8_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Query: near-duplicate groups of the whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
