"""Near-duplicate classes by DartMinHash and banding.

A text's five-word shingles are a weighted set (weight 1 each, or their counts).
Darts fall on the plane of each element, weight by rank, as a Poisson process of
density 1 that a hash of the element seeds, region by region; those under the
element's weight hit. Each dart has a coordinate of the signature, and the
earliest hit of a coordinate is its value: two sets agree there with a
probability that is their weighted Jaccard similarity. Regions are thrown in
order of rank until every coordinate has a hit: about k ln k darts, or a quarter
of a dart for each shingle where that is more.

``BANDS`` bands of ``ROWS`` values name buckets; at similarity 0.8 a pair shares
none of them with probability below 3e-5. Texts with the same set of shingles
are one node, so copies cost nothing. Nodes are compared with one centre of their
buckets, never in all pairs; the nodes of buckets that still hold more than one
component are joined exactly by prefix, positional and length filters. Every link
is verified on the whole shingle sets.

Defined cases: words are runs outside ASCII white space; a text of one to four
words is one shingle; null, empty and blank texts are classes of their own; a
node is a 64-bit digest of the set. Repeated rows give repeated rows; the class
id is the least doc_id of the class (null if it has none). Texts of any length
are taken whole; other columns of docs, whatever their names, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, small, stored
from .components import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
#: Centres that a node is compared with before the nodes left are joined exactly, and words of a set's parity bitmap there.
CENTRES, PARITY = 3, 4
#: Rows of ids (16 bytes) that may be broadcast, counted first; more are shuffled.
BROADCAST_ROWS = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(float) * 2.0**-53


_cdfs: dict[float, np.ndarray] = {}


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    if mean not in _cdfs:
        n = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
        logs = n * np.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, len(n))))))
        _cdfs[mean] = np.cumsum(np.exp(logs))
    return _cdfs[mean]


def dart_signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """The k values of a weighted set of 64-bit elements."""
    sig, best = np.zeros(k, np.uint64), np.full(k, np.inf)
    low, width, region = 0.0, 0.25, 0
    top = 1.0 if weights is None else float(weights.max())
    while np.isinf(best).any():
        w_low, w_width, strip = 0.0, 1.0, 0
        darts, ranks = [], []
        while w_low < top:
            e, w = (elements, None) if weights is None else (elements[weights > w_low], weights[weights > w_low])
            h = mix64(e + _U((((region << 8) + strip + 1) * int(_GOLD)) & (2**64 - 1)))
            cdf = _poisson(width * w_width)
            n = np.searchsorted(cdf, _unit(h), "right")
            at = np.repeat(np.arange(len(e)), n)
            j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            d = mix64(h[at] + _GOLD * (j.astype(np.uint64) + _U(1)))
            if w is not None:
                hit = w_low + w_width * _unit(mix64(d ^ _U(0xA5A5A5A5))) < w[at]
                d = d[hit]
            darts.append(d)
            ranks.append(low + width * _unit(mix64(d ^ _U(0x5BD1E995))))
            w_low, w_width, strip = w_low + w_width, w_low + w_width, strip + 1
        d, r = (darts[0], ranks[0]) if len(darts) == 1 else (np.concatenate(darts), np.concatenate(ranks))
        c = ((d >> _U(33)) % _U(k)).astype(np.int64)
        order = np.argsort(r, kind="stable")[::-1]  # the earliest is written last
        order = order[r[order] < best[c[order]]]
        sig[c[order]] = d[order]
        best[c[order]] = r[order]
        low, width, region = low + width, low + width, region + 1
    return sig


_words: dict[bytes, int] = {}


def shingles(text: str | None, width: int = WIDTH, counts: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted distinct 64-bit shingle hashes of a text, and how often each occurs if asked for."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if len(_words) > 400_000:
        _words.clear()
    get = _words.get
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        x = get(w)
        if x is None:
            x = _words[w] = xxhash.xxh3_64_intdigest(w)
        h[i] = x
    n = max(1, len(h) - width + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = out * _U(0x100000001B3) + h[k : k + n]
    out = mix64(out + _U(len(h) if len(h) < width else width))
    if counts:
        return np.unique(out, return_counts=True)
    return np.unique(out), None


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for k in range(rows):
        h = mix64(h ^ sig.reshape(bands, rows)[:, k])
    return h.view(np.int64)


def node_of(elements: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def signed(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """doc_id, node (null without words) and the band buckets of each row of docs(doc_id, text)."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 1000):
            nodes, got = [], []
            for t in b.column("text").to_pylist():
                e, w = shingles(t, width, weighted)
                nodes.append(node_of(e) if len(e) else None)
                got.append(bands_of(dart_signature(e, w, bands * rows), bands, rows) if len(e) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, bands array<long>")


def parity(elements: np.ndarray) -> np.ndarray:
    """The elements' bits of 64 * PARITY, each the parity of those that fall on it: two sets differ in as many elements at
    least as their bitmaps in bits."""
    at = ((elements >> _U(7)) % _U(64 * PARITY)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * PARITY) & 1).astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, its whole shingle set and the set's bitmap for each row of docs(text) that has one."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 500):
            got = [e for t in b.column("text").to_pylist() if len(e := shingles(t, width)[0])]
            of = np.array([parity(e) for e in got], np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(e) for e in got], pa.int64()), pa.array([e.view(np.int64) for e in got], pa.list_(pa.int64())), *(pa.array(of[:, k]) for k in range(PARITY))], names=["node", "elements", *maps])

    maps = [f"p{k}" for k in range(PARITY)]
    return docs.select("text").mapInArrow(run, "node long, elements array<long>, " + ", ".join(f"{c} long" for c in maps))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs(a, b) whose sets have at least this Jaccard similarity."""
    left = small(pairs, BROADCAST_ROWS).join(sets.select(F.col("node").alias("a"), F.col("elements").alias("_x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("_y")), "b")
    near = F.size("_x") >= threshold * F.size("_y") - 1e-9
    near = near & (F.size("_y") >= threshold * F.size("_x") - 1e-9)
    common = F.size(F.array_intersect("_x", "_y"))
    return both.where(near).where(common >= threshold * (F.size("_x") + F.size("_y") - common) - 1e-9).select("a", "b").distinct()


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """node and comp of the nodes in buckets of members(bucket, node) that hold more than one component."""
    c = comps.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    m = members.join(c, F.col("node") == F.col("_n"), "left").select("bucket", "node", F.coalesce("_c", "node").alias("comp"))
    open_ = m.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("bucket").alias("_b"))
    return m.join(open_, F.col("bucket") == F.col("_b"), "left_semi").select("node", "comp").distinct()


def exact_pairs(open_: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of nodes of different components in open_(node, comp) that may reach the threshold, by an exact prefix
    join: shingles are ordered by rarity (counts over these nodes), a pair must share one of the first
    n - ceil(t n) + 1, be of like size, have enough left after it and differ in few enough bits of their bitmaps. The shingles that edits made come first, so the
    many variants of one text do not meet in all pairs; those of one node only are counted but meet nobody."""
    maps = [f"p{k}" for k in range(PARITY)]
    some = stored(sets.join(small(open_, BROADCAST_ROWS), "node").select("node", "comp", "elements", *maps), "near-open-sets")
    each = some.select("node", F.explode("elements").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("token", "_t")
    shared = each.join(often, F.col("token") == F.col("_t")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("s")).withColumnRenamed("node", "_n")  # a list is a part of one text's shingles
    n = F.size("elements")
    rows = some.select("node", "comp", *maps, n.alias("n"), (n - F.ceil(threshold * n - F.lit(1e-9)) + 1).alias("keep")).join(shared, F.col("node") == F.col("_n"))
    before = F.col("n") - F.size("s")  # shingles of this node alone
    rows = rows.select("node", "comp", *maps, "n", before.alias("before"), F.slice("s", F.lit(1), F.greatest(F.lit(0), F.col("keep") - before).cast("int")).alias("pre"))
    rows = rows.select("node", "comp", *maps, "n", "before", F.posexplode("pre").alias("i", "of")).select("node", "comp", *maps, "n", (F.col("before") + F.col("i")).alias("i"), F.col("of.token").alias("token"))
    x, y = rows.alias("x"), rows.alias("y")
    c = F.col
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (c("x.n") + c("y.n")) - F.lit(1e-9))
    fits = (c("x.n") >= threshold * c("y.n") - 1e-9) & (c("y.n") >= threshold * c("x.n") - 1e-9) & (1 + F.least(c("x.n") - c("x.i") - 1, c("y.n") - c("y.i") - 1) >= need)
    fits = fits & (sum(F.bit_count(c(f"x.{p}").bitwiseXOR(c(f"y.{p}"))) for p in maps) <= c("x.n") + c("y.n") - 2 * need)
    found = x.join(y, (c("x.token") == c("y.token")) & (c("x.comp") > c("y.comp")) & fits)
    out = stored(found.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct(), "near-pairs")
    discard(some)
    return out


def link(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node and comp of the nodes linked through members(bucket, node, copies), each node once a bucket."""
    pair = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    # A bucket's centre is the node that meets most texts in all its buckets: an original is nearer to its variants than they
    # are to each other.
    met = members.groupBy("bucket").agg(F.sum("copies").alias("texts")).withColumnRenamed("bucket", "_b")
    weight = members.join(met, F.col("bucket") == F.col("_b")).groupBy("node").agg(F.sum("texts").alias("weight")).withColumnRenamed("node", "_w")
    weighed = stored(members.join(weight, F.col("node") == F.col("_w")).select("bucket", "node", "weight"), "near-weighed")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("c")).select(F.col("bucket").alias("_b"), F.col("c.node").alias("centre"), F.col("c.weight").alias("weight_"))
    shared = weighed.join(centres, F.col("bucket") == F.col("_b")).where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("times"), F.max("weight_").alias("weight"))
    # the centres met in most buckets, of which a node has no more than bands
    best = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "weight", "centre")), False).alias("m"))
    best = best.select("node", F.explode(F.slice("m", 1, CENTRES)).alias("m"))
    tried = stored(best.select(*pair("node", "m.centre")).distinct(), "near-tried")
    links = stored(verified(tried, sets, threshold), "near-links")
    comps = components(links)
    open_ = stored(_open(members, comps), "near-left")
    discard(weighed, tried, links)
    if not open_.isEmpty():
        pairs = exact_pairs(open_, sets, threshold)
        found = stored(verified(pairs, sets, threshold), "near-links")
        if not found.isEmpty():
            before = comps
            comps = components(before.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found))
            discard(before)
        discard(pairs, found)
    discard(open_)
    return comps


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """doc_id, class_id and class_size for each row of docs(doc_id, text)."""
    got = stored(signed(docs, width, bands, rows, weighted), "near-signed")
    nodes = stored(got.where("node is not null").groupBy("node", "bands").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "near-nodes")
    members = nodes.select("node", "copies", F.explode("bands").alias("bucket")).dropDuplicates(["node", "bucket"])
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("_b"))
    members = stored(members.join(full, F.col("bucket") == F.col("_b"), "left_semi").select("bucket", "node", "copies"), "near-members")
    involved = members.select("node").distinct().withColumnRenamed("node", "_n")
    firsts = stored(nodes.join(involved, F.col("node") == F.col("_n"), "left_semi").select(F.col("first")).distinct(), "near-firsts")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(small(firsts, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("first")), "left_semi")
    sets = stored(sets_of(texts, width), "near-sets")
    twice = sets.groupBy("node").count().where("count > 1").limit(1).count() > 0  # ids that repeat or are null
    if twice:
        each, sets = sets, stored(sets.dropDuplicates(["node"]), "near-sets")
        discard(each)
    found = link(members, sets, threshold)
    comps = found.select(F.col("node").alias("_n"), "comp")
    named = stored(got.select("doc_id", "node").join(small(comps, BROADCAST_ROWS), F.col("node") == F.col("_n"), "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp")), "near-named")
    discard(got, nodes, members, firsts, sets, found)
    heads = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).withColumnRenamed("comp", "_c")
    heads = stored(heads, "near-heads")
    linked = named.where("comp is not null").join(small(heads, BROADCAST_ROWS), F.col("comp") == F.col("_c")).select("doc_id", "class_id", "class_size")
    return linked.union(named.where("comp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))
