"""Operator 1: near-duplicate documents by HyperMinHash, with every link confirmed on the full sets.

A document's set is its distinct five-word shingles, as 64-bit hashes. The sketch has 256 registers. Sets of different
sizes are dealt to different numbers of buckets, so that a bucket holds four shingles or more: a level is a number of
buckets, and a small set is dealt again and again, by other hashes, until there are 256 buckets (a set near the border of two
levels is sketched at both, so sets of which one is up to a third larger always share a level). A bucket keeps its least hash as a
compressed register: the number of leading zeros (6 bits) and the next ten mantissa bits. Bands of five registers
propose pairs: at similarity 0.75 all 51 bands miss a pair with a chance of 1e-6, at 0.8 of 2e-9; at 0.3 some band
proposes it with a chance of 0.12. Proposed pairs are judged by the Jaccard estimate, less the register collisions that are expected of sets of their sizes;
those not five standard errors below the threshold by a bitmap of set parities, whose distance is never greater than the sets'
symmetric difference (so no link is lost); and what is left is confirmed on the sets.

Scale. Documents with equal sets form a class, found by one aggregate over set fingerprints; only a class's
representative (least doc_id) goes further, so thousands of copies cost one row. A band bucket is first a star: its members
are compared with its least one, and components are formed. What is left are buckets with several components. There every
member of a component other than the bucket's largest (a stray) is compared with all members, sketch against
sketch, in tiles of at most ``STRAYS`` by ``MEMBERS``: rows are members, never pairs, and only pairs that pass leave a
tile. Every proposed pair is therefore either compared or already joined. Components are formed by alternating large-star
and small-star steps; nothing but counters reaches the driver.

Defined results: null, empty or blank text has an empty set, is linked with nothing and kept; fewer than five words
are one shingle; a null doc_id is its own component; rows that share a doc_id are documents of their own: each gives a row,
with the component of its own text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U, WordHashes, bounded, fold, materialize, mix, text_slices

WORDS, BAND, REGISTERS, MANTISSA = 5, 5, 256, 10
_K = [U(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(WORDS)]
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=U))
#: classes of the parity bitmap: 256 bytes a set
PARITIES = 2048
#: ids that may be broadcast to pick texts (under 10 MB); more are joined by a shuffle
BROADCAST_IDS = 200_000
_HASHES = WordHashes()
#: about so many strays and members of a bucket meet in one tile: 3 MB of sketches
STRAYS, MEMBERS = 512, 4096
#: shingles of the sets that a task holds of either side (16 MB), and the least number of blocks that sets are dealt to
BLOCK_SHINGLES, LEAST_BLOCKS = 2_000_000, 8
#: standard errors that an estimate may lie below the threshold
ERRORS = 5


def shingle_sets(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [fold(t) for t in texts]
    out = []
    for w in words:
        h = _HASHES.of(w)
        if not len(h):
            out.append(np.zeros(0, dtype=U))
            continue
        n = max(1, len(h) - size + 1)
        s = np.full(n, U(min(len(h), size)), dtype=U)
        for i in range(min(size, len(h))):
            s = s * _K[1] + mix(h[i : i + n] + U(i))
        out.append(np.unique(mix(s)))
    return out


def levels(n: int) -> list[int]:
    """Levels (2 ** level buckets a deal) at which a set of n is sketched."""
    at = lambda x: max(0, min(8, int(x).bit_length() - 3))
    return sorted({at(n), at(-(-4 * n // 3))}) if n else []


def sketch(hashes: np.ndarray, level: int) -> np.ndarray:
    """Registers of a set: 0 for an empty bucket, else leading zeros and mantissa, plus one."""
    registers = np.zeros(REGISTERS, dtype=np.uint16)
    deals = REGISTERS >> level
    h = mix(hashes[None, :] ^ _SEEDS[:deals, None])
    if level:
        h.sort(axis=1)  # buckets are the top bits: the first of each is its least
        bucket = (h >> U(64 - level)).astype(np.int64) + (np.arange(deals) << level)[:, None]
        bucket, h = bucket.ravel(), h.ravel()
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        at, low = bucket[first], (h[first] << U(level)) | U((1 << level) - 1)
    else:
        at, low = np.arange(deals), h.min(axis=1)
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(low, U(1)).astype(np.float64))).astype(np.int64), 0, 62)
    mantissa = ((low << (zeros + 1).astype(U)) >> U(64 - MANTISSA)).astype(np.int64)
    registers[at] = (zeros << MANTISSA | mantissa) + 1
    return registers


def band_keys(registers: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands of sketches (a row each), with band and level mixed in, and which bands are not empty."""
    groups = registers[:, : REGISTERS // BAND * BAND].reshape(len(registers), -1, BAND).astype(U)
    key = np.zeros(groups.shape[:2], dtype=U)
    for i in range(BAND):
        key = mix(key * _K[1] + groups[:, :, i])
    key = mix(key + np.arange(key.shape[1], dtype=U) * _K[2] + levels.astype(U)[:, None])
    return key.view(np.int64), groups.any(axis=2)


@functools.lru_cache(maxsize=4096)
def _collisions(n: float, m: float) -> float:
    """Chance that the registers of disjoint sets are equal, n and m members to a bucket: the sum over all register values
    of the chances that the least of either set's hashes lies in that value's interval."""
    zeros = np.arange(64)[:, None]
    low = 2.0 ** -(zeros + 1.0) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1.0 + MANTISSA)
    within = lambda k: np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return float((within(n) * within(m)).sum())


def collisions(n: int, m: int, level: int) -> float:
    """As above, for set sizes (to a quarter of a power of two)."""
    size = lambda k: 2 ** (round(4 * math.log2(max(k, 1))) / 4 - level)
    return _collisions(*sorted((max(1.0, size(n)), max(1.0, size(m)))))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int, level: int = 0) -> float:
    """Jaccard estimate of two sketches, less the matches that compression makes by chance: (C - EC) / registers in use."""
    used = (a > 0) | (b > 0)
    size = int(used.sum())
    if not size:
        return 0.0
    same = int(((a == b) & used).sum())
    chance = collisions(n, m, level)
    return max(0.0, (same / size - chance) / (1 - chance))


def parities(hashes: np.ndarray) -> bytes:
    """For each of ``PARITIES`` classes of hashes: whether the set has an odd number of them."""
    of = (mix(hashes ^ _K[3]) >> U(64 - PARITIES.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(of, minlength=PARITIES) & 1).tobytes()


def possible(a: np.ndarray, b: np.ndarray, n, m, percent: int) -> np.ndarray:
    """Whether sets of n and m members with parities a and b (64-bit words) can reach the threshold."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int64)  # at least so many members are in one set only
    return 100 * (n + m - apart) >= percent * (n + m + apart)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print (fingerprint of the set, null if empty), registers (of one or two levels), bits (parities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, cache=_HASHES):
            found = shingle_sets(part.column("text").to_pylist())
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            stored = [b"".join(bytes([k]) + sketch(s, k).tobytes() for k in levels(len(s))) for s in found]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array(prints, pa.binary()), pa.array(stored, pa.binary()), pa.array([parities(s) for s in found], pa.binary())], names=["doc_id", "n_shingles", "print", "registers", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, registers binary, bits binary")


_STORED = np.dtype([("level", "u1"), ("registers", "<u2", REGISTERS)])


def unpacked(stored: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all sketches in a column: which row each is of, its level, its registers."""
    flat = np.frombuffer(b"".join(stored), dtype=_STORED)
    return np.repeat(np.arange(len(stored)), [len(x) // _STORED.itemsize for x in stored]), flat["level"], flat["registers"]


def banded(sketches: DataFrame) -> DataFrame:
    """band, doc_id, n_shingles: a row for each band of each sketch that is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, level, registers = unpacked(part.column("registers").to_pylist())
                keys, full = band_keys(registers, level)
                row = np.repeat(row, full.sum(axis=1))
                yield pa.record_batch([pa.array(keys[full]), part.column("doc_id").take(row), part.column("n_shingles").take(row)], names=["band", "doc_id", "n_shingles"])

    return sketches.select("doc_id", "n_shingles", "registers").mapInArrow(run, "band long, doc_id long, n_shingles long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for every node of edges(a, b): the least id reachable. Alternating large and small stars."""
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    for _ in range(60):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, label)
        # stars only: nobody is both a centre's member and a centre
        if edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            least = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
            if least.isEmpty():
                break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the components that the links join are looked at."""
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    labels = labels.unionByName(nodes.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    side = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias("c" + c))
    edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(edges).select(F.col("id").alias("component"), F.col("component").alias("least"))
    return labels.join(merged, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def _words(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(bits), -1)


def margin(percent: int) -> float:
    """Estimates below this one are of pairs below the threshold."""
    j = percent / 100
    return j - ERRORS * math.sqrt(j * (1 - j) / REGISTERS)


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose estimate is not clearly below the threshold."""
    least = margin(percent)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            pa_, pb = (_words(batch.column(c).to_pylist()) for c in ("pa", "pb"))
            can = possible(pa_, pb, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("ra", "rb", "na", "nb"))):
                x, y = (dict(zip(*(f[k] for k in ("level", "registers")))) for f in (np.frombuffer(x, _STORED), np.frombuffer(y, _STORED)))
                level = min(x.keys() & y.keys())
                keep.append(estimate(x[level], y[level], n, m, int(level)) >= least)
            yield batch.filter(pa.array(np.array(keep, dtype=bool) & can)).select(["a", "b"])

    side = sketches.select("doc_id", "registers", "bits", "n_shingles")
    pairs = pairs.join(side.toDF("a", "ra", "pa", "na"), "a").join(side.toDF("b", "rb", "pb", "nb"), "b")
    return pairs.mapInArrow(judge, "a long, b long")


def passing(band: int, strays: dict[str, np.ndarray], members: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Pairs of a tile (places among strays, among members) of different components that pass the estimate.

    A pair that shares several bands of a level is judged in the first of their buckets only.
    """
    least, out = margin(percent), []
    first, second = (unpacked(x["registers"].tolist()) for x in (strays, members))
    for level in np.intersect1d(first[1], second[1]).tolist():
        i, j = first[0][first[1] == level], second[0][second[1] == level]
        a, b = first[2][first[1] == level], second[2][second[1] == level]
        (ka, fa), (kb, fb) = (band_keys(x, np.full(len(x), level)) for x in (a, b))
        own = np.flatnonzero(((ka == band) & fa).any(axis=1))
        theirs = np.flatnonzero(((kb == band) & fb).any(axis=1))  # the bucket is one of this level
        j, b, kb, fb = j[theirs], b[theirs], kb[theirs], fb[theirs]
        for k in own.tolist():
            n, m = strays["n"][i[k]], members["n"][j]
            open_ = (members["component"][j] != strays["component"][i[k]]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            open_ = np.flatnonzero(open_ & (members["large"][j] | (members["id"][j] > strays["id"][i[k]])))
            if not len(open_):
                continue
            x = b[open_]
            same = ((x == a[k]) & (a[k] > 0)).sum(axis=1)
            used = ((x > 0) | (a[k] > 0)).sum(axis=1)
            open_ = open_[same >= least * used]  # the correction only lowers an estimate
            for at in open_[possible(members["bits"][j[open_]], strays["bits"][i[k]], int(n), m[open_], percent)].tolist():
                earliest = int(((kb[at] == ka[k]) & fb[at] & fa[k]).argmax())
                if ka[k][earliest] == band and estimate(a[k], b[at], int(n), int(m[at]), level) >= least:
                    out.append((i[k], j[at]))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables of one key each; a key may go on in the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in key])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1][c][0].as_py() != batch.column(c)[0].as_py() for c in key):
            yield pa.concat_tables(held)
            held = []
        for x, y in zip(cuts, cuts[1:]):
            held.append(pa.Table.from_batches([batch.slice(x, y - x)]))
            if y < batch.num_rows:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def compared(left: DataFrame, sketches: DataFrame, percent: int, strays: int = STRAYS, members: int = MEMBERS) -> DataFrame:
    """Likely pairs(a, b) of different components in the same bucket of left(band, doc_id, component), in tiles."""
    sizes = left.groupBy("band", "component").agg(F.count("*").alias("k"))
    buckets = sizes.groupBy("band").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("several")).where("several > 1")
    buckets = buckets.select("band", F.col("most.component").alias("largest"), F.ceil(F.col("n") / members).cast("int").alias("slots"), F.ceil((F.col("n") - F.col("most.k")) / strays).cast("int").alias("tiles"))
    told = left.join(buckets, "band").join(sketches.select("doc_id", "registers", "bits", F.col("n_shingles").alias("n")), "doc_id")
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    told = told.withColumn("large", F.col("component") == F.col("largest"))
    columns = ["band", "slot", "tile", "stray", "large", "doc_id", "component", "n", "registers", "bits"]
    one = told.withColumn("slot", place("slots")).withColumn("tile", every("tiles")).withColumn("stray", F.lit(0)).select(columns)
    two = told.where("component != largest").withColumn("tile", place("tiles")).withColumn("slot", every("slots")).withColumn("stray", F.lit(1)).select(columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["band", "slot", "tile"]):
            is_stray = rows["stray"].to_numpy() > 0
            sides = []
            for mask in (is_stray, ~is_stray):
                part = rows.filter(pa.array(mask))
                sides.append({"id": part["doc_id"].to_numpy(), "large": part["large"].to_numpy(), "component": part["component"].to_numpy(), "n": part["n"].to_numpy(), "registers": np.array(part["registers"].to_pylist(), dtype=object), "bits": _words(part["bits"].to_pylist())})
            hit = passing(rows["band"][0].as_py(), *sides, percent)
            a, b = sides[0]["id"][hit[:, 0]], sides[1]["id"][hit[:, 1]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = one.unionByName(two).repartition("band", "slot", "tile").sortWithinPartitions("band", "slot", "tile")
    return dealt.mapInArrow(judge, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) with 100 * intersection >= percent * union, judged on the sets.

    Documents are dealt to blocks; a pair goes to the task of its two blocks, and so does, once, each set that is needed there:
    a document with very many pairs is not joined to each of them.
    """
    pairs = materialize(pairs, "likely")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = materialize(wanted.join(classes.select("doc_id", "n_shingles"), "doc_id"), "wanted")
    count, total = wanted.agg(F.count("*"), F.sum("n_shingles")).first()
    blocks = max(LEAST_BLOCKS, -(-(total or 0) // BLOCK_SHINGLES))
    ids = wanted.select("doc_id")
    ids = F.broadcast(ids) if count <= BROADCAST_IDS else ids  # else texts are shuffled to the ids

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, cache=_HASHES):
            found = [s.view(np.int64) for s in shingle_sets(part.column("text").to_pylist())]
            yield pa.record_batch([part.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(ids, "doc_id").dropDuplicates(["doc_id"])
    full = materialize(texts.mapInArrow(whole, "doc_id long, set array<long>"), "sets")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    keyed = pairs.select(block("a").alias("p"), block("b").alias("q"), "a", "b")
    needed = keyed.select("p", "q", F.col("a").alias("doc_id")).unionByName(keyed.select("p", "q", F.col("b").alias("doc_id"))).distinct()
    needed = needed.join(full, "doc_id").select("p", "q", F.lit(0).alias("pair"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    keyed = keyed.select("p", "q", F.lit(1).alias("pair"), "a", "b", F.lit(None).cast("array<long>").alias("set"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["p", "q"]):
            is_pair = rows["pair"].to_numpy() > 0
            sides = rows.filter(pa.array(~is_pair))
            column = sides["set"].combine_chunks()
            column = column if isinstance(column, pa.Array) else column.chunk(0)
            flat, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
            values, flat = np.unique(flat, return_inverse=True)
            own = dict(zip(sides["a"].to_pylist(), np.split(flat, ends[:-1])))
            a, b = (rows.filter(pa.array(is_pair))[c].to_numpy() for c in ("a", "b"))
            order, mark, before = np.argsort(a, kind="stable"), np.zeros(len(values), dtype=bool), None
            keep = np.zeros(len(a), dtype=bool)
            for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
                if x != before:
                    if before is not None:
                        mark[own[before]] = False
                    mark[own[x]] = True
                    before = x
                shared = int(np.count_nonzero(mark[own[y]]))
                keep[i] = 100 * shared >= percent * (len(own[x]) + len(own[y]) - shared)
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    dealt = needed.unionByName(keyed).repartition("p", "q").sortWithinPartitions("p", "q", "pair")
    return dealt.mapInArrow(judge, "a long, b long")


def near_duplicates(docs: DataFrame, *, percent: int = 75, strays: int = STRAYS, members: int = MEMBERS) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    bounded(docs.sparkSession)
    described = materialize(sets(docs), "sketches")
    named = described.where("print is not null and doc_id is not null")
    if not named.groupBy("doc_id").agg(F.count_distinct("print").alias("n")).where("n > 1").isEmpty():
        return _by_row(docs, percent=percent, strays=strays, members=members)
    # a class of equal sets stands as its least doc_id
    classes = materialize(named.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("bits").alias("bits")), "classes")
    rows = banded(classes)
    shared = rows.groupBy("band").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "n_shingles")).alias("first")).where("k > 1").select("band", "first")
    buckets = materialize(rows.join(shared, "band").select("band", "doc_id", "n_shingles", F.col("first.doc_id").alias("first"), F.col("first.n_shingles").alias("m")), "buckets")
    near = f"100 * least(n_shingles, m) >= {percent} * greatest(n_shingles, m)"  # sizes alone rule the others out
    pairs = buckets.where("doc_id != first").where(near).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    labels = materialize(components(confirmed(likely(pairs, classes, percent), docs, classes, percent)), "labels")
    told = buckets.select("band", "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    told = told.withColumn("component", F.coalesce("component", "doc_id"))
    found = materialize(confirmed(compared(told, classes, percent, strays, members), docs, classes, percent), "links")
    if not found.isEmpty():
        labels = materialize(joined(labels, found), "labels")
    final = classes.select("print", F.col("doc_id").alias("id")).join(labels, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    out = described.select("doc_id", "n_shingles", "print").join(final, "print", "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _by_row(docs: DataFrame, **options) -> DataFrame:
    """The same with ids of the rows' own, in the order of doc_id, where a doc_id stands for several sets."""
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("given"), "text").withColumnRenamed("given", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("given", F.col("doc_id")).withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = near_duplicates(rows.where("given is not null").select("doc_id", "text"), **options)
    given = rows.where("given is not null").select("doc_id", "given")
    named = found.join(given, "doc_id").join(given.toDF("component_id", "least"), "component_id")
    named = named.select(F.col("given").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("given") == F.col("least")).alias("kept"))
    none = near_duplicates(rows.where("given is null").select("doc_id", "text"), **options)
    return named.unionByName(none)
