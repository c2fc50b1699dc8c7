"""Operator 2: remove repeated byte strings by suffix sorting (deep-shallow), exactly and without one global array.

A byte goes if a string of ``span`` (100) bytes that covers it also starts earlier: in a document of smaller doc_id, or
earlier in the same one. Sorting every suffix of the corpus in one array can't be distributed, and is not
needed: two equal 100-byte strings choose the same anchor inside them, the 32 bytes of least hash. So suffixes are sorted at
anchors only, and only at anchors whose 32 bytes occur again.

1. Texts are read once into blocks, rows of a written table. A block sends each anchor's 32-byte key and the hash of its
   168-byte context (all 100-byte strings around the anchor) to buckets of the key space, in sorted, compressed arrays.
2. A bucket answers for each anchor: alone; a repeat of an earlier equal context (all its strings go); or the first
   of its context while other contexts share its key (to be sorted).
   Copies of a context need no order: equal hashes settle them. Whatever is partly equal is left to the sort.
3. The contexts to be sorted meet by key. Their right parts, and their left parts read backwards, are suffix-sorted:
   multikey quicksort on eight-byte words down to a shallow depth, then a blind trie orders each group that is still
   equal there. Prefix classes of the two orders say for each alignment which strings are equal; all but the
   first of a class go. A key with very many contexts is split by longer cores of the strings, a family for each range of
   alignments, so that it doesn't stay in one task.
4. Ranges meet their blocks again; a block merges and cuts them.

Defined results: null is an empty text; texts under 100 bytes lose nothing; rows with equal doc_id are ordered as they
come in their block; a null doc_id sorts first; self-overlapping runs keep their first 100 bytes. Two different strings would
have to share a 64-bit hash of the key and another one of the context to be confused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U, bounded, materialize, mix, pack_sorted, partitions, release, squeeze, text_slices, unpack_sorted, unsqueeze

SPAN, GRAM = 100, 32
SIDE = SPAN - GRAM  # bytes around the anchor that a string may have on either side
BLOCK = 8 << 20
#: eight-byte words compared by the multikey quicksort before blind tries take over
SHALLOW = 3
#: contexts of one key that are sorted together; more are split into families
HOT = 20_000

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = [U(pow(_BASE, 1 << i, 1 << 64)) for i in range(6)]


def _sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a, n = op(a[:-n], a[n:]), 2 * n
    return op(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors in a text, their keys and the hashes of their contexts (cut at the text's ends)."""
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    value = _BYTE[data]
    h = value
    for i in range(5):  # 32 bytes by doubling
        h = h[: -(1 << i)] * _POW[i] + h[1 << i :]
    h = mix(h)
    width = SIDE + 1
    least = _sliding(np.minimum, h, width)
    padded = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
    at = np.flatnonzero(_sliding(np.maximum, padded, width)[: len(h)] == h)
    powers = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(value * powers[: len(data)], out=sums[1:])
    left, right = np.maximum(at - SIDE, 0), np.minimum(at + SPAN, len(data))
    inverse = _powers(len(data) + 1, inverse=True)
    context = mix((sums[right] - sums[left]) * inverse[left]) ^ mix((at - left).astype(U) * U(1000) + (right - at).astype(U))
    return at, mix(h[at]), context  # anchors have the least hashes around: mixed again, their keys spread over all buckets


_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        step = U(pow(_BASE, -1, 1 << 64) if inverse else _BASE)
        have = np.ones(max(n, 1 << 16), dtype=U)
        have[1:] = step
        _POWERS[inverse] = have = np.multiply.accumulate(have)
    return have[:n]


def lcp(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings that share a long prefix: nodes keep only where and by which byte they branch.

    A string goes down blindly by its branching bytes to some leaf, is compared with that one, and is put in at the
    depth where they part. Equal strings share a leaf.
    """

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth = strings, depth
        self.root = None

    def insert(self, i: int) -> None:
        s, strings = self.strings[i], self.strings
        if self.root is None:
            self.root = [i]  # a leaf: indices of equal strings
            return
        node = self.root
        while isinstance(node, tuple):
            at, children = node
            node = children.get(s[at] if at < len(s) else -1) or next(iter(children.values()))
        other = strings[node[0]]
        if s == other:
            node.append(i)
            return
        d = lcp(s, other)
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < d:
            parent, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        key = s[d] if d < len(s) else -1
        if isinstance(node, tuple) and node[0] == d:
            node[1][key] = [i]
            return
        new = (d, {other[d] if d < len(other) else -1: node, key: [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = new

    def order(self) -> tuple[list[int], list[int]]:
        """Indices in order, and the common prefix of each with the one before (the first's is not known here: -1)."""
        out, common, stack = [], [], [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, tuple):
                at, children = node
                keys = sorted(children)
                stack += [(children[k], at) for k in reversed(keys[1:])]
                stack.append((children[keys[0]], before))
            elif node:
                out += node
                common += [before] + [len(self.strings[node[0]])] * (len(node) - 1)
        return out, common


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings within groups: the order, and each one's common prefix with the one before (-1: another group)."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = 8 * SHALLOW
    words = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), dtype=">u8").reshape(n, SHALLOW).astype(U)
    lengths = np.minimum([len(s) for s in strings], width)
    order = np.argsort(groups, kind="stable")
    cls = np.concatenate([[0], np.cumsum(np.diff(groups[order]) != 0)])
    common = np.where(np.diff(cls, prepend=-1) != 0, -1, 0)
    for d in range(SHALLOW + 1):
        # one step of the multikey quicksort: every open part is ordered by its next word, the last time by length
        sizes = np.bincount(cls)
        open_ = np.flatnonzero(sizes[cls] > 1)
        if not len(open_):
            break
        key = words[order[open_], d] if d < SHALLOW else lengths[order[open_]].astype(U)
        by = np.lexsort((key, cls[open_]))
        order[open_] = order[open_[by]]
        key = key[by]
        same_part = np.concatenate([[False], cls[open_[1:]] == cls[open_[:-1]]])
        part = same_part & np.concatenate([[False], key[1:] != key[:-1]])
        if d < SHALLOW:
            split = np.flatnonzero(part)
            x = key[split] ^ key[split - 1]
            common[open_[split]] = 8 * d + _leading(x)
        else:
            split = np.flatnonzero(part)
            common[open_[split]] = lengths[order[open_[split] - 1]]
        new = np.zeros(n, dtype=bool)
        new[open_[part]] = True
        cls = np.cumsum((np.diff(cls, prepend=cls[0] - 1) != 0) | new) - 1
    common = np.where(common > 0, np.minimum(common, np.minimum(lengths[order], np.concatenate([[0], lengths[order[:-1]]]))), common)
    sizes = np.bincount(cls)
    starts = np.cumsum(sizes) - sizes
    for part in np.flatnonzero(sizes > 1).tolist():  # equal down to the shallow depth
        a, b = int(starts[part]), int(starts[part] + sizes[part])
        members = order[a:b].tolist()
        trie = BlindTrie(strings, width)
        for i in members:
            trie.insert(i)
        found, prefix = trie.order()
        order[a:b] = found
        common[a + 1 : b] = prefix[1:]
    return order, common


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero 64-bit values."""
    out = np.zeros(len(x), dtype=np.int64)
    for i in range(1, 8):
        out += x < (U(1) << U(64 - 8 * i))
    return out


def repeated_alignments(keys: np.ndarray, left: list[bytes], right: list[bytes], rank: np.ndarray, low: int = 0, high: int = SIDE) -> np.ndarray:
    """For each context the alignments (bytes before the anchor) whose string a lower-ranked context of its key also has.

    left: bytes before the anchor, read backwards; right: bytes after the 32. Shape (contexts, SIDE + 1).
    """
    n = len(keys)
    out = np.zeros((n, SIDE + 1), dtype=bool)
    if not n:
        return out
    _, group = np.unique(keys, return_inverse=True)
    sides = []
    for strings in (left, right):
        order, common = deep_shallow(strings, group)
        sides.append((order, common, np.array([len(s) for s in strings])))
    by_rank = np.argsort(rank, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[by_rank] = np.arange(n)
    for x in range(low, high + 1):
        need = (x, SIDE - x)
        classes = []
        for (order, common, _), depth in zip(sides, need):
            c = np.empty(n, dtype=np.int64)
            c[order] = np.cumsum(common < depth)
            classes.append(c)
        fits = np.flatnonzero((sides[0][2] >= x) & (sides[1][2] >= SIDE - x))
        if len(fits) < 2:
            continue
        both = classes[0][fits] * (n + 1) + classes[1][fits]
        by = np.lexsort((place[fits], both))
        again = np.concatenate([[False], both[by][1:] == both[by][:-1]])
        out[fits[by[again]], x] = True
    return out


def ranges_of(flags: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int]]]:
    """Byte ranges that a context's repeated strings cover."""
    out = []
    for row, p in zip(flags, at.tolist()):
        xs = np.flatnonzero(row)
        parts = np.split(xs, np.flatnonzero(np.diff(xs) > 1) + 1) if len(xs) else []
        out.append([(p - int(r[-1]), p - int(r[0]) + SPAN) for r in parts])
    return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])


def blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, limit=BLOCK):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pylist([{"block": number, "doc_ids": part.column("doc_id").fill_null(_FAR).to_pylist(), "sizes": [len(t) for t in texts], "data": squeeze(b"".join(texts))}], schema=_BLOCK)
            number += 1

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(chosen.mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, data binary"), "suffix-blocks")


def _texts(sizes, data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(unsqueeze(data), dtype=np.uint8)
    return np.split(raw, np.cumsum(np.asarray(sizes, dtype=np.int64))[:-1]) if len(sizes) else []


def _anchors(sizes, data: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, and of all anchors of a block: index of the text, position, key, context hash; sorted by key."""
    texts = _texts(sizes, data)
    found = [anchors(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
    at, key, context = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, U) for i in range(3))
    order = np.lexsort((at, doc, key))
    return texts, doc[order], at[order].astype(np.int64), key[order], context[order]


ALONE, REPEAT, SORT, HOT_KEY = 0, 1, 2, 3
#: stands for a null doc_id: pandas would make floats of a list that holds a null
_FAR = -(1 << 63)


def verdicts(table: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(block, bucket, verdicts): what is to be done with each anchor of a block, in key order."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=U)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, doc, at, key, context = _anchors(row["sizes"], row["data"])
                ids = np.array(row["doc_ids"], dtype=np.int64)
                cuts = [0, *np.searchsorted(key, edges).tolist(), len(key)]
                # positions stay in the block: its texts' numbers are enough, for its anchors of a key are in order
                rows = [(row["block"], i, pack_sorted(key[x:y]), np.ascontiguousarray(context[x:y]).tobytes(), squeeze(ids[doc[x:y]].tobytes()), squeeze(at[x:y].astype("<u4").tobytes())) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "bucket", "keys", "contexts", "ids", "at"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [unpack_sorted(k) for k in pdf["keys"]]
        keys = np.concatenate(parts)
        contexts = np.concatenate([np.frombuffer(c, dtype=U) for c in pdf["contexts"]])
        ids = np.concatenate([np.frombuffer(unsqueeze(d), dtype=np.int64) for d in pdf["ids"]])
        at = np.concatenate([np.frombuffer(unsqueeze(d), dtype="<u4") for d in pdf["at"]])
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.lexsort((at, source, ids, contexts, keys))
        k, c = keys[order], contexts[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new_context = new_key | np.concatenate([[True], c[1:] != c[:-1]])
        group = np.cumsum(new_key) - 1
        kinds = np.bincount(group, new_context).astype(np.int64)[group]
        verdict = np.where(~new_context, REPEAT, np.where(kinds == 1, ALONE, np.where(kinds > hot, HOT_KEY, SORT)))
        back = np.empty(len(keys), dtype=np.uint8)
        back[order] = verdict
        cut = np.split(back, np.cumsum([len(p) for p in parts])[:-1])
        release()
        return pd.DataFrame({"block": pdf["block"].values, "bucket": pdf["bucket"].values, "verdicts": [squeeze(x.tobytes()) for x in cut]})

    asked = table.select("block", "doc_ids", "sizes", "data").mapInArrow(ask, "block long, bucket int, keys binary, contexts binary, ids binary, at binary")
    return asked.groupBy("bucket").applyInPandas(answer, "block long, bucket int, verdicts binary")


def _verdict(right: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.frombuffer(unsqueeze(v), dtype=np.uint8) for v in right.sort_values("bucket")["verdicts"]] or [np.zeros(0, np.uint8)])


_TO_SORT = "part long, core long, low int, high int, block long, doc int, doc_id long, at long, before binary, after binary"
FAMILY = 8


def contexts_to_sort(table: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """Contexts that share their key with others: by key, or by the cores of their strings where the key is hot."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            row = left.iloc[0]
            texts, doc, at, keys, _ = _anchors(row["sizes"], row["data"])
            verdict = _verdict(right)
            for i in np.flatnonzero(verdict >= SORT).tolist():
                text, p = texts[doc[i]], int(at[i])
                before, after = text[max(0, p - SIDE) : p].tobytes()[::-1], text[p + GRAM : p + SPAN].tobytes()
                same = (row["block"], int(doc[i]), int(row["doc_ids"][doc[i]]), p)
                core = int(keys[i].view(np.int64))
                if verdict[i] == SORT:
                    rows.append((core % parts, core, 0, SIDE, *same, before, after))
                    continue
                for low in range(0, SIDE + 1, FAMILY):
                    high = min(SIDE, low + FAMILY - 1)
                    if len(before) >= low and len(after) >= SIDE - high:
                        inner = hashlib.blake2b(before[:low] + b"|" + after[: SIDE - high], digest_size=8, key=keys[i].tobytes()).digest()
                        own = int.from_bytes(inner, "little", signed=True)
                        rows.append((own % parts, own, low, high, *same, before[:high], after[: SIDE - low]))
        release()
        return pd.DataFrame(rows, columns=["part", "core", "low", "high", "block", "doc", "doc_id", "at", "before", "after"])

    return table.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, _TO_SORT)


def sorted_ranges(waiting: DataFrame) -> DataFrame:
    """(block, doc, a, b): ranges found by sorting the contexts of each part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (low, high), own in pdf.groupby(["low", "high"]):
            rank = np.lexsort((own["at"].values, own["doc"].values, own["block"].values, own["doc_id"].values))
            place = np.empty(len(own), dtype=np.int64)
            place[rank] = np.arange(len(own))
            flags = repeated_alignments(own["core"].values, list(own["before"]), list(own["after"]), place, int(low), int(high))
            hit = np.flatnonzero(flags.any(axis=1))
            for i, found in zip(hit.tolist(), ranges_of(flags[hit], own["at"].values[hit])):
                rows += [(int(own["block"].iat[i]), int(own["doc"].iat[i]), a, b) for a, b in found]
        release()
        return pd.DataFrame(rows, columns=["block", "doc", "a", "b"]).astype({"block": "int64", "doc": "int32", "a": "int64", "b": "int64"})

    return waiting.groupBy("part").applyInPandas(run, "block long, doc int, a long, b long")


def remove_repeats(docs: DataFrame, *, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left), spans: a row for each row of docs."""
    bounded(docs.sparkSession)
    table = blocks(docs)
    buckets = buckets or max(partitions(docs), table.count() // 2)  # a bucket does not grow with the corpus
    told = materialize(verdicts(table, buckets, hot), "verdicts")
    waiting = contexts_to_sort(table, told, 8 * partitions(docs))
    ranges = materialize(sorted_ranges(waiting), "ranges")
    # ranges and verdicts meet their block in one cogroup: one array a block and kind
    packed = ranges.groupBy("block").agg(F.collect_list(F.struct("doc", "a", "b")).alias("ranges"))
    answers = told.withColumn("ranges", F.lit(None).cast("array<struct<doc:int,a:bigint,b:bigint>>")).unionByName(packed.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("verdicts"), "ranges"))

    def cut(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            row = left.iloc[0]
            texts, doc, at, _, _ = _anchors(row["sizes"], row["data"])
            verdict = _verdict(right[right["bucket"] >= 0])
            gone: list[list[tuple[int, int]]] = [[] for _ in texts]
            for i in np.flatnonzero(verdict == REPEAT).tolist():
                n, p = len(texts[doc[i]]), int(at[i])
                gone[doc[i]].append((max(0, p - SIDE), min(n, p + SPAN)))
            for found in right["ranges"][right["bucket"] < 0]:
                for r in found:
                    gone[r["doc"]].append((r["a"], r["b"]))
            for doc_id, text, ranges in zip(row["doc_ids"], texts, gone):
                spans = merge(ranges)
                keep = np.ones(len(text), dtype=bool)
                for a, b in spans:
                    keep[a:b] = False
                kept = text[keep].tobytes()
                doc_id = None if doc_id == _FAR else int(doc_id)
                rows.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in spans]))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
        out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
        release()
        return out

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(cut, kinds)


def as_text(kept):
    """The bytes left as text; bytes of a character that was cut apart are left out."""

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: b.decode("utf-8", "ignore"), na_action="ignore")

    # a filter on the text would be given a second evaluation, and each task a second worker, if this could be repeated
    return decode.asNondeterministic()(kept)
