"""Operator 10: language-model scoring with a weighted backoff automaton over words.

States are contexts: the root (no context) and every n-gram of one to ``ORDER - 1`` tokens that training texts go on from;
a document starts in the state of the start mark. An arc for each n-gram seen in training carries its smoothed
log-probability and leads to the state of its longest suffix that is one. For any other token the state's failure arc, which
has a stored backoff weight, leads to the state without the context's first word; the root has an arc for every token.
One left-to-right traversal carries the state and adds up the weights of the arcs it takes.

Smoothing is hierarchical Dirichlet, with the next lower order as prior and add-one at the root: p(v | h) =
(c(h v) + m p(v | h')) / (c(h) + m). A seen arc so keeps all but the prior's share of its state's mass, and the failure
arc of h weighs m / (c(h) + m): all that follow a state sum to one. ``PRIORS`` has m for contexts of one and of two words.

Scale. The automaton grows with the corpus, so no task holds it. Texts are read once into blocks, a row of a written table,
as ids in a block's own vocabulary. A block sends the sorted 64-bit keys of its distinct n-grams, with its training counts,
to buckets of the key space; a bucket adds up the counts and answers each block, in the block's order. A block then
has the slice of the automaton that its texts can reach. A frequent word or pair is one key a block, so it is no hot key.
What is shuffled is about one compressed key (under 6 bytes) for each distinct n-gram of a block. There are at least half as
many buckets as blocks, so that a bucket's size does not grow with the corpus.

Defined results: null or empty text is only the end token; without training documents every count is 0;
repeated rows count each; a null doc_id is not held out and so learned from; extra columns are ignored; two n-grams
would have to share a 64-bit hash to be confused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import U, bounded, fold, materialize, mix, pack_sorted, partitions, squeeze, text_slices, unpack_sorted, unsqueeze
from quire.llm.langid import held_out

ORDER = 3
#: Dirichlet mass of the lower order in contexts of one word, of two words
PRIORS = (200.0, 50.0)
START, END = U(xxhash.xxh3_64_intdigest(b" start")), U(xxhash.xxh3_64_intdigest(b" end"))
_END, _START = 0, 1  # ids in every block's vocabulary
_K = U(0x9E3779B97F4A7C15)
BLOCK = 12 << 20
#: tokens that a document is walked at a time; the parts of a longer one are walked side by side
STRETCH = 512


class Block:
    """Texts as ids of a vocabulary of their own: the start mark, words, the end mark for each."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
        self.tokens, self.sizes, self.hashes = tokens, sizes, hashes  # sizes count the end mark, not the start mark

    @classmethod
    def of(cls, texts: list[str | None]) -> "Block":
        vocabulary: dict[bytes, int] = {}
        parts, sizes = [], []
        for text in texts:
            words = fold(text)
            for w in words:
                if w not in vocabulary:
                    vocabulary[w] = len(vocabulary) + 2
            ids = np.empty(len(words) + 2, dtype=np.uint32)
            ids[0], ids[-1] = _START, _END
            ids[1:-1] = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.uint32, count=len(words))
            parts.append(ids)
            sizes.append(len(words) + 1)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), dtype=U, count=len(vocabulary))
        return cls(np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(sizes, dtype=np.int64), np.concatenate([[END, START], hashes]).astype(U))

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order: the keys of the block's distinct n-grams, and which of them ends at each token (-1: none).

        The first order is the vocabulary itself. No n-gram goes beyond its document.
        """
        n = len(self.tokens)
        last = self.tokens.astype(np.int32)
        out = [(mix(self.hashes + U(1)), last)]
        for order in range(2, ORDER + 1):
            keys, ends = out[-1]
            inside = ends != _START if order == 2 else ends >= 0
            if order > 2:
                inside[1:] &= ends[:-1] >= 0
            at = np.flatnonzero(inside)
            pair = ends[at - 1].astype(np.int64) * len(self.hashes) + last[at]
            by = np.argsort(pair, kind="stable")
            pair = pair[by]
            fresh = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, dtype=bool)
            distinct = pair[fresh]
            here = np.full(n, -1, dtype=np.int32)
            here[at[by]] = np.cumsum(fresh, dtype=np.int32) - 1
            del pair, by, fresh, at
            key = mix(keys[distinct // len(self.hashes)] * _K + self.hashes[distinct % len(self.hashes)] + U(order))
            out.append((key, here))
        return out


def sorted_keys(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of all orders, sorted, without the start mark's; for each the n-gram's number, counted through the orders."""
    every = np.concatenate([k for k, _ in grams])
    order = np.argsort(every, kind="stable").astype(np.int32)
    order = order[order != _START]
    return every[order], order


def blocks(docs: DataFrame, modulus: int) -> DataFrame:
    """A written table of blocks: ids of the documents, which are held out, and the coded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, limit=BLOCK):
            b = Block.of(part.column("text").to_pylist())
            row = {"block": number, "doc_ids": part.column("doc_id").to_pylist(), "held": part.column("held").to_pylist(), "sizes": b.sizes.tolist(), "tokens": _planes(b.tokens), "hashes": b.hashes.tobytes()}
            number += 1
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(modulus), F.lit(False)).alias("held"))
    return materialize(chosen.mapInArrow(run, "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, tokens binary, hashes binary"), "lm-blocks")


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("hashes", pa.binary())])


def _planes(values: np.ndarray) -> bytes:
    """Small integers: compressed planes of bytes."""
    return squeeze(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _values(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(blob), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _block(row: dict) -> Block:
    return Block(_values(row["tokens"]).astype(np.uint32), np.asarray(row["sizes"], dtype=np.int64), np.frombuffer(row["hashes"], dtype=U))


def counts(table: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, counts, types): training counts of each block's keys in each bucket, in key order.

    types: distinct training tokens of the bucket, on one of its rows.
    """
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=U)
    asked_kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            b = _block(row)
            grams = b.grams()
            learned = np.repeat(~np.array(row["held"], dtype=bool), b.sizes + 1)
            n = np.concatenate([np.bincount(ends[learned & (ends >= 0)], minlength=len(own)).astype(np.int32) for own, ends in grams])
            keys, order = sorted_keys(grams)
            del grams, learned
            n, single = n[order], order < len(b.hashes)
            del order
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            rows = [(row["block"], i, pack_sorted(keys[x:y]), _planes(n[x:y]), np.packbits(single[x:y]).tobytes()) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), asked_kinds)], names=["block", "bucket", "keys", "n", "single"])

    def answer(asked: pa.Table) -> pa.Table:
        keys, local = [unpack_sorted(k) for k in asked["keys"].to_pylist()], [_values(n) for n in asked["n"].to_pylist()]
        sizes = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        single = np.zeros(len(distinct), dtype=bool)
        single[at[np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=k) for s, k in zip(asked["single"].to_pylist(), sizes)]) > 0]] = True
        total = np.bincount(at, np.concatenate(local)).astype(np.int64)
        back = np.split(total[at], np.cumsum(sizes)[:-1])
        types = np.zeros(len(sizes), dtype=np.int64)
        types[0] = int((single & (total > 0)).sum())
        return pa.table({"block": asked["block"], "bucket": asked["bucket"], "counts": pa.array([_planes(x) for x in back], pa.binary()), "types": types})

    asked = table.mapInArrow(ask, "block long, bucket int, keys binary, n binary, single binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, counts binary, types long")


class Automaton:
    """The slice of the automaton that a block's texts can reach; n-grams are numbered as in ``Block.grams``."""

    def __init__(self, block: Block, grams: list[tuple[np.ndarray, np.ndarray]], found: list[np.ndarray], total: int, types: int, priors: tuple[float, ...] = PRIORS):
        """found: training counts of each order's n-grams."""
        self.block, self.ends = block, [e for _, e in grams]
        self.seen = [c > 0 for c in found]
        context = found[0].copy()  # how often training goes on from a context: an end mark ends it, a start mark begins each
        context[_START], context[_END] = found[0][_END], 0
        self.state = [context > 0]  # n-grams that are states
        p = (found[0] + 1) / (total + types + 1)
        self.arc, self.failure = [np.log10(p)], []
        for order in range(2, ORDER + 1):
            before, ends, m = self.ends[order - 2], self.ends[order - 1], priors[order - 2]
            at = np.flatnonzero(ends >= 0)
            prefix, suffix = np.zeros(len(found[order - 1]), dtype=np.int64), np.zeros(len(found[order - 1]), dtype=np.int64)
            prefix[ends[at]], suffix[ends[at]] = before[at - 1], before[at]
            p = (found[order - 1] + m * p[suffix]) / (context[prefix] + m)
            self.arc.append(np.log10(p))
            self.failure.append(np.log10(m / (context + m)))
            last = np.zeros(len(found[order - 1]), dtype=np.int64)
            last[ends[at]] = self.ends[0][at]
            context = np.where(last == _END, 0, found[order - 1])
            self.state.append(context > 0)

    def walk(self) -> np.ndarray:
        """Weight of the arcs taken for each token (0 for a start mark), in one traversal of every text.

        The state is the n-gram of ``level`` tokens before the next one. Texts advance side by side; a long one is cut into
        stretches, and a stretch reads the ORDER - 1 tokens before it first, after which its state is the text's.
        """
        sizes = self.block.sizes + 1
        begin = np.cumsum(sizes) - sizes
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[owner] + nth * STRETCH
        stop = np.minimum(start + STRETCH, (begin + sizes)[owner])
        at = np.where(nth > 0, start - (ORDER - 1), start)
        level = np.zeros(len(at), dtype=np.int64)
        weights = np.zeros(len(self.block.tokens))
        while len(at):
            marks = self.ends[0][at] == _START
            weight, taken = np.zeros(len(at)), np.zeros(len(at), dtype=np.int64)
            left = ~marks
            for k in range(ORDER, 1, -1):  # arcs of the state, then along failure arcs
                here = np.flatnonzero(left & (level == k - 1))
                if not len(here):
                    continue
                gram = self.ends[k - 1][at[here]]
                hit = (gram >= 0) & self.seen[k - 1][gram]
                arcs, fails = here[hit], here[~hit]
                weight[arcs] += self.arc[k - 1][gram[hit]]
                taken[arcs] = k
                left[arcs] = False
                weight[fails] += self.failure[k - 2][self.ends[k - 2][at[fails] - 1]]
                level[fails] -= 1
            root = np.flatnonzero(left)
            weight[root] += self.arc[0][self.ends[0][at[root]]]
            taken[root] = 1
            taken[marks] = 1
            weights[at[at >= start]] = weight[at >= start]
            # the state after an arc: its longest suffix that training goes on from
            level = np.minimum(taken, ORDER - 1)
            for k in range(ORDER - 1, 0, -1):
                here = np.flatnonzero(level == k)
                gram = self.ends[k - 1][at[here]]
                level[here[~((gram >= 0) & self.state[k - 1][gram])]] -= 1
            at = at + 1
            going = at < stop
            if not going.all():
                at, start, stop, level = at[going], start[going], stop[going], level[going]
        return weights


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def lm_scores(docs: DataFrame, *, modulus: int = 7, priors: tuple[float, ...] = PRIORS, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    bounded(docs.sparkSession)
    table = blocks(docs, modulus)
    buckets = buckets or max(2 * partitions(docs), table.count() // 2)
    found = materialize(counts(table, buckets), "lm-counts")
    sums = table.select(F.explode(F.arrays_zip("held", "sizes")).alias("x")).where("not x.held").agg(F.sum("x.sizes")).first()
    total = int(sums[0] or 0)
    types = int(found.agg(F.sum("types")).first()[0] or 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT.empty_table()
        row = left.to_pylist()[0]
        b = _block(row)
        grams = b.grams()
        _, order = sorted_keys(grams)
        answers = sorted(zip(right["bucket"].to_pylist(), right["counts"].to_pylist()))
        c = np.zeros(sum(len(k) for k, _ in grams), dtype=np.int64)
        c[order] = np.concatenate([_values(x) for _, x in answers]).astype(np.int64)
        del order, answers
        cuts = np.cumsum([len(k) for k, _ in grams])[:-1]
        weights = Automaton(b, grams, np.split(c, cuts), total, types, priors).walk()
        n, tokens = len(b.sizes), b.tokens != _START
        owner = np.repeat(np.arange(n), b.sizes)
        known = c[: len(b.hashes)][b.tokens[tokens]]
        base = np.log10((known + 1) / (total + types + 1))
        return pa.table(
            [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), b.sizes, np.bincount(owner, known > 0, n).astype(np.int64), np.full(n, total), np.bincount(owner, base, n), np.bincount(owner, weights[tokens], n)],
            schema=_OUT,
        )

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, kinds)
