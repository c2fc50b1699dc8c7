"""Operator 4: pack documents into as few sequences as possible: configuration linear program over the length histogram.

The histogram has at most ``capacity`` entries whatever the corpus, so the program (fewest sequences, of any configuration,
that hold each length as often as it occurs) is solved on the driver by multiplicative weights. Prices start at the lengths
themselves. A round finds the most valuable sequences at the prices by a knapsack dynamic program, gives each a share, and
lowers the prices of the lengths by a factor for the part of their demand that the shares cover. Prices divided by the
value of the best sequence are a solution of the dual, so every round also gives a lower bound of the number of
sequences. Shares are rounded to whole sequences, largest first, while pieces are left; what then is left is solved again,
and in the end packed by best fit. Best fit alone is taken where it needs fewer sequences.

The plan names only lengths. A piece finds its place by its rank among the pieces of its length, and ranks come
from counts per (task, length), so no length is ever gathered in one task. Pieces of full length need no plan.

Defined results: null or empty text is one piece with only the end id; documents longer than a sequence are cut
so that the first piece may be short; repeated rows are packed as separate documents; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bounded, materialize, text_slices
from quire.llm.tokens import ENCODED_BYTES, VOCABULARY, Encoder


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each room the value of the most valuable multiset of lengths, and a length of it (0: none); prices[i] is of length i + 1."""
    capacity = len(prices)
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(prices > 0) + 1
    worth = prices[lengths - 1]
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if usable[room]:
            got = value[room - lengths[: usable[room]]] + worth[: usable[room]]
            best = int(got.argmax())
            if got[best] > value[room]:
                value[room], choice[room] = got[best], lengths[best]
    return value, choice


def solve(histogram: np.ndarray, rounds: int = 40, step: float = 0.1, rate: float = 0.3, slack: float = 0.01) -> tuple[dict[tuple[int, ...], float], float]:
    """Shares of configurations (lengths, longest first) by multiplicative weights, and a lower bound of the sequences.

    A round takes, of the most valuable sequences that hold each length, those within ``slack`` of the best one, and
    covers at most a part ``step`` of any length's demand; a price falls by exp(-rate) for all of it.
    """
    capacity = len(histogram)
    sizes, demand = np.arange(1, capacity + 1), histogram.astype(float)
    wanted = np.flatnonzero(demand) + 1
    shares: dict[tuple[int, ...], float] = defaultdict(float)
    if not len(wanted):
        return shares, 0.0
    prices, bound = np.where(demand > 0, sizes / capacity, 0.0), 0.0
    for _ in range(rounds):
        value, choice = knapsack(prices)
        bound = max(bound, float(demand @ prices) / value[-1])
        holding = prices[wanted - 1] + value[capacity - wanted]
        found = set()
        for length in wanted[holding >= (1 - slack) * value[-1]].tolist():
            members, room = [length], capacity - length
            while room > 0:
                members.append(int(choice[room])) if choice[room] else None
                room -= max(1, int(choice[room]))
            found.add(tuple(sorted(members, reverse=True)))
        covered, own = np.zeros(capacity), {}
        for members in found:
            lengths, n = np.unique(members, return_counts=True)
            own[members] = float((demand[lengths - 1] / n).min())
            covered[lengths - 1] += n * own[members] / demand[lengths - 1]
        scale = step / covered.max()
        for members, share in own.items():
            shares[members] += scale * share
        prices = prices * np.exp(-rate * scale * covered)
    return shares, bound


def best_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Best fit, longest first, on a histogram: equal sequences stay one group with a count."""
    capacity, left = len(left), left.copy()
    rooms: dict[int, list[list]] = defaultdict(list)  # free room -> [pattern, count]
    for length in range(capacity, 0, -1):
        while left[length - 1] > 0:
            room = min((r for r, groups in rooms.items() if r >= length and groups), default=0)
            if not room:
                each = capacity // length
                whole, rest = divmod(int(left[length - 1]), each)
                for each_now, count in ((each, whole), (rest, 1 if rest else 0)):
                    if count:
                        pattern = np.zeros(capacity, dtype=np.int64)
                        pattern[length - 1] = each_now
                        rooms[capacity - each_now * length].append([pattern, count])
                left[length - 1] = 0
                break
            pattern, count = rooms[room].pop()
            each = min(room // length, int(left[length - 1]))
            take = min(count, int(left[length - 1]) // each)
            if take < count:
                rooms[room].append([pattern, count - take])
            fuller = pattern.copy()
            fuller[length - 1] += each
            rooms[room - each * length].append([fuller, take])
            left[length - 1] -= each * take
    return [(p, int(n)) for groups in rooms.values() for p, n in groups]


def rounded(shares: dict[tuple[int, ...], float], left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole sequences of the program, its shares scaled to all pieces of ``left`` and rounded up while these last; takes them."""
    sizes = np.arange(1, len(left) + 1)
    held = sum(share * sum(members) for members, share in shares.items())
    scale = float(left @ sizes) / held if held else 0.0
    out = []
    for members, share in sorted(shares.items(), key=lambda x: (-x[1], x[0])):
        pattern = np.bincount(np.array(members) - 1, minlength=len(left))
        used = pattern > 0
        count = min(math.ceil(scale * share), int((left[used] // pattern[used]).min()))
        if count > 0:
            out.append((pattern, count))
            left -= pattern * count
    return out


def plan(histogram: np.ndarray, rounds: int = 40) -> tuple[list[tuple[np.ndarray, int]], int]:
    """Whole sequences that hold every piece once (pieces of each length, number of such sequences), and a lower bound of their number."""
    left = histogram.astype(np.int64).copy()
    shares, bound = solve(left, rounds)
    bound = max(math.ceil(bound - 1e-6), -(-int(left @ np.arange(1, len(left) + 1)) // len(left)))
    out = []
    while shares:
        placed = rounded(shares, left)
        out += placed
        # a residual of a tenth or less of what was solved is left to best fit
        shares = solve(left, rounds)[0] if 10 * sum(n for _, n in placed) > sum(n for _, n in out) else {}
    out += best_fit(left)
    alone = best_fit(histogram.astype(np.int64))
    return min(out, alone, key=lambda groups: sum(n for _, n in groups)), bound


def places(groups: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """Rank ranges of each length: where a run of ranks goes. Sorted by (length, first rank)."""
    rows, rank, base = [], defaultdict(int), 0
    for pattern, count in groups:
        offset = 0
        for length in np.flatnonzero(pattern)[::-1] + 1:
            for _ in range(int(pattern[length - 1])):
                rows.append((length, rank[length], base, offset))
                rank[length] += count
                offset += length
        base += count
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows or np.zeros((0, 4)), dtype=np.int64).reshape(-1, 4).T))


#: of a row that is to be packed: its task, and its rank among the task's rows of its length
TASK, RANK = "__quire_task", "__quire_rank"
_PIECES = "doc_id long, piece int, start long, length long, ids binary"
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoding(vocabulary: str, end_id: int, capacity: int) -> Batches:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.shared(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        for part in text_slices(batches, limit=ENCODED_BYTES, cache=encoder):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc_id, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids"])

    return encode


def _told(with_ids: bool) -> Batches:
    """Pieces with their crc32, without ids where these aren't asked for."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = pa.array(map(zlib.crc32, batch.column("ids").to_pylist()), pa.int64())
            columns = dict(zip(batch.schema.names, batch.columns)) | {"ids_crc32": crcs}
            yield pa.RecordBatch.from_pydict(columns if with_ids else {k: v for k, v in columns.items() if k != "ids"})

    return tell


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode_pieces(docs: DataFrame, *, vocabulary: str = VOCABULARY, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32): documents with their end id, cut to sequences."""
    return _texts(docs).mapInArrow(_encoding(vocabulary, end_id, capacity), _PIECES)


def pack(pieces: DataFrame, *, capacity: int = 1024, rounds: int = 40) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    ``pieces`` is written once to the shared folder, with the rank of each row among its task's rows of that length.
    """
    return _packed(pieces.mapInArrow(_numbering, _numbered(pieces.schema)), capacity, rounds)


def _packed(numbered: DataFrame, capacity: int, rounds: int) -> DataFrame:
    # neither the rows' order nor the tasks' need be the same in a rerun: ranks are read from what was written
    ranked = materialize(numbered, "pieces")
    counts = ranked.groupBy("length", TASK).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy(TASK).rowsBetween(Window.unboundedPreceding, -1)))
    before = materialize(before.withColumn("before", F.coalesce("before", F.lit(0))), "piece-counts")
    histogram = np.zeros(capacity, dtype=np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r.length - 1] = r.n
    full = int(histogram[-1])
    histogram[-1] = 0
    groups, bound = plan(histogram, rounds)
    table = places(groups)
    total = sum(n for _, n in groups)
    columns = [c for c in ranked.columns if c not in (TASK, RANK)]
    kinds = ranked.select(*columns).schema
    joined = ranked.join(before.select("length", TASK, "before"), ["length", TASK])
    joined = joined.select(*columns, (F.col("before") + F.col(RANK)).alias(RANK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table["length"] << 40 | table["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            ranks = batch.column(RANK).to_numpy()
            sequence, offset = total + ranks, np.zeros(len(length), dtype=np.int64)
            short = length < capacity
            if short.any():
                at = np.searchsorted(keys, (length[short] << 40) | ranks[short], side="right") - 1
                sequence[short] = table["sequence"][at] + ranks[short] - table["rank"][at]
                offset[short] = table["offset"][at]
            arrays = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    out = joined.mapInArrow(place, T.StructType([*kinds.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    out._quire_sequences, out._quire_bound = total + full, bound + full
    return out


def _numbered(pieces: T.StructType) -> T.StructType:
    return T.StructType([*pieces.fields, T.StructField(TASK, T.IntegerType()), T.StructField(RANK, T.LongType())])


def _numbering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    seen: dict[int, int] = defaultdict(int)
    me = TaskContext.get().partitionId()
    for batch in batches:
        length = batch.column("length").to_numpy()
        ranks = np.empty(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        values, first, n = np.unique(length[order], return_index=True, return_counts=True)
        for v, f, k in zip(values.tolist(), first.tolist(), n.tolist()):
            ranks[order[f : f + k]] = np.arange(seen[v], seen[v] + k)
            seen[v] += k
        tasks = np.full(len(length), me, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tasks), pa.array(ranks)], names=[*batch.schema.names, TASK, RANK])


def pack_documents(docs: DataFrame, *, vocabulary: str = VOCABULARY, end_id: int = 2, capacity: int = 1024, rounds: int = 40, with_ids: bool = True) -> DataFrame:
    """Pieces of the documents with their crc32, place and (with_ids) ids."""
    bounded(docs.sparkSession)
    encode, tell = _encoding(vocabulary, end_id, capacity), _told(with_ids)
    kinds = T.StructType.fromDDL(_PIECES + ", ids_crc32 long")
    kinds = T.StructType([f for f in kinds if with_ids or f.name != "ids"])
    # one step for all three: each Python step of a task is a worker of its own, with its memory, and ids would travel twice
    return _packed(_texts(docs).mapInArrow(lambda batches: _numbering(tell(encode(batches))), _numbered(kinds)), capacity, rounds)
