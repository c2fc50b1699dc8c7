"""Operator 3: token ids in Arrow stream files of fixed-size sequences, and the encoder that operator 4 shares.

``Encoder`` gives the ids that the ``tokenizers`` library gives for whole texts with its own settings. Byte-level BPE
never joins pre-tokens, and a single blank or line feed between two visible characters always ends one, so a text made
of visible runs with single separators is the concatenation of its runs' ids; every distinct run is encoded
once by the library and remembered (bounded). Any other text (double blanks, blanks at an end, an added token of the
vocabulary such as ``<|endoftext|>``, which the library reads as one id) is encoded whole.

``write_token_files`` lays documents out in ascending ``doc_id`` order: documents are range-partitioned, each
partition becomes one shard, and only the shards' totals (one row a file) go through the driver.

A shard is two Arrow *stream* files:
* ``*.tokens.arrows`` - record batches of ``rows`` sequences: ``ids fixed_size_list<uint16|uint32>[L]`` and
  ``mask fixed_size_list<bool>[L]`` (false: padding, only in the last sequence). Nothing is compressed, so a
  memory-mapped file gives any sequence and mask without a copy.
* ``*.docs.arrows`` - ``doc_id, start, n_tokens`` of the shard's documents, start counted within the shard.

Defined results: null text is an empty text (only the end id); repeated ``doc_id`` rows are laid out one after
another; a null ``doc_id`` sorts first; an empty table gives no file and no row; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import operator
import os
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, new_path, text_slices

#: Default vocabulary, looked up where the public tokenizer files are installed; any path may be given.
VOCABULARY = "byte_bpe_50k.json"
#: text that is encoded at once, in bytes: its runs are met again while they are in the processor's cache
ENCODED_BYTES = 2 << 20
MARKS = string.punctuation
#: white space besides the blank and the line feed
OTHER_BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Whole texts to little-endian uint32 ids, through the tokenizers library."""

    def __init__(self, vocabulary: str = VOCABULARY, remember: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: what makes a text one to be encoded whole: adjacent separators or an added token somewhere
        self.stops = ["  ", " \n", "\n ", "\n\n", *added]
        self.odd = regex.compile(r"\s\s")
        #: a text without these is plain if its runs are not empty
        self.rare = [*OTHER_BLANKS, *added]
        names = self.tokenizer.get_vocab()
        self.size = max(names.values()) + 1
        #: ids that can only stand where a run begins: those that begin with a blank, and the lone line feed
        self.begins = np.zeros(self.size, dtype=bool)
        for name, i in names.items():
            self.begins[i] = name.startswith("Ġ") or name == "Ċ"
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.remember = remember

    @classmethod
    def shared(cls, vocabulary: str) -> "Encoder":
        """One per Python worker: the vocabulary outlives a task, the runs do not."""
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = cls(vocabulary)
        return _ENCODERS[vocabulary]

    def forget(self) -> None:
        self.known, self.tails = {}, {}

    def clear(self) -> None:
        """Forget everything, and leave the worker to another operator."""
        self.forget()
        for name in [k for k, e in _ENCODERS.items() if e is self]:
            del _ENCODERS[name]

    def separated(self, text: str) -> bool:
        """Whether a text is the concatenation of its visible runs, looked at as a whole."""
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in self.stops):
            return False
        return len(text.split()) == text.count(" ") + text.count("\n") + 1 or not self.odd.search(text)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[str]) -> None:
        for at in range(0, len(runs), 5000):
            part = runs[at : at + 5000]
            # a few runs a call: the library is slower on longer texts
            joined = [(" " + " ".join(part[i : i + 64])).replace(" \n", "\n") for i in range(0, len(part), 64)]
            found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), dtype="<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(part):
                raw, cuts = ids.tobytes(), [*(starts * 4).tolist(), 4 * len(ids)]
                self.known.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                self.known.update(zip(part, self._whole([r if r[0] == "\n" else " " + r for r in part])))

    def _meet(self, new: set[str]) -> None:
        """Make runs known. A letter and a mark after it are never one pre-token: a run that ends in marks is its parts."""
        parted, stems = [], []
        for run in [r for r in new if r[-1] in MARKS]:
            stem = run.rstrip(MARKS)
            if stem[-1:].isalpha():
                parted.append(run)
                stems.append(stem)
        self._learn(list(set(stems).difference(self.known).union(new.difference(parted))))
        tails = [run[len(stem) :] for run, stem in zip(parted, stems)]
        if len(self.tails) + len(set(tails)) > self.remember:
            self.tails = {}
        fresh = list(set(tails).difference(self.tails))
        self.tails.update(zip(fresh, self._whole(fresh) if fresh else []))
        heads, ends = map(self.known.__getitem__, stems), map(self.tails.__getitem__, tails)
        self.known.update(zip(parted, map(operator.add, heads, ends)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; texts should come in blocks, for new runs are encoded a block at a time."""
        out: list[bytes | None] = [b""] * len(texts)
        runs: dict[int, list[str]] = {}
        odd = []
        for i, text in enumerate(texts):
            if text:
                if not any(x in text for x in self.rare) or self.separated(text):
                    # the visible runs, those after a line feed with it before them; one is put before the text
                    runs[i] = ("\n" + text).replace("\n", " \n").split(" ")[1:]
                else:
                    odd.append(i)
        distinct = set().union(*runs.values())
        if "" in distinct or "\n" in distinct:  # adjacent separators, or one at an end, in some of the texts
            odd += [i for i in runs if not self.separated(texts[i])]
            whole = set(odd)
            runs = {i: pieces for i, pieces in runs.items() if i not in whole}
            distinct = set().union(*runs.values())
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > self.remember:
            self.known = {}
            new = distinct
        self._meet(new)
        known = self.known.__getitem__
        for i, pieces in runs.items():
            out[i] = b"".join(map(known, pieces))[4:]  # without the line feed put before the text
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]) if odd else []):
            out[i] = ids
        return out


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


class ShardWriter:
    """Writes one shard; keeps one batch of sequences in memory."""

    def __init__(self, uri: str, length: int, rows: int, kind: str):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.length, self.rows, self.kind = length, rows, np.dtype(kind)
        value = pa.uint16() if self.kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = self.fs.open_output_stream(self.path + ".tokens.arrows")
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.docs_sink = self.fs.open_output_stream(self.path + ".docs.arrows")
        self.docs_stream = pa.ipc.new_stream(self.docs_sink, self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.docs_stream.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.docs_schema))
        self.held += [x.astype(self.kind) for x in ids]
        self.n_held += int(sizes.sum())
        self.total += int(sizes.sum())
        if self.n_held >= self.rows * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        per = self.rows * self.length
        whole = len(flat) // per * per
        for at in range(0, whole, per):
            self._batch(flat[at : at + per], per)
        rest = flat[whole:]
        if last and len(rest):
            self._batch(np.pad(rest, (0, -len(rest) % self.length)), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def _batch(self, flat: np.ndarray, used: int) -> None:
        mask = np.zeros(len(flat), dtype=bool)
        mask[:used] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for x in (self.stream, self.sink, self.docs_stream, self.docs_sink):
            x.close()


class Shard:
    """Zero-copy reader of a shard: ``shard[i]`` is sequence i and its mask."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path + ".tokens.arrows") if local else fs.open_input_file(path + ".tokens.arrows")
        self.batches = list(pa.ipc.open_stream(self.source))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.rows = self.batches[0].num_rows if self.batches else 1
        self.flat = [b.column(0).flatten().to_numpy() for b in self.batches]
        with fs.open_input_stream(path + ".docs.arrows") as source:
            self.docs = pa.ipc.open_stream(source).read_all()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch, row = divmod(i, self.rows)
        return self.flat[batch][row * self.length : (row + 1) * self.length], self.batches[batch].column(1)[row].values

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids from ``start`` on; a view where they lie in one batch."""
        per, parts = self.rows * self.length, []
        while n > 0:
            batch, at = divmod(start, per)
            part = self.flat[batch][at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, folder: str, *, vocabulary: str = VOCABULARY, end_id: int = 0, length: int = 1024, rows: int = 256) -> list[tuple]:
    """Write ``docs(doc_id, text)``; returns the manifest, a row a shard: (uri, first token, n_tokens, n_docs)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.shared(vocabulary)
        kind = "<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4"
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        shard, n, first = None, 0, None
        end = np.array([end_id], dtype="<u4")
        for part in text_slices(batches, limit=ENCODED_BYTES, cache=encoder):
            if shard is None:
                shard, first = ShardWriter(uri, length, rows, kind), part.column("doc_id")[0].as_py()
            ids = encoder.encode(part.column("text").to_pylist())
            shard.add(part.column("doc_id").to_pylist(), [np.concatenate([np.frombuffer(x, "<u4"), end]) for x in ids])
            n += part.num_rows
        if shard:
            shard.close()
            yield pa.record_batch({"uri": [uri], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n_tokens": pa.array([shard.total], pa.int64()), "n_docs": pa.array([n], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    found = ordered.mapInArrow(write, "uri string, part int, n_tokens long, n_docs long").collect()  # a row a file
    manifest, before = [], 0
    for r in sorted(found, key=lambda r: r.part):
        manifest.append((r.uri, before, r.n_tokens, r.n_docs))
        before += r.n_tokens
    return manifest


def read_token_files(spark, manifest: list[tuple]) -> DataFrame:
    """Documents of the files: doc_id, start (over all shards), n_tokens, ids (little-endian uint32), ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist()):
                shard = Shard(uri)
                for docs in shard.docs.to_batches(1024):
                    starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    crcs = [zlib.crc32(shard.tokens(a, n).astype("<u4")) for a, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.record_batch([docs.column("doc_id"), pa.array(starts + before), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(manifest or [("", 0, 0, 0)], "uri string, before long, n_tokens long, n_docs long")
    rows = rows.where("uri != ''").repartition(max(1, len(manifest)))
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the files and return what they hold, a row a document."""
    spark = bounded(docs.sparkSession)
    return read_token_files(spark, write_token_files(docs, folder or new_path(spark, "tokens"), **options))
