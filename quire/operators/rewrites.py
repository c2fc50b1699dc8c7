"""Rewrites of document collections: plugins, repair, decryption and merging, each giving a ``content`` column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.kernels.rewrite import Plugin, recompress_streams, remove_attachments, remove_javascript, remove_unused, repair_streams, rotate_pages, select_pages, strip_metadata
from quire.operators.tables import BYTES, ROWS

_REPORT = "content binary, report map<string,bigint>, warnings array<string>, error string"


def _per_document(docs: DataFrame, work: Callable, keys: list[str], extra: list[str]) -> DataFrame:
    schema = T.StructType([*(docs.schema[k] for k in keys), *T.StructType.fromDDL(_REPORT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernels.document import PdfError

        kinds = (pa.binary(), pa.map_(pa.string(), pa.int64()), pa.list_(pa.string()), pa.string())
        def made(batch: pa.RecordBatch, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
            of = pa.array(owners, pa.int32())
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], names=schema.names)

        for batch in batches:
            contents, others = batch.column("content"), [batch.column(c) for c in extra]
            owners, rows, size = [], [], 0
            for i in range(batch.num_rows):
                if not contents[i].is_valid:
                    continue
                try:
                    out, report = work(contents[i].as_py(), *(c[i].as_py() for c in others))
                    row = (out, [(k, v) for k, v in report.items() if isinstance(v, int)], report.get("warnings", []), None)
                    size += len(out)
                except (PdfError, RecursionError, ValueError) as e:
                    row = (None, None, None, f"{type(e).__name__}: {e}")
                owners.append(i)
                rows.append(row)
                if len(rows) >= ROWS or size >= BYTES:
                    yield made(batch, owners, rows)
                    owners, rows, size = [], [], 0
            if rows:
                yield made(batch, owners, rows)

    return docs.select(*keys, "content", *[c for c in extra if c not in keys]).mapInArrow(run, schema)


def _keys(docs: DataFrame, *not_these: str | None) -> list[str]:
    return [c for c in docs.columns if c not in ("content", *not_these)]


def rewrite(docs: DataFrame, plugins: list[Plugin] | Callable, *, options_col: str | None = None, password_col: str | None = None) -> DataFrame:
    """Run plugins over each document. With ``options_col``, ``plugins`` is called with that column's value for a list."""

    def work(content: bytes, *values):
        from quire.kernels import rewrite as k
        from quire.kernels.document import Document

        given = dict(zip([c for c in (options_col, password_col) if c], values))
        own = plugins(given[options_col]) if options_col else plugins
        return k.rewrite(Document(content, given.get(password_col)), own)

    return _per_document(docs, work, _keys(docs, options_col, password_col), [c for c in (options_col, password_col) if c])


def repair(docs: DataFrame) -> DataFrame:
    return rewrite(docs, [repair_streams()])


def decrypt(docs: DataFrame, *, password: str | None = None, password_col: str | None = None) -> DataFrame:
    """Unencrypted copies."""

    def work(content: bytes, *values):
        from quire.kernels import rewrite as k
        from quire.kernels.document import Document

        return k.decrypt(Document(content, values[0] if values else password))

    return _per_document(docs, work, _keys(docs, password_col), [password_col] if password_col else [])


def check_password(docs: DataFrame, *, password_col: str) -> DataFrame:
    """Which password it is: user, owner, or null; and the method."""
    keys = _keys(docs, password_col)
    schema = T.StructType([*(docs.schema[k] for k in keys), *T.StructType.fromDDL("encrypted boolean, which string, method string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernels.crypto import authenticate
        from quire.kernels.document import Document, PdfError

        for batch in batches:
            rows = []
            for content, pw in zip(batch.column("content").to_pylist(), batch.column(password_col).to_pylist()):
                try:
                    doc = Document(content)
                    s = authenticate(doc, pw or "") if doc.encrypted else None
                    rows.append((doc.encrypted, s and s.which, s and s.method))
                except (PdfError, TypeError):
                    rows.append((None, None, None))
            arrays = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), *arrays], names=schema.names)

    return docs.select(*keys, "content", password_col).mapInArrow(run, schema)


def merge(docs: DataFrame, *, by: list[str], order: str, pages_col: str | None = None) -> DataFrame:
    """One document of each group, its members in the order of ``order``. A merged file is one value, so it is built in one task
    and has to fit there; ``merge_parts`` is for larger groups."""
    schema = T.StructType([*(docs.schema[k] for k in by), *T.StructType.fromDDL(_REPORT).fields])
    chosen = docs.select(*by, F.col(order).alias("__order"), "content", *([F.col(pages_col).alias("__pages")] if pages_col else []))

    def run(key, group):  # tables in Arrow
        from quire.kernels import rewrite as k
        from quire.kernels.document import Document, PdfError

        group = group.sort_by("__order")
        kinds = (pa.binary(), pa.map_(pa.string(), pa.int64()), pa.list_(pa.string()), pa.string())
        try:
            there = group.filter(group.column("content").is_valid())
            documents = (Document(c.as_py()) for c in there.column("content"))
            out, report = k.merge(documents, there.column("__pages").to_pylist() if pages_col else None)
            row = (out, list(report.items()), [], None)
        except (PdfError, ValueError) as e:
            row = (None, None, None, f"{type(e).__name__}: {e}")
        return pa.Table.from_arrays([*(pa.array([v.as_py()], t.type) for v, t in zip(key, [group.schema.field(b) for b in by])), *(pa.array([v], t) for v, t in zip(row, kinds))], names=schema.names)

    return chosen.groupBy(*by).applyInArrow(run, schema)


_MEASURED = "n int, n_pages int, names array<string>, resources array<string>, failed string"
_PLAN = "__id bigint, part bigint, base bigint, first_page int, names array<string>, resources array<string>, previous bigint, following bigint, error string"
_INDEX = "part bigint, content binary, nums array<bigint>, offsets array<int>, first_page int, page_nums array<bigint>, field_nums array<bigint>"
_TOLD = "size bigint, item bigint, shared array<struct<kind:string,name:string,value:binary>>, look binary, need boolean, computed array<bigint>, layers array<binary>, off array<binary>, labels array<string>"


def merge_parts(docs: DataFrame, *, by: list[str], order: str, pages_col: str | None = None) -> DataFrame:
    """As ``merge``, but a file comes as pieces: rows (``by``, ``part``, ``content``) whose contents in the order of ``part`` are
    the file. Each document is a piece, made in a task of its own; a group's only task sees numbers and names, no contents. With
    a piece come the entries of the file's index, page tree and form that lead to it, so tables(..., parts=True) read it alone.
    A group with a document that can't be read gives one row with ``error``."""
    from quire.plans.scratch import write_table

    own = [docs.schema[b] for b in by]
    schema = lambda ddl: T.StructType([*own, *T.StructType.fromDDL(ddl).fields])
    chosen = docs.where("content is not null").select(*by, F.monotonically_increasing_id().alias("__id"), F.col(order).alias("__order"), *([F.col(pages_col).alias("__pages")] if pages_col else []), "content")
    kept = [f for f in chosen.schema.fields if f.name not in by]
    measured_schema = T.StructType([*own, *kept, *T.StructType.fromDDL(_MEASURED).fields])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernels import rewrite as k
        from quire.kernels.document import Document, PdfError

        kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                try:
                    f = k.fragment(Document(batch.column("content")[i].as_py()), 0, batch.column("__pages")[i].as_py() if pages_col else None, k.FIRST, lambda _, name: name, lambda *_: True)
                    rows.append((f.used, len(f.pages), f.names, [f"{kind}/{name}" for kind, found in f.resources.items() for name in found], None))
                except (PdfError, ValueError, RecursionError) as e:
                    rows.append((0, 0, [], [], f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], names=measured_schema.names)

    measured = write_table(chosen.mapInArrow(measure, measured_schema), "measured")

    def plan(key, group):
        from itertools import accumulate

        from quire.kernels import rewrite as k

        failed = [x for x in group.column("failed").to_pylist() if x]
        if failed:
            rows = [(None,) * 8 + (min(failed),)]
        else:
            group = group.sort_by([("__order", "ascending"), ("__id", "ascending")])
            ids, used, n_pages = (group.column(c).to_pylist() for c in ("__id", "n", "n_pages"))
            bases, firsts = list(accumulate(used, initial=k.FIRST)), list(accumulate(n_pages, initial=0))
            names, seen, rows = k.FreeNames(), set(), []
            items = [b if n else None for b, n in zip(bases, n_pages)]  # a document's entry of the outline is its first object
            before, last = [], None
            for item in items:
                before.append(last)
                last = item if item is not None else last
            after, last = [], None
            for item in reversed(items):
                after.append(last)
                last = item if item is not None else last
            after.reverse()
            for i, (own_names, shared) in enumerate(zip(group.column("names").to_pylist(), group.column("resources").to_pylist())):
                new = [x for x in shared if x not in seen]
                seen.update(new)
                rows.append((ids[i], i + 1, bases[i], firsts[i], [names.of(x) for x in own_names], new, before[i], after[i], None))
        return _table(key, rows, plan_schema, len(by))

    plan_schema = schema(_PLAN)
    planned = write_table(measured.drop("content", "__pages").groupBy(*by).applyInArrow(plan, plan_schema), "merging")
    pieces_schema = schema(_INDEX + ", " + _TOLD)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernels import rewrite as k
        from quire.kernels.document import Document
        from quire.kernels.syntax import Ref, serialize

        arrow = to_arrow_schema(T.StructType(pieces_schema.fields[len(by) :]))
        for batch in batches:
            contents = batch.column("content")
            given = [batch.column(c) for c in ("part", "base", "first_page", "names", "resources", "previous", "following", *(["__pages"] if pages_col else []))]
            rows, began, size = [], 0, 0
            for i in range(batch.num_rows):
                part, base, first_page, names, resources, previous, following, *pages = (c[i].as_py() for c in given)
                f = k.fragment(Document(contents[i].as_py()), part - 1, pages[0] if pages else None, base, lambda j, _, names=names: names[j], lambda kind, name, new=frozenset(resources): f"{kind}/{name}" in new)
                if f.item is not None:
                    f.objects[f.item.num] |= ({"Prev": Ref(previous)} if previous is not None else {}) | ({"Next": Ref(following)} if following is not None else {})
                out, offsets = bytearray(k.header() if part == 1 else b""), []
                for num, value in f.objects.items():
                    offsets.append(len(out))
                    out += b"%d 0 obj\n" % num + serialize(value) + b"\nendobj\n"
                shared = [{"kind": kind, "name": name, "value": serialize(v)} for kind, found in f.resources.items() for name, v in found.items()]
                rows.append((part, bytes(out), list(f.objects), offsets, first_page, [p.num for p in f.pages], [x.num for x in f.fields], len(out), f.item and f.item.num, shared, serialize(f.look) if f.look else None, f.need, [x.num for x in f.computed], list(map(serialize, f.layers)), list(map(serialize, f.off)), f.labels))
                size += len(out)
                if len(rows) >= ROWS or size >= BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(b).slice(began, len(rows)) for b in by), *(pa.array([r[j] for r in rows], field.type) for j, field in enumerate(arrow))], names=pieces_schema.names)
                    rows, began, size = [], i + 1, 0

    joined = measured.select(*by, "__id", *(["__pages"] if pages_col else []), "content").join(planned.drop(*by, "error"), "__id")
    pieces = write_table(joined.mapInArrow(build, pieces_schema), "pieces")
    end_schema = schema(_INDEX)

    def end(key, group):
        from array import array

        import numpy as np
        import pyarrow.compute as pc

        from quire.kernels import rewrite as k
        from quire.kernels.syntax import Ref

        group = group.sort_by("part").combine_chunks()
        flat = lambda c: group.column(c).combine_chunks().flatten()
        starts = np.concatenate([[0], np.cumsum(group.column("size").to_numpy())])
        nums = flat("nums").to_numpy()
        places = np.zeros(max(k.FIRST, int(nums.max(initial=0)) + 1), np.uint64)
        places[nums] = flat("offsets").to_numpy() + np.repeat(starts[:-1], pc.list_value_length(group.column("nums")).to_numpy())
        offsets = array("Q", places.tobytes())
        shared: dict[str, dict] = {}
        for row in flat("shared").to_pylist():
            shared.setdefault(row["kind"], {})[row["name"]] = row["value"]
        labels = [(first + j, text) for first, own_labels in zip(group.column("first_page").to_pylist(), group.column("labels").to_pylist()) for j, text in enumerate(own_labels or [])]
        refs = lambda c: [Ref(n) for n in flat(c).to_pylist()]
        look = next((x for x in group.column("look").to_pylist() if x is not None), None)
        items = [Ref(n) for n in group.column("item").to_pylist() if n is not None]
        out, mine = k.closing(int(starts[-1]), offsets, refs("page_nums"), items, refs("field_nums"), shared, look, any(group.column("need").to_pylist()), refs("computed"), flat("layers").to_pylist(), flat("off").to_pylist(), labels)
        return _table(key, [(group.num_rows + 1, out, list(mine), list(mine.values()), 0, [], [])], end_schema, len(by))

    ends = write_table(pieces.drop("content").groupBy(*by).applyInArrow(end, end_schema), "ends")
    whole = pieces.select(*end_schema.names).unionByName(ends).withColumn("error", F.lit(None).cast("string"))
    return whole.unionByName(planned.where("error is not null").select(*by, "error"), allowMissingColumns=True)


def _table(key: tuple, rows: list[tuple], schema: T.StructType, n_keys: int) -> pa.Table:
    """Rows of a group below its key."""
    arrow = to_arrow_schema(schema)
    columns = [pa.array([v.as_py()] * len(rows), arrow.field(j).type) for j, v in enumerate(key)] + [pa.array([r[j] for r in rows], arrow.field(n_keys + j).type) for j in range(len(arrow) - n_keys)]
    return pa.Table.from_arrays(columns, schema=arrow)


__all__ = ["check_password", "decrypt", "merge", "merge_parts", "recompress_streams", "remove_attachments", "remove_javascript", "remove_unused", "repair", "repair_streams", "rewrite", "rotate_pages", "select_pages", "strip_metadata"]
