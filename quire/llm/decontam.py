"""Operator 5: benchmark decontamination by template canonicalisation, in DataFrame operations only.

Names, numbers and units become typed slots; a text becomes a sequence of template words. Windows of eight template words
(an item with fewer: the whole item, four words at least) with five literal words or more are hashed and joined with the
items' windows. Windows that agree on where the item would start are one alignment; a document holds an item where
an alignment has four windows or all of the item's. Then the slots are read: within an alignment one value of the item
must always meet the same value in the document (Anna may be Maria everywhere, not Maria here and Eva there), else the
alignment only counts by its windows without slots. An item's first word has no word before it that would make it a slot,
but has one in a document that leads up to it: the item's first window is looked for in both forms.

Windows of the plain words, whatever their number of literals, are a second, exact path by the same count: it finds verbatim
copies of items with few template windows or none, and those of other case or punctuation. What the templates find
is reported by its template windows.

Scale. Documents are read twice and never shuffled: item windows are broadcast if their number is under a stated
bound (else the join is a plain hash join), and so are the alignments to be read again. Only matches are shuffled.

Defined results: null, empty or short texts hold nothing; null items and items under four words are not looked for; equal
items each give a row; rows sharing a doc_id count as one document; a null doc_id gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize

#: marks put before a slot's value (private-use characters)
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: fixed values: units of measure that make a slot after a number
UNITS = "kg|g|mg|km|m|cm|mm|mi|ft|in|lb|lbs|oz|l|ml|s|ms|min|h|hr|hrs|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|meters|metres|miles|grams|liters|litres|dollars|euros|cents|percent|degrees|hz|khz|mhz|kb|mb|gb|kw|w|v|pounds|feet|inches"
WINDOW, LITERALS, LEAST_WINDOWS, SHORTEST = 8, 5, 4, 4
#: hashed with windows of plain words, which so meet only their like
EXACT = "plain words"
#: item windows, and alignments, that may be broadcast: some tens of MB
BROADCAST_ROWS = 500_000


def marked(text: Column) -> Column:
    """The words of a text, lower-cased, slots with their mark before the value."""
    blank = "[\\s\\p{Z}]"  # a break in a line is a blank
    t = F.regexp_replace(text, f"([\\p{{L}}\\p{{N}},;:]{blank}+)(?=\\p{{Lu}}\\p{{Ll}})", f"$1{NAME}")
    t = F.regexp_replace(t, "(\\p{N}+)", f"{NUMBER}$1")
    t = F.regexp_replace(F.lower(t), f"({NUMBER}\\p{{N}}+){blank}*({UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1 {UNIT}$2")
    return F.array_remove(F.split(t, f"[^a-z\\p{{L}}\\p{{M}}\\p{{N}}{NAME}{NUMBER}{UNIT}]+"), "")


def templates(words: Column) -> Column:
    """A word, or words with blanks between them, with the slots' values left out."""
    return F.regexp_replace(words, f"([{NAME}{NUMBER}{UNIT}])[\\p{{L}}\\p{{M}}\\p{{N}}]+", "$1")


def word_hashes(words: Column, exact: bool = False) -> Column:
    """A hash of each marked word, in order: of the word with its slots' values left out, or (exact) without marks."""

    def one(w: Column) -> Column:
        slot = w.contains(NAME) | w.contains(NUMBER) | w.contains(UNIT)
        return F.when(slot, F.xxhash64(bare(w) if exact else templates(w))).otherwise(F.xxhash64(w))

    return F.transform(words, one)


def _joined(values: Column, by: int, *more: Column) -> Column:
    """Hashes of each value with the one ``by`` places on."""
    n = F.greatest(F.lit(0), F.size(values) - by)
    return F.zip_with(F.slice(values, 1, n), F.slice(values, by + 1, n), lambda x, y: F.xxhash64(x, y, *more))


def windows(hashes: Column, sizes: list[int], exact: bool = False) -> list[Column]:
    """For each size from ``SHORTEST`` to ``WINDOW``: a hash of each window of so many words, by position.

    Windows of two, four and eight words are hashes of two halves; those between of two windows of four that overlap.
    """
    kind = F.lit(EXACT if exact else "")

    def pairs(one: Column) -> Column:
        return _bound(_joined(one, 1), fours)

    def fours(two: Column) -> Column:
        return _bound(_joined(two, 2), every)

    def every(four: Column) -> Column:
        return F.array(*(_joined(four, size - 4, F.lit(size), kind) for size in sizes))

    found = _bound(hashes, pairs)
    return [found[i] for i in range(len(sizes))]


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: it is bound to a variable, not repeated where it is used."""
    return F.transform(F.array(value), use)[0]


def bare(words: Column) -> Column:
    """A word without marks."""
    for mark in (NAME, NUMBER, UNIT):
        words = F.replace(words, F.lit(mark), F.lit(""))
    return words


def _item_windows(items: DataFrame) -> DataFrame:
    """entry, item_id, exact (plain words, not templates), size, at, raw, window, plain (no slot in it): distinct windows."""
    told = F.regexp_replace(F.col("text"), "^[^\\p{L}\\p{N}]+", "")
    words = items.where("text is not null").select("item_id", marked(F.col("text")).alias("words"), marked(F.concat(F.lit(": "), told)).alias("inside"))
    words = words.withColumn("entry", F.monotonically_increasing_id()).withColumn("raw", F.col("inside"))
    forms = [(exact, F.transform(c, bare if exact else templates)) for exact, c in ((False, "words"), (False, "inside"), (True, "words"))]
    words = words.select("entry", "item_id", "raw", F.explode(F.array(*(F.struct(F.lit(e).alias("exact"), t.alias("t")) for e, t in forms))).alias("form"))
    words = words.select("entry", "item_id", "raw", "form.*").withColumn("size", F.least(F.lit(WINDOW), F.size("t"))).where(f"size >= {SHORTEST}")
    cut = words.select("entry", "item_id", "exact", "size", "raw", F.posexplode(F.expr("transform(array(t), v -> transform(sequence(0, size(v) - size), i -> slice(v, i + 1, size)))[0]")).alias("at", "w"))
    cut = cut.withColumn("slots", F.expr(f"size(filter(w, x -> x rlike '[{NAME}{NUMBER}{UNIT}]'))")).where(F.col("exact") | (F.col("size") - F.col("slots") >= F.least(F.lit(LITERALS), F.col("size") - 1)))
    # a window of ``size`` words is hashed as in documents: its own words are all there is
    sizes = list(range(SHORTEST, WINDOW + 1))
    hashed = {exact: F.array(*windows(word_hashes(F.col("w"), exact), sizes, exact))[F.col("size") - SHORTEST][0] for exact in (False, True)}
    window = F.when(F.col("exact"), hashed[True]).otherwise(hashed[False])
    return cut.select("entry", "item_id", "exact", "size", "at", "raw", window.alias("window"), (F.col("slots") == 0).alias("plain")).dropDuplicates(["entry", "exact", "at", "window"])


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, item_windows, at (word of the document where the item begins), verbatim: a row a find."""
    found = materialize(_item_windows(items), "item-windows")
    info = {(r["exact"], r["size"]): r["n"] for r in found.groupBy("exact", "size").agg(F.count("*").alias("n")).collect()}  # 2 * WINDOW rows at most
    counts = found.groupBy("entry", "exact").agg(F.countDistinct("at").alias("item_windows"))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), marked(F.col("text")).alias("words"))
    if not info:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched long, item_windows long, at long, verbatim boolean")
    # all kinds and sizes of windows in one reading: their arrays are put in a row, ``before`` is where one begins
    kinds = sorted(info)
    sizes = {exact: [size for e, size in kinds if e == exact] for exact in (False, True)}
    told = F.concat(*(w for exact in (False, True) if sizes[exact] for w in windows(word_hashes(F.col("words"), exact), sizes[exact], exact)))
    before, sofar = F.lit(0), F.lit(0)
    for (exact, size), (_, last) in zip(kinds[1:], kinds):
        sofar = sofar + F.greatest(F.lit(0), F.col("n_words") - last + 1)
        before = F.when((F.col("exact") == exact) & (F.col("size") == size), sofar).otherwise(before)
    mine = found.select("entry", "item_id", "exact", "size", F.col("at").alias("item_at"), "window", "plain")
    # n_words is taken before the windows are told: a row of a window must not carry its document's words
    told = texts.select("doc_id", F.size("words").alias("n_words"), "words").select("doc_id", "n_words", F.posexplode(told).alias("place", "window"))
    hits = told.join(F.broadcast(mine) if sum(info.values()) <= BROADCAST_ROWS else mine, "window").withColumn("at", F.col("place") - before)
    aligned = hits.groupBy("doc_id", "entry", "item_id", "exact", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.countDistinct("item_at").alias("matched"), F.countDistinct(F.when(F.col("plain"), F.col("item_at"))).alias("plain"))
    aligned = aligned.join(counts, ["entry", "exact"]).withColumn("needed", F.least(F.col("item_windows"), F.lit(LEAST_WINDOWS))).where("matched >= needed")
    aligned = materialize(aligned, "alignments")
    # the words of the alignments that rest on slots are read again
    open_ = aligned.where("not exact and plain < item_windows").join(found.groupBy("entry").agg(F.first("raw").alias("item_words")), "entry").select("doc_id", "entry", "shift", "item_words")
    open_ = materialize(open_, "open-alignments")
    near = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS // 10 else open_
    beside = "transform(array(words), w -> transform(sequence(greatest(0, -shift), least(size(item_words), size(w) - shift) - 1), i -> struct(item_words[i] as a, w[i + shift] as b)))[0]"
    pairs = texts.join(near, "doc_id").select("doc_id", "entry", "shift", F.explode(F.expr(beside)).alias("p"))
    # same kind of slot on both sides, one value of the item against one of the document
    slots = pairs.where(F.col("p.a").rlike(f"[{NAME}{NUMBER}{UNIT}]") & (templates(F.col("p.a")) == templates(F.col("p.b"))))
    values = slots.groupBy("doc_id", "entry", "shift", "p.a").agg(F.countDistinct("p.b").alias("n"), F.max((F.col("p.a") != F.col("p.b")).cast("int")).alias("changed"))
    judged = values.groupBy("doc_id", "entry", "shift").agg(F.max("n").alias("n"), F.max("changed").alias("changed")).withColumn("exact", F.lit(False))
    whole = aligned.join(judged, ["doc_id", "entry", "shift", "exact"], "left").where("coalesce(n, 1) = 1 or plain >= needed")
    best = whole.groupBy("doc_id", "entry", "item_id").agg(F.max(F.struct((~F.col("exact")).alias("template"), "matched", (-F.col("shift")).alias("back"), "item_windows", F.coalesce(F.col("changed") == 0, F.lit(True)).alias("verbatim"))).alias("b"), F.max(F.col("exact") & (F.col("matched") == F.col("item_windows"))).alias("whole"))
    return best.select("doc_id", "item_id", "b.matched", "b.item_windows", (-F.col("b.back")).cast("long").alias("at"), (F.col("b.verbatim") | F.col("whole")).alias("verbatim"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ids of documents that hold an item."""
    return find_items(docs, items).select("doc_id").distinct()
