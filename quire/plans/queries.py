"""Queries of the document operators over the driver's tables, and their SQL twins.

The tables hold no documents, so a query first makes them of rows (``synth``), then runs the operator; the twin computes the
same from the rows. Every query takes its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import engine
from quire.functions import scalars as S
from quire.plans import synth
from quire.plans.scratch import write_table
from quire.session import bounded
from quire.sources.pdf import from_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Small tables come as one file: documents are made and read on all cores."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def dealt(df: DataFrame) -> DataFrame:
    """Documents made of grouped rows are few and large, and the shuffle that groups them may end in one task: deal them out."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def text_pdfs(spark: SparkSession, sf_dir: str, how: str = "plain", filters: tuple[str, ...] = (), **options) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return from_rows(docs, lambda r: synth.text_pdf(r["text"], how, filters, **options), ["doc_id"])


_LINES = """
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(0, greatest(1, (len(ls) + 49) // 50))) AS i FROM l),
t AS (SELECT doc_id, i::INTEGER AS page_index, array_to_string(ls[i * 50 + 1:i * 50 + 50], chr(10)) AS text FROM p)
"""
TEXT_SQL = _LINES + "SELECT doc_id, page_index, text FROM t"


def _text_query(name: str, how: str = "plain", filters: tuple[str, ...] = (), **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine.text(text_pdfs(spark, sf_dir, how, filters, **options)).select("doc_id", "page_index", "text")

    run.__name__ = name
    query(TEXT_SQL)(run)


_text_query("text_pages")
_text_query("text_flate", filters=("FlateDecode",))
_text_query("text_lzw", filters=("LZWDecode",))
_text_query("text_ascii85", filters=("ASCII85Decode", "FlateDecode"))
_text_query("text_asciihex", filters=("ASCIIHexDecode",))
_text_query("text_runlength", filters=("RunLengthDecode",))
_text_query("text_composite_font", how="type0")
_text_query("text_actual", how="actual")
_text_query("text_form", how="form")
_text_query("text_gaps", how="gaps")
_text_query("text_xref_stream", xref="stream", packed=frozenset(range(1, 4)))


@query(_LINES + "SELECT doc_id, string_agg(text, chr(12) ORDER BY page_index) AS text FROM t GROUP BY doc_id")
def text_all(spark, sf_dir):
    return engine.all_text(text_pdfs(spark, sf_dir))


@query(_LINES + "SELECT doc_id, page_index, text FROM t WHERE page_index IN (0, 2)")
def text_page_subset(spark, sf_dir):
    return engine.text(text_pdfs(spark, sf_dir), pages=[0, 2]).select("doc_id", "page_index", "text")


@query(_LINES + """SELECT lang, count(*)::BIGINT AS n_pages, sum(CASE WHEN t.text = '' THEN 0 ELSE len(string_split(replace(t.text, chr(10), ' '), ' ')) END)::BIGINT AS n_words
FROM t JOIN documents d ON d.doc_id = t.doc_id GROUP BY lang""")
def text_words_by_lang(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    found = engine.text(from_rows(docs, lambda r: synth.text_pdf(r["text"], filters=("FlateDecode",)), ["doc_id", "lang"]))
    words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "[ \n]")))
    return found.groupBy("lang").agg(F.count("*").alias("n_pages"), F.sum(words).cast("long").alias("n_words"))


@query("SELECT doc_id, 'Document ' || doc_id AS title, source AS author, lang AS subject, lang AS language, '1.7' AS version, n_pages AS page_count, false AS encrypted, false AS repaired FROM documents JOIN (" + _LINES + "SELECT doc_id AS d, count(*)::INTEGER AS n_pages FROM t GROUP BY doc_id) x ON d = doc_id")
def info_basic(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return engine.info(from_rows(docs, synth.info_pdf, ["doc_id"])).select("doc_id", "title", "author", "subject", "language", "version", "page_count", "encrypted", "repaired")


def _order_dates(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("+02'30'")).alias("created"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))


_DATES_SQL = "SELECT o_orderkey, epoch(o_orderdate)::BIGINT - 9000 AS created_s, epoch(o_orderdate)::BIGINT AS modified_s FROM orders"


@query(_DATES_SQL)
def info_dates(spark, sf_dir):
    docs = from_rows(spread(_order_dates(spark, sf_dir)), synth.dates_pdf, ["o_orderkey"])
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return engine.info(docs).select("o_orderkey", seconds("creation_date").alias("created_s"), seconds("mod_date").alias("modified_s"))


@query(_DATES_SQL)
def parse_pdf_date(spark, sf_dir):
    seconds = lambda c: F.unix_timestamp(S.pdf_date(F.col(c)).cast("timestamp"))
    return _order_dates(spark, sf_dir).select("o_orderkey", seconds("created").alias("created_s"), seconds("modified").alias("modified_s"))


@query("SELECT c_custkey, c_name AS creator, c_mktsegment AS segment, c_mktsegment || ', x' AS subjects FROM customer")
def xmp_property(spark, sf_dir):
    xmp = F.concat(F.lit("<x:xmpmeta><rdf:Description xmp:Segment=\""), F.col("c_mktsegment"), F.lit("\"><dc:creator><rdf:Alt><rdf:li>"), F.col("c_name"), F.lit("</rdf:li></rdf:Alt></dc:creator><dc:subject><rdf:Bag><rdf:li>"), F.col("c_mktsegment"), F.lit("</rdf:li><rdf:li>x</rdf:li></rdf:Bag></dc:subject></rdf:Description></x:xmpmeta>"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.xmp_property(xmp, "dc:creator").alias("creator"), S.xmp_property(xmp, "xmp:Segment").alias("segment"), S.xmp_property(xmp, "dc:subject").alias("subjects"))


@query("SELECT c_custkey, chr((65 + c_custkey % 26)::INTEGER) || '&lt;' || c_mktsegment || chr((8192 + c_custkey % 2000)::INTEGER) || '<&>' || chr((128512 + c_custkey % 50)::INTEGER) || '&#xD800;&none;' AS value FROM customer")
def xml_entities(spark, sf_dir):
    """Named and numeric entities, among them one that gives the beginning of another, and two that are none."""
    number, key = lambda n: n.cast("string"), F.col("c_custkey")
    source = F.concat(F.lit("&#"), number(65 + key % 26), F.lit(";&amp;lt;"), F.col("c_mktsegment"), F.lit("&#x"), F.hex(8192 + key % 2000), F.lit(";&lt;&amp;&gt;&#"), number(128512 + key % 50), F.lit(";&#xD800;&none;"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.unescape_xml(source).alias("value"))


@query("SELECT p_partkey, p_name || ['•', '†', '‡', '…', '—', '–', 'ƒ', '⁄', '‹', '›'][1 + (p_partkey % 10)::INTEGER] || '€' AS value FROM part")
def pdfdoc_text(spark, sf_dir):
    """Text strings in PDFDocEncoding, through the Column form and through a file's dictionary."""
    raw = F.concat(F.encode("p_name", "ISO-8859-1"), F.unhex(F.hex(128 + F.col("p_partkey") % 10)), F.unhex(F.lit("A0")))
    return table(spark, sf_dir, "part").select("p_partkey", S.decode_text(raw).alias("value"))


_PARTS_SQL = "SELECT p_partkey % 100 AS doc, p_partkey, (100 + p_partkey % 500)::INTEGER AS w, (200 + p_size * 3)::INTEGER AS h, (p_partkey % 7)::INTEGER AS x, (p_size % 5)::INTEGER AS y, ((p_partkey % 5) * 90)::INTEGER AS r FROM part"


@query(f"SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY p_partkey) - 1)::INTEGER AS page_index, (w - x)::DOUBLE AS width, (h - 5 - y)::DOUBLE AS height, (r % 360)::INTEGER AS rotate FROM ({_PARTS_SQL})")
def pages_geometry(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("quire_part")
    rows = spark.sql(_PARTS_SQL.replace("FROM part", "FROM quire_part"))
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "w", "h", "x", "y", "r"))).alias("rows"))
    return engine.pages(from_rows(dealt(docs), synth.geometry_pdf, ["doc"])).select("doc", "page_index", "width", "height", "rotate")


@query(f"SELECT (w - x)::DOUBLE AS width, (h - 5 - y)::DOUBLE AS height, (r % 360)::INTEGER AS rotate, count(*)::BIGINT AS n FROM ({_PARTS_SQL}) GROUP BY 1, 2, 3")
def page_sizes(spark, sf_dir):
    return pages_geometry(spark, sf_dir).groupBy("width", "height", "rotate").agg(F.count("*").alias("n"))


_ROMAN = "(CASE WHEN n >= 20 THEN 'xx' WHEN n >= 10 THEN 'x' ELSE '' END || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1])"
_LABEL = f"CASE s WHEN 'D' THEN n::VARCHAR WHEN 'r' THEN {_ROMAN} WHEN 'R' THEN upper({_ROMAN}) WHEN 'A' THEN repeat(chr((65 + (n - 1) % 26)::INTEGER), ((n - 1) // 26 + 1)::INTEGER) ELSE repeat(chr((97 + (n - 1) % 26)::INTEGER), ((n - 1) // 26 + 1)::INTEGER) END"


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), f AS (SELECT i AS j, n_name AS first_name, n_nationkey AS first_key FROM o WHERE i % 5 = 0),
x AS (SELECT i::INTEGER AS page_index, ['D', 'r', 'R', 'a', 'A'][(i // 5 % 5 + 1)::INTEGER] AS s, first_name, first_key + 1 + i % 5 AS n FROM o JOIN f ON j = i - i % 5)
SELECT page_index, first_name[1:2] || '-' || {_LABEL} AS label FROM x""")
def page_labels(spark, sf_dir):
    nations = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations")
    docs = table(spark, sf_dir, "nation").agg(nations)  # 25 rows by definition of the table
    return engine.pages(from_rows(docs.withColumn("k", F.lit(0)), synth.labels_pdf, ["k"])).select("page_index", "label")


@query(f"SELECT n_nationkey, 'r: ' || {_LABEL.replace('CASE s', "CASE 'r'")} AS low, {_LABEL.replace('CASE s', "CASE 'A'")} AS letter FROM (SELECT n_nationkey, n_nationkey + 1 AS n FROM nation)")
def label_format(spark, sf_dir):
    n = (F.col("n_nationkey") + 1).cast("int")
    return table(spark, sf_dir, "nation").select("n_nationkey", S.page_label(F.lit("r"), F.lit("r: "), n).alias("low"), S.page_label(F.lit("A"), F.lit(None).cast("string"), n).alias("letter"))


@query("SELECT p_partkey, array_to_string(list_concat(range(0, 3), [p_size + 4], range(p_size + 9, 70)), ',') AS pages FROM part")
def page_ranges(spark, sf_dir):
    spec = F.concat(F.lit("1-3, "), (F.col("p_size") + 5).cast("string"), F.lit(","), (F.col("p_size") + 10).cast("string"), F.lit("-"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(S.page_ranges(spec, F.lit(70)), lambda x: x.cast("string")), ",").alias("pages"))


@query("""SELECT l_orderkey, l_linenumber, greatest(1, floor(l_quantity * 100 * s + 0.5))::INTEGER AS width, greatest(1, floor((l_linenumber * 211 + 50) * s + 0.5))::INTEGER AS height
FROM (SELECT *, least(1.0::DOUBLE, 1600::DOUBLE / (l_quantity * 100), 900::DOUBLE / (l_linenumber * 211 + 50)) AS s FROM lineitem)""")
def fit_inside(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    size = S.fit_inside(F.col("l_quantity") * 100, (F.col("l_linenumber") * 211 + 50).cast("double"), F.lit(1600.0), F.lit(900.0))
    return rows.select("l_orderkey", "l_linenumber", size.alias("s")).select("l_orderkey", "l_linenumber", "s.width", "s.height")


def _region_docs(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return from_rows(table(spark, sf_dir, "region").join(nations, "r_regionkey"), synth.outline_pdf, ["r_regionkey"])


_OUTLINE_SQL = """SELECT r_regionkey, 1 AS depth, r_name AS title, 0 AS page_index, true AS open FROM region UNION ALL
SELECT n_regionkey, 2, n_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER, false FROM nation"""


@query(_OUTLINE_SQL)
def outline_rows(spark, sf_dir):
    return engine.outline(_region_docs(spark, sf_dir)).select("r_regionkey", "depth", "title", "page_index", "open")


@query("""SELECT page_id, url, -1 AS target_page_index, 10.0::DOUBLE AS x0, 20.0::DOUBLE AS y0 FROM pages UNION ALL SELECT page_id, NULL, 0, 0.0, 0.0 FROM pages""")
def links(spark, sf_dir):
    docs = from_rows(spread(table(spark, sf_dir, "pages").select("page_id", "url")), synth.link_pdf, ["page_id"])
    return engine.links(docs).select("page_id", "url", F.coalesce("target_page_index", F.lit(-1)).alias("target_page_index"), F.col("rect")[0].alias("x0"), F.col("rect")[1].alias("y0"))


@query("""SELECT c_custkey, 'customer.name' AS name, 'text' AS type, c_name AS value, false AS read_only, true AS required FROM customer
UNION ALL SELECT c_custkey, 'customer.key', 'text', c_custkey::VARCHAR, true, false FROM customer UNION ALL SELECT c_custkey, 'segment', 'combo', c_mktsegment, false, false FROM customer""")
def form_fields(spark, sf_dir):
    docs = from_rows(spread(table(spark, sf_dir, "customer")), synth.form_pdf, ["c_custkey"])
    return engine.fields(docs).select("c_custkey", "name", "type", F.col("value")[0].alias("value"), "read_only", "required")


def _attachment_docs(spark, sf_dir):
    return from_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), synth.attachment_pdf, ["doc_id"])


@query("SELECT doc_id, doc_id::VARCHAR AS name, doc_id || '.txt' AS filename, lang AS description, octet_length(encode(coalesce(text, '')))::BIGINT AS size, 'text/plain' AS mime_type FROM documents")
def attachments(spark, sf_dir):
    return engine.attachments(_attachment_docs(spark, sf_dir)).select("doc_id", "name", "filename", "description", "size", "mime_type")


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def attachment_bytes(spark, sf_dir):
    return engine.attachments(_attachment_docs(spark, sf_dir), data=True).select("doc_id", F.md5("data").alias("digest"))


def _image_docs(spark, sf_dir):
    pixel = lambda x: F.pmod(F.floor(x * 100), F.lit(256)).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: pixel(x.cast("double"))).alias("pixels"))
    return from_rows(spread(rows), synth.image_pdf, ["vec_id"])


@query("SELECT vec_id, len(embedding)::INTEGER AS width, 1 AS height, 8 AS bits_per_component, 'DeviceGray' AS color_space, '0,1' AS pages FROM embeddings")
def images(spark, sf_dir):
    return engine.images(_image_docs(spark, sf_dir)).select("vec_id", "width", "height", "bits_per_component", "color_space", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("SELECT vec_id, upper(array_to_string(list_transform(embedding, lambda x: printf('%02x', ((floor(x::DOUBLE * 100)::BIGINT % 256 + 256) % 256)::INTEGER)), '')) AS samples FROM embeddings")
def image_pixels(spark, sf_dir):
    return engine.images(_image_docs(spark, sf_dir), data=True).select("vec_id", F.hex("data").alias("samples"))


_IMAGE_ROWS = """SELECT p_partkey, p_size % 4 = 3 AND p_partkey % 10 = 0 AS image_mask, CASE p_partkey % 9 WHEN 0 THEN 'JBIG2Decode' WHEN 1 THEN 'CCITTFaxDecode' WHEN 2 THEN 'Odd' ELSE 'FlateDecode' END AS f,
CASE p_partkey % 6 WHEN 0 THEN 'DeviceCMYK' WHEN 1 THEN 'Indexed(DeviceRGB)' WHEN 2 THEN 'DeviceGray' WHEN 3 THEN 'Lab' ELSE 'DeviceRGB' END AS color_space,
CASE WHEN p_size % 5 = 0 THEN 16 ELSE 8 END AS bits, p_size * 1000 AS encoded_bytes FROM part"""


@query(f"""SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN image_mask THEN 'imageMask' WHEN f = 'JBIG2Decode' THEN 'jbig2' WHEN f = 'CCITTFaxDecode' THEN 'ccitt' WHEN f = 'Odd' THEN 'filter' WHEN encoded_bytes < 16384 THEN 'small'
WHEN bits <> 8 THEN 'bitsPerComponent' WHEN color_space LIKE 'Indexed%' THEN 'indexed' WHEN color_space = 'DeviceCMYK' THEN 'cmyk' WHEN color_space = 'Lab' THEN 'lab' END AS reason FROM ({_IMAGE_ROWS})) GROUP BY reason""")
def image_skip_reasons(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("quire_part")
    rows = spark.sql(_IMAGE_ROWS.replace("FROM part", "FROM quire_part"))
    image = F.struct("image_mask", F.array("f").alias("filters"), "color_space", F.col("bits").alias("bits_per_component"), F.lit(100).alias("width"), F.lit(100).alias("height"), "encoded_bytes")
    return rows.select(S.skip_reason(image).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_id, event_id) AS value FROM events GROUP BY user_id")
def xref_updates(spark, sf_dir):
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("values"))
    found = engine.objects(from_rows(dealt(docs), synth.updated_pdf, ["user_id"]))
    return found.where("value like '<</Value %'").select("user_id", F.regexp_extract("value", "/Value (\\d+)", 1).cast("long").alias("value"))


@query(_LINES + "SELECT doc_id, page_index, text, true AS repaired FROM t")
def recover_scan(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def cut(r):
        data = synth.text_pdf(r["text"])
        return data[: data.rindex(b"xref\n0")]

    return engine.text(from_rows(docs, cut, ["doc_id"]), repaired=True).select("doc_id", "page_index", "text", "repaired")


def _rewritten(name: str, plugins, how: str = "plain") -> None:
    def run(spark, sf_dir):
        return engine.text(engine.rewrite(text_pdfs(spark, sf_dir, how), plugins()).select("doc_id", "content")).select("doc_id", "page_index", "text")

    run.__name__ = name
    query(TEXT_SQL)(run)


_rewritten("recompress_streams", lambda: [engine.recompress_streams()])
_rewritten("remove_unused", lambda: [engine.remove_unused()])


@query(TEXT_SQL)
def repair_streams(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    wrong = from_rows(docs, lambda r: synth.text_pdf(r["text"]).replace(b"/Length ", b"/Length 9"), ["doc_id"])
    return engine.text(engine.repair(wrong).select("doc_id", "content")).select("doc_id", "page_index", "text")


@query("SELECT doc_id, NULL::VARCHAR AS title, NULL::VARCHAR AS metadata, false AS has_javascript, 2::BIGINT AS scripts FROM documents")
def clean(spark, sf_dir):
    docs = from_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), synth.script_pdf, ["doc_id"])
    done = engine.rewrite(docs, [engine.remove_javascript(), engine.strip_metadata()])
    found = engine.info(done.select("doc_id", F.col("report")["scripts"].alias("scripts"), "content"))
    return found.select("doc_id", "title", "metadata", "has_javascript", "scripts")


@query("SELECT doc_id, 0 AS attachments FROM documents")
def remove_attachments(spark, sf_dir):
    done = engine.rewrite(_attachment_docs(spark, sf_dir), [engine.remove_attachments()])
    return engine.info(done.select("doc_id", "content")).select("doc_id", "attachments")


@query(f"SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY p_partkey) - 1)::INTEGER AS page_index, ((r + 90) % 360)::INTEGER AS rotate FROM ({_PARTS_SQL})")
def rotate_pages(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("quire_part")
    docs = spark.sql(_PARTS_SQL.replace("FROM part", "FROM quire_part")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "w", "h", "x", "y", "r"))).alias("rows"))
    done = engine.rewrite(from_rows(dealt(docs), synth.geometry_pdf, ["doc"]), [engine.rotate_pages(90)])
    return engine.pages(done.select("doc", "content")).select("doc", "page_index", "rotate")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT r_regionkey, 1 AS depth, r_name AS title, 1 AS page_index FROM region UNION ALL SELECT n_regionkey, 2, n_name, 0 FROM n WHERE i = 2""")
def select_pages(spark, sf_dir):
    done = engine.rewrite(_region_docs(spark, sf_dir), [engine.select_pages([2, 0])])
    return engine.outline(done.select("r_regionkey", "content")).select("r_regionkey", "depth", "title", "page_index")


@query(_LINES + "SELECT source, (row_number() OVER (PARTITION BY source ORDER BY t.doc_id, page_index) - 1)::INTEGER AS page_index, t.text FROM t JOIN documents d ON d.doc_id = t.doc_id")
def merge_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    made = from_rows(docs, lambda r: synth.text_pdf(r["text"]), ["doc_id", "source"])
    merged = engine.merge_parts(made, by=["source"], order="doc_id")
    return engine.text(merged, parts=True).select("source", "page_index", "text")


@query("""WITH s AS (SELECT c_nationkey, c_name, c_custkey::VARCHAR AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
SELECT c_nationkey, 'customer' || CASE WHEN i > 1 THEN '_' || i ELSE '' END || '.name' AS name, c_name AS value FROM s""")
def merge_forms(spark, sf_dir):
    made = from_rows(spread(table(spark, sf_dir, "customer")), synth.form_pdf, ["c_custkey", "c_nationkey"])
    merged = engine.merge_parts(made, by=["c_nationkey"], order="c_custkey")
    return engine.fields(merged, parts=True).where("name like 'customer%.name'").select("c_nationkey", "name", F.col("value")[0].alias("value"))


def _sealed(rows: DataFrame, key: str, name: str, method: str) -> DataFrame:
    """A document for each row with its user and owner passwords."""
    return from_rows(spread(rows.select(key, name)), lambda r: synth.encrypted(synth.text_builder(r[name]), method, f"user{r[key]}", "boss"), [key, name])


def _decrypt_query(name: str, method: str, kind: str, of: str, key: str, text: str) -> None:
    def run(spark, sf_dir):
        sealed = _sealed(table(spark, sf_dir, of), key, text, method).withColumn("pw", F.concat(F.lit("user"), F.col(key).cast("string")))
        done = engine.decrypt(sealed, password_col="pw")
        return engine.text(done.select(key, "content")).select(key, "text", F.lit(kind).alias("method"))

    run.__name__ = name
    query(f"SELECT {key}, {text} AS text, '{kind}' AS method FROM {of}")(run)


_decrypt_query("decrypt_rc4", "rc4", "RC4", "supplier", "s_suppkey", "s_name")
_decrypt_query("decrypt_aes128", "aes128", "AESV2", "supplier", "s_suppkey", "s_name")
# its password hash is slow by design: a small table
_decrypt_query("decrypt_aes256", "aes256", "AESV3", "region", "r_regionkey", "r_name")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'owner' END AS which, CASE WHEN s_suppkey % 3 < 2 THEN 'AESV2' END AS method FROM supplier")
def check_password(spark, sf_dir):
    pw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("user"), F.col("s_suppkey").cast("string"))).when(F.col("s_suppkey") % 3 == 1, "boss").otherwise("no")
    return engine.check_password(_sealed(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "aes128").withColumn("pw", pw), password_col="pw").select("s_suppkey", "which", "method")


@query("""WITH RECURSIVE r AS (SELECT DISTINCT user_id AS k, 1 AS num FROM events) SELECT k AS user_id, count(*)::BIGINT AS n FROM (SELECT k, unnest(range(1, 7)) AS num FROM r) GROUP BY k""")
def refs_reachable(spark, sf_dir):
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("values"))
    found = write_table(engine.objects(from_rows(dealt(docs), synth.updated_pdf, ["user_id"])).select("user_id", "num", "refs", "type"), "objects")
    roots = found.where("type = 'Catalog'").select("user_id", "num")
    return engine.reachable(found, roots, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, 1::BIGINT AS recompressed, greatest(1, floor(w * s + 0.5))::INTEGER AS width, greatest(1, floor(200 * s + 0.5))::INTEGER AS height
FROM (SELECT n_nationkey, w, least(1.0::DOUBLE, 300::DOUBLE / w, 150::DOUBLE / 200) AS s FROM (SELECT n_nationkey, 100 + n_nationkey * 20 AS w FROM nation))""")
def compress_images(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.lit(100) + F.col("n_nationkey") * 20).alias("w"))
    done = engine.rewrite(from_rows(spread(rows), synth.photo_pdf, ["n_nationkey"]), [engine.compress_images(max_width=300, max_height=150)])
    found = engine.images(done.select("n_nationkey", F.col("report")["images_recompressed"].alias("recompressed"), "content"))
    return found.select("n_nationkey", "recompressed", "width", "height")
