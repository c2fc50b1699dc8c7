"""The ten operators as queries over the driver's tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, html, langid, lm, minhash, ogg, packing, suffixes, tokens, toxicity
from quire.llm.common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_text(table(spark, sf_dir, "pages"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.media_column(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_minhash, op2_suffixes, op3_tokens, op4_packing, op5_decontamination, op6_html, op7_ogg, op8_language, op9_toxicity, op10_lm)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: Words of a text as the contracts define them, for DuckDB.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

OP1_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
prints AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS p FROM shingles GROUP BY 1),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY p) AS c FROM prints),
own AS (SELECT s.* FROM shingles s JOIN class ON s.doc_id = class.doc_id AND class.c = class.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, c, d.doc_id) AS component_id, d.doc_id = coalesce(m, c, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN class ON class.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = class.c
"""

OP2_SQL = """
WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
pos AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 99)) AS p FROM h WHERE length(x) >= 200),
strings AS (SELECT pos.doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS k FROM pos JOIN h ON h.doc_id = pos.doc_id),
later AS (SELECT doc_id, p FROM strings QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked),
spans AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY 1, 2),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT h.doc_id, coalesce(m, 0), length(x) // 2 FROM h LEFT JOIN (SELECT doc_id, max(b) AS m FROM spans GROUP BY 1) t ON t.doc_id = h.doc_id),
kept AS (SELECT gaps.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS y FROM gaps JOIN h ON h.doc_id = gaps.doc_id GROUP BY 1),
sums AS (SELECT doc_id, sum(b - a) AS r, count(*) AS n FROM spans GROUP BY 1)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM h JOIN kept ON kept.doc_id = h.doc_id LEFT JOIN sums ON sums.doc_id = h.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op2_suffixes": OP2_SQL}
