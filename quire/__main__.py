"""Command line: tables and rewrites of files and folders.

    python -m quire info|pages|text|outline|links|fields|attachments|images|objects PATH [--json]
    python -m quire clean|rotate|select|repair|decrypt|compress PATH --out FOLDER [options]
    python -m quire merge PATH --out FOLDER
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

TABLES = ("info", "pages", "text", "outline", "links", "fields", "attachments", "images", "objects")
REWRITES = ("clean", "rotate", "select", "repair", "decrypt", "compress", "merge")


def parse_ranges(spec: str, count: int) -> list[int]:
    """``1-3,5,7-`` to page indices from 0; backwards ranges are refused."""
    out = []
    for part in spec.split(","):
        a, dash, b = (x.strip() for x in part.partition("-"))
        low = int(a) if a else 1
        high = int(b) if b else count if dash else low
        if not 1 <= low <= high <= count:
            raise ValueError(f"no such pages: {part.strip()}")
        out += range(low - 1, high)
    return out


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=(*TABLES, *REWRITES))
    p.add_argument("path")
    p.add_argument("--out")
    p.add_argument("--json", action="store_true", help="one JSON object a row")
    p.add_argument("--password", default=os.environ.get("PDF_PASSWORD"))
    p.add_argument("--pages", help="1-3,5,7-")
    p.add_argument("--degrees", type=int, default=90)
    p.add_argument("--keep", nargs="*", default=[], choices=("metadata", "javascript", "attachments"))
    p.add_argument("--max-size", type=int, default=1600)
    p.add_argument("--quality", type=float, default=0.75)
    a = p.parse_args(argv)
    if a.command in REWRITES and not a.out:
        p.error("--out is needed")
    return a


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("quire").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    from quire import engine
    from quire.sources.pdf import PdfDataSource

    docs = engine.read_pdfs(spark, a.path).select("path", "content")
    if a.command in TABLES:
        rows = engine.table(docs, a.command, password=a.password)
        if a.out:
            rows.write.mode("overwrite").parquet(a.out)
            return 0
        for r in rows.toJSON().toLocalIterator() if a.json else rows.toLocalIterator():
            print(r if a.json else "\t".join("" if v is None else str(v) for v in r))
        return 0
    if a.command == "merge":
        done = engine.merge(docs.withColumn("g", F.lit("merged.pdf")), by=["g"], order="path").select(F.col("g").alias("name"), "content", "error")
    elif a.command == "decrypt":
        done = engine.decrypt(docs, password=a.password or "")
    else:
        plugins = {
            "clean": [p for n, p in (("metadata", engine.strip_metadata()), ("javascript", engine.remove_javascript()), ("attachments", engine.remove_attachments())) if n not in a.keep],
            "rotate": [engine.rotate_pages(a.degrees)], "repair": [engine.repair_streams()], "compress": [engine.compress_images(max_width=a.max_size, max_height=a.max_size, quality=a.quality), engine.recompress_streams()],
        }
        if a.command == "select":
            spec = a.pages or "1-"

            def chosen(edit) -> None:
                engine.select_pages(parse_ranges(spec, len(edit.pages())))(edit)

            plugins["select"] = [chosen]
        done = engine.rewrite(docs, plugins[a.command])
    if "name" not in done.columns:
        done = done.withColumn("name", F.element_at(F.split("path", "/"), -1))
    bad = done.where("error is not null").select("name", "error").take(20)
    for r in bad:
        print(f"{r.name}: {r.error}", file=sys.stderr)
    spark.dataSource.register(PdfDataSource)
    done.where("content is not null").select("name", "content").write.format("pdf").mode("overwrite").save(a.out)
    return 3 if any("Password" in r.error for r in bad) else 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
