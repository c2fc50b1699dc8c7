"""The public face: one name for each operation on a DataFrame of documents (key columns and ``content``)."""

from __future__ import annotations

from quire.kernels.compress import compress_images
from quire.operators.rewrites import check_password, decrypt, merge, merge_parts, recompress_streams, remove_attachments, remove_javascript, remove_unused, repair, repair_streams, rewrite, rotate_pages, select_pages, strip_metadata
from quire.operators.tables import all_text, attachments, fields, images, info, links, objects, outline, pages, reachable, table, text, xref
from quire.sources.pdf import PdfDataSource, read_pdfs, stream_pdfs
from quire.streaming.ingest import stream_table

__all__ = [
    "PdfDataSource", "all_text", "attachments", "check_password", "compress_images", "decrypt", "fields", "images", "info", "links", "merge", "merge_parts", "objects", "outline", "pages", "reachable", "read_pdfs", "recompress_streams", "remove_attachments", "remove_javascript", "remove_unused", "repair", "repair_streams",
    "rewrite", "rotate_pages", "select_pages", "stream_pdfs", "stream_table", "strip_metadata", "table", "text", "xref",
]
