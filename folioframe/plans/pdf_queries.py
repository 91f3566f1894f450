"""Page scan and filters, by round trips over `documents`."""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources.pdf import filters, scan
from ..sources.pdf.writer import write

LINES_A_PAGE = 40


def written_pages(batches):
    """doc_id and the bytes of a file with a line of text per line of the document."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        out = []
        for text in texts:
            lines = [x for x in (text or "").split("\n") if x]
            pages = [lines[i : i + LINES_A_PAGE] for i in range(0, len(lines), LINES_A_PAGE)] or [[]]
            out.append(write([[("Helvetica", 10, 72, 760 - 14 * k, x) for k, x in enumerate(p)] for p in pages]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["path", "content"])


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", "text").mapInArrow(written_pages, "path long, content binary")


@query(
    f"with l as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') as a from documents) select doc_id, cast((i - 1) // {LINES_A_PAGE} + 1 as integer) as page, cast((i - 1) % {LINES_A_PAGE} as integer) as ord, a[i] as text, 760.0::double - 14 * ((i - 1) % {LINES_A_PAGE}) as y, 5.0::double * length(a[i]) as width from l, lateral (select unnest(range(1, len(a) + 1)) as i)"
)
def pdf_scan(spark, sf_dir):
    return scan.part(scan.scan(files(spark, sf_dir)), "blocks").select("doc_id", "page", "ord", "text", F.round("y", 6).alias("y"), F.round("width", 6).alias("width"))


def encoded_twice(batches):
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode()
            chain = {
                "flate": filters.decode(zlib.compress(raw), ["FlateDecode"]), "hex": filters.decode(raw.hex().encode() + b">", ["AHx"]),
                "a85": filters.decode(base64.a85encode(raw) + b"~>", ["ASCII85Decode"]), "both": filters.decode(zlib.compress(raw).hex().encode() + b">", ["ASCIIHexDecode", "FlateDecode"]),
                "runs": filters.decode(b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128)) + b"\x80", ["RL"]),
            }
            out.append([{"filter": k, "text": v.decode()} for k, v in chain.items()])
        kind = pa.list_(pa.struct([("filter", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "r"])


@query("select doc_id, f as filter, md5(coalesce(text, '')) as digest from documents, (values ('flate'), ('hex'), ('a85'), ('both'), ('runs')) as v(f)")
def filters_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text").mapInArrow(encoded_twice, "doc_id long, r array<struct<filter:string,text:string>>")
    return rows.select("doc_id", F.inline("r")).select("doc_id", "filter", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def pdf_markdown(spark, sf_dir):
    from . import layout

    return layout.to_markdown(scan.part(scan.scan(files(spark, sf_dir)), "blocks"))
