"""PDF text layers as blocks; needs pypdf, which may be absent."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "document_id string, page_number int, pos int, block_id string, block_type string, text string, y0 double, y1 double, reading_order int"
LEAST_CHARS = 20

try:
    import pypdf
except ImportError:
    pypdf = None


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """A block for each line of each page's text layer; a page with less than LEAST_CHARS of text has none and raises."""
    if pypdf is None:
        raise ImportError("reading PDF files needs pypdf")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for n, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1):
                    text = page.extract_text() or ""
                    if len(text) < LEAST_CHARS:
                        raise ValueError(f"{name}, page {n}: no text layer")
                    lines = text.split("\n")
                    rows += [(name, n, i, f"p{n}b{i}", "paragraph", t, i / len(lines), (i + 1) / len(lines), i) for i, t in enumerate(lines)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
