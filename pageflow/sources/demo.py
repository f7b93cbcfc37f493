"""Two pages to try the operators on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import BLOCKS

_PAGES = [
    ("demo", 1, [("heading", "Contents"), ("paragraph", "The first page ends with an unfinished sentence that goes on")]),
    ("demo", 2, [("paragraph", "unfinished sentence that goes on to the second page."), ("page_number", "2")]),
]


def demo_pages(spark: SparkSession) -> DataFrame:
    rows = [(d, p, [(kind, text, "", "", "left", 0, "none", "md") for kind, text in blocks]) for d, p, blocks in _PAGES]
    return spark.createDataFrame(rows, f"document_id string, page int, blocks {BLOCKS}")
