"""Statements with named parameters over tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Statement:
    """SQL text with `:name` parameters and `{table}` places for DataFrames.

    Values are bound by Spark, never put into the text, so quotes and other marks in them mean
    nothing.  A bound statement is another one; the first stays as it is and can be bound anew.
    """

    spark: SparkSession
    text: str
    tables: dict[str, DataFrame]
    values: dict[str, object] = field(default_factory=dict)

    def bind(self, **values: object) -> Statement:
        return replace(self, values=values)

    def rows(self) -> DataFrame:
        return self.spark.sql(self.text, args=self.values, **self.tables)

    def first(self) -> dict | None:
        """The first row, or None."""
        found = self.rows().head(1)
        return found[0].asDict() if found else None


def prepare(spark: SparkSession, text: str, **tables: DataFrame) -> Statement:
    return Statement(spark, text, tables)


def book_statement(books: DataFrame) -> Statement:
    """A book by its id or fingerprint."""
    return prepare(books.sparkSession, "SELECT * FROM {books} WHERE id = :wanted OR fingerprint = :wanted ORDER BY id LIMIT 1", books=books)


def translation_statement(translations: DataFrame) -> Statement:
    """A translation by its key."""
    return prepare(translations.sparkSession, "SELECT * FROM {translations} WHERE cache_key = :key", translations=translations)


def index_statement(translations: DataFrame) -> Statement:
    """A document's pages that are translated with some settings."""
    return prepare(translations.sparkSession, "SELECT DISTINCT document_id, page FROM {translations} WHERE document_id = :document AND endswith(cache_key, '::' || :suffix) AND page > 0", translations=translations)
