"""Filing indexes (JSON) and feed documents (XML) as rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tag_text

FILING_INDEX = ("struct<filings:struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,"
                "form:array<string>,primaryDocument:array<string>>>>")


def filing_rows(df: DataFrame, json_col: str, keep: Sequence[str]) -> DataFrame:
    """Parallel arrays of an index document to one row per filing."""
    recent = F.col("_j.filings.recent")
    parsed = df.withColumn("_j", F.from_json(json_col, FILING_INDEX)).select(*keep, F.explode(F.arrays_zip(
        recent["accessionNumber"].alias("accession"), recent["filingDate"].alias("filed_at"),
        recent["form"].alias("form"), recent["primaryDocument"].alias("document"))).alias("_f"))
    return parsed.select(*keep, "_f.accession", F.to_date("_f.filed_at").alias("filed_at"), "_f.form", "_f.document")


def filing_filter(filings: DataFrame, forms: Sequence[str], start: str, end: str) -> DataFrame:
    return filings.where(F.col("form").isin(*forms) & F.col("filed_at").between(F.lit(start), F.lit(end)))


def feed_items(df: DataFrame, xml: str, keep: Sequence[str], item: str = "item",
               fields: Sequence[str] = ("title", "description", "link", "pubDate")) -> DataFrame:
    """One row per ``<item>`` element with its fields as trimmed text."""
    items = F.regexp_extract_all(F.col(xml), F.lit(rf"(?s)<{item}>(.*?)</{item}>"), F.lit(1))
    rows = df.select(*keep, F.posexplode(items).alias("item_no", "_x"))
    return rows.select(*keep, "item_no", *[tag_text(F.col("_x"), f).alias(f) for f in fields])


def blank_dropped(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.length(F.trim(text)) > 0)
