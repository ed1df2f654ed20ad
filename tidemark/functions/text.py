"""Text, URL, feed and identifier expressions."""
from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The five named entities every page uses, "&amp;" last so that it is not undone twice.
BASIC_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All named and numeric entities, per Arrow batch."""
    return text.map(lambda v: None if v is None else html.unescape(v))


def strip_html(raw: Column, cap: int | None = None, full_entities: bool = False) -> Column:
    """Tags to blanks, entities decoded, white space collapsed, trimmed, cut at ``cap``."""
    text = F.regexp_replace(raw, r"<[^>]+>", " ")
    if full_entities:
        text = unescape_html(text)
    else:
        for entity, char in BASIC_ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return text if cap is None else F.substring(text, 1, cap)


def symbol_from_url(url: Column) -> Column:
    found = F.upper(F.regexp_extract(url, r"(?i)[?&]s=([A-Z]{1,5})", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("macro"))


def tag_text(xml: Column, name: str) -> Column:
    """Trimmed content of the first ``<name>`` element, empty if absent."""
    return F.trim(F.regexp_extract(xml, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1))


def headline(title: Column, description: Column) -> Column:
    return F.btrim(F.concat(title, F.lit(". "), description), F.lit(". "))


def feed_document_id(feed: Column, link: Column, published: Column) -> Column:
    return F.sha1(F.concat_ws(":", feed, link, published))


def archive_url(company_id: Column, accession: Column, document: Column, base: str) -> Column:
    return F.concat(F.lit(base), company_id.cast("string"), F.lit("/"),
                    F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def padded_company_id(company_id: Column) -> Column:
    return F.lpad(company_id.cast("string"), 10, "0")


def is_commit_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{40}$"), F.lit(False))


def rss_source(symbol: Column) -> Column:
    return F.concat(F.lit("rss_"), F.lower(symbol))


def titleise(identifier: Column) -> Column:
    return F.initcap(F.replace(identifier, F.lit("_"), F.lit(" ")))


def config_hash(*cols: Column) -> Column:
    """Order-stable hash of a run configuration through canonical JSON."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
