"""Lake, validation, feed, text and plain aggregate queries."""
from pyspark.sql import functions as F

from tidemark.functions import special, text
from tidemark.operators import features as feat
from tidemark.operators import labels as lab
from tidemark.operators import replay as rep
from tidemark.operators import timejoin as tj
from tidemark.operators import windows as win
from tidemark.plans.oracle_ctes import gated
from tidemark.plans.registry import query, r6
from tidemark.sources import checks, feeds
from tidemark.sources.lake import (Lake, adjusted_prices, discover_runs, keep_latest, month_predicate, return_series, scratch_dir,
                                   single_series, typed_and_stamped)


def r(x, alias, digits=6):
    return F.round(x, digits).alias(alias)


def stamp():
    return F.lit("2002-01-01").cast("timestamp")


def stamped(t):
    return typed_and_stamped(t.bars(), "ts", stamp())


def eod(t):
    """Adjusted bars: a split factor and dividend that follow from the bar's volume."""
    b = t.bars()
    split = F.when(F.floor("volume") % 97 == 0, 2.0).otherwise(1.0)
    div = F.when(F.floor("volume") % 41 == 0, 0.25).otherwise(0.0)
    return b.select("symbol", "ts", "open", "high", "low", "close", F.col("volume").cast("bigint").alias("volume"),
                    (F.col("open") / 2).alias("adjOpen"), (F.col("high") / 2).alias("adjHigh"), (F.col("low") / 2).alias("adjLow"),
                    (F.col("close") / 2).alias("adjClose"), (F.col("volume") * 2).cast("bigint").alias("adjVolume"),
                    div.alias("divCash"), split.alias("splitFactor"))


# --- lake -----------------------------------------------------------------------------------
@query("src_01_partitioned_scan", f"""
SELECT symbol, ts, {r6('"close"','"close"')}, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month FROM bars
WHERE ts BETWEEN TIMESTAMP '1997-03-10' AND TIMESTAMP '1998-02-15'""")
def _(t):
    lake = Lake(t.spark, scratch_dir(t.spark))
    lake.write_processed(stamped(t), "equity_bars_daily", ["year", "month"])
    out = lake.read("equity_bars_daily").where(month_predicate("1997-03-10", "1998-02-15"))
    return out.select("symbol", "ts", r("close", "close"), "year", "month")


@query("src_02_sql_over_lake", f"""
SELECT symbol, count(*) AS n_bars, {r6('avg("close")','mean_close')} FROM bars WHERE "close" > 102 GROUP BY symbol""")
def _(t):
    lake = Lake(t.spark, scratch_dir(t.spark))
    lake.write_processed(stamped(t), "equity_bars_daily", ["year", "month"])
    return lake.query("SELECT symbol, count(*) AS n_bars, round(avg(close), 6) AS mean_close FROM equity_bars_daily "
                      "WHERE close > ? GROUP BY symbol", ["equity_bars_daily"], args=[102.0])


@query("src_04_absent_dataset", """
SELECT * FROM (SELECT symbol, ts FROM bars UNION ALL SELECT symbol, ts FROM bars WHERE false)""")
def _(t):
    lake = Lake(t.spark, scratch_dir(t.spark))
    return t.bars().select("symbol", "ts").unionByName(lake.read("never_written", "symbol string, ts timestamp"))


@query("srt_01_total_order", f"""
SELECT symbol, CAST(day AS VARCHAR) AS day, {r6('"close"','"close"')}, row_number() OVER (ORDER BY day, symbol) - 1 AS position FROM (SELECT symbol, CAST(ts AS DATE) AS day, "close" FROM bars)""")
def _(t):
    """Dates tie over symbols and are broken by the next column."""
    lake = Lake(t.spark, scratch_dir(t.spark))
    rows = t.bars().select("symbol", F.to_date("ts").alias("day"), "close")
    lake.write_ordered(rows, "ordered", ["day"])
    return lake.read("ordered").select("symbol", F.col("day").cast("string").alias("day"), r("close", "close"), "position")


@query("src_09_return_series_zone", f"""
SELECT symbol, CAST(ts AS VARCHAR) AS ts, {r6('ret_1d','ret')} FROM px_ret WHERE ret_1d IS NOT NULL""")
def _(t):
    """Returns stored with offsets of a zone: read back, brought to UTC, the zone stripped."""
    lake = Lake(t.spark, scratch_dir(t.spark))
    ret = t.bars().select("symbol", "ts", win.pct_change("close", 1).alias("ret")).where("ret IS NOT NULL")
    local = F.date_format(F.from_utc_timestamp("ts", "America/New_York"), "yyyy-MM-dd'T'HH:mm:ss")
    hours = ((F.unix_seconds(F.from_utc_timestamp("ts", "America/New_York")) - F.unix_seconds("ts")) / 3600).cast("int")
    lake.write_processed(ret.select("symbol", F.concat(local, F.format_string("%+03d:00", hours)).alias("stamp"), "ret"), "oos_returns")
    return return_series(lake.read("oos_returns"), "stamp").select("symbol", F.col("ts").cast("string").alias("ts"), r("ret", "ret"))


@query("src_05_raw_landing", """
SELECT CAST(dt AS VARCHAR) AS dt, count(*) AS n_rows FROM (
  SELECT DATE '2002-01-01' AS dt FROM macro WHERE series_id <> 'DFF' UNION ALL SELECT DATE '2002-01-02' FROM macro) GROUP BY 1""")
def _(t):
    lake = Lake(t.spark, scratch_dir(t.spark))
    m = t.macro()
    for day, part in (("2002-01-01", m), ("2002-01-02", m), ("2002-01-01", m.where("series_id <> 'DFF'"))):
        lake.write_raw(part, "fred", "macro", day)
    raw = t.spark.read.parquet(lake.raw_path("fred", "macro"))
    return raw.groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n_rows"))


_REV = f"""
SELECT symbol, ts, CASE WHEN year(ts) = 1998 AND "close" > 103 THEN "close" + 1 ELSE "close" END AS "close" FROM bars"""


@query("set_02_partition_upsert", f"SELECT symbol, ts, {r6('\"close\"','\"close\"')} FROM ({_REV})")
def _(t):
    lake = Lake(t.spark, scratch_dir(t.spark))
    base = stamped(t)
    lake.write_processed(base, "bars", ["year", "month"])
    fixed = base.where("year = 1998 AND close > 103").withColumns({
        "close": F.col("close") + 1, "ingested_at": F.lit("2002-01-02").cast("timestamp")})
    lake.upsert(fixed, "bars", ["symbol", "ts"], "ingested_at", ["year", "month"], fixed_partitions=True)
    return lake.read("bars").select("symbol", "ts", r("close", "close"))


@query("set_02_flat_upsert", f"""SELECT series_id, "timestamp", {r6("CASE WHEN series_id = 'DFF' THEN value + 1 ELSE value END",'value')} FROM macro""")
def _(t):
    lake = Lake(t.spark, scratch_dir(t.spark))
    m = t.macro().withColumn("ingested_at", stamp())
    lake.upsert(m, "macro_fred", ["series_id", "timestamp"], "ingested_at")
    late = m.where("series_id = 'DFF'").withColumns({"value": F.col("value") + 1, "ingested_at": F.lit("2002-02-01").cast("timestamp")})
    lake.upsert(late, "macro_fred", ["series_id", "timestamp"], "ingested_at")
    return lake.read("macro_fred").select("series_id", "timestamp", r("value", "value"))


@query("agg_07_keep_last", f"""
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(t):
    o = t.raw("orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("v"), "o_orderkey", "o_orderstatus")
    return keep_latest(o, ["o_custkey"], "v").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("src_07_run_checkpoints", f"SELECT run, ts, {r6('ret','ret')} FROM rets WHERE run <> 'S3'")
def _(t):
    lake = Lake(t.spark, scratch_dir(t.spark))
    ret = t.returns()
    lake.write_processed(ret.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(8))), "run_returns", ["bucket"])
    meta = ret.select("run").distinct().withColumn("smoke", F.when(F.col("run") == "S3", True))
    saved = lake.read("run_returns")
    return saved.join(discover_runs(meta, saved), "run", "left_semi").select("run", "ts", r("ret", "ret"))


@query("src_10_adjusted_prices", f"""SELECT symbol, ts, {r6('"close" / 2','"close"')}, CAST(CAST(trunc(volume * 2) AS BIGINT) AS DOUBLE) AS volume FROM bars
WHERE symbol IN ('S0', 'S4', 'S7')""")
def _(t):
    return adjusted_prices(eod(t), ["S0", "S4", "S7", "NOPE"]).select("symbol", "ts", r("close", "close"), "volume")


@query("src_11_single_series", f"""SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, {r6('value','value')} FROM macro WHERE series_id = 'DGS10'""")
def _(t):
    out = single_series(t.macro(), "series_id", "DGS10", "timestamp", "value")
    return out.select(F.col("day").cast("string").alias("day"), r("value", "value"))


@query("src_12_benchmark_history", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {r6('"close"','"close"')} FROM bars WHERE symbol = 'S1'""")
def _(t):
    out = single_series(t.bars(), "symbol", "S1", "ts", "close")
    return out.select(F.col("day").cast("string").alias("day"), r("close", "close"))


@query("src_14_lake_inventory", """
SELECT 'raw' AS layer, true AS has_bytes, true AS whole_partitions, count(*) AS n_rows FROM bars
UNION ALL SELECT 'processed', true, true, count(*) FROM bars""")
def _(t):
    """Both layers of a landing, by what their file metadata says; files come in whole partitions."""
    lake = Lake(t.spark, scratch_dir(t.spark))
    bars = stamped(t)
    lake.write_raw(bars, "eod", "bars", "2024-01-31")
    lake.write_processed(bars, "bars", ["year", "month"])
    months = lake.read("bars").select("year", "month").distinct().count()
    layers = [lake.inventory("bars", layer="raw", source="eod").select(F.lit("raw").alias("layer"), "*"),
              lake.inventory("bars").select(F.lit("processed").alias("layer"), "*")]
    least = F.when(F.col("layer") == "raw", F.lit(1)).otherwise(F.lit(months))
    return layers[0].unionByName(layers[1]).select(
        "layer", (F.col("bytes") > 0).alias("has_bytes"), (F.col("n_files") >= least).alias("whole_partitions"), "n_rows")


_IDX = """SELECT p_partkey, i, replace('000' || p_partkey || '-' || i, ' ', '') AS accession, DATE '1996-01-01' + CAST((p_partkey * 7 + i * 40) % 1500 AS INTEGER) AS filed_at,
  CASE (p_partkey + i) % 3 WHEN 0 THEN '8-K' WHEN 1 THEN '10-Q' ELSE '10-K' END AS form, p_type || '.htm' AS document FROM part, range(3) t(i)"""


def filing_json(t):
    k = F.col("p_partkey")
    idx = F.array(*[F.lit(i) for i in range(3)])
    recent = F.struct(
        F.transform(idx, lambda i: F.concat(F.lit("000"), k.cast("string"), F.lit("-"), i.cast("string"))).alias("accessionNumber"),
        F.transform(idx, lambda i: F.date_add(F.lit("1996-01-01").cast("date"), ((k * 7 + i * 40) % 1500).cast("int")).cast("string")).alias("filingDate"),
        F.transform(idx, lambda i: F.when((k + i) % 3 == 0, "8-K").when((k + i) % 3 == 1, "10-Q").otherwise("10-K")).alias("form"),
        F.transform(idx, lambda i: F.concat("p_type", F.lit(".htm"))).alias("primaryDocument"))
    return t.raw("part").select("p_partkey", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body"))


@query("src_15_filing_index", f"SELECT p_partkey, accession, CAST(filed_at AS VARCHAR) AS filed_at, form, document FROM ({_IDX})")
def _(t):
    out = feeds.filing_rows(filing_json(t), "body", ["p_partkey"])
    return out.withColumn("filed_at", F.col("filed_at").cast("string"))


@query("prj_04_filing_filter", f"""SELECT p_partkey, accession, CAST(filed_at AS VARCHAR) AS filed_at, form FROM ({_IDX})
WHERE form IN ('8-K', '10-Q') AND filed_at BETWEEN DATE '1996-06-01' AND DATE '1998-06-30'""")
def _(t):
    rows = feeds.filing_rows(filing_json(t), "body", ["p_partkey"])
    return feeds.filing_filter(rows, ["8-K", "10-Q"], "1996-06-01", "1998-06-30").select(
        "p_partkey", "accession", F.col("filed_at").cast("string").alias("filed_at"), "form")


@query("str_06_archive_url", f"""SELECT p_partkey, accession, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS company,
  'https://archive.example/' || p_partkey || '/' || replace(accession, '-', '') || '/' || document AS url FROM ({_IDX})""")
def _(t):
    rows = feeds.filing_rows(filing_json(t), "body", ["p_partkey"])
    return rows.select("p_partkey", "accession", text.padded_company_id(F.col("p_partkey")).alias("company"),
                       text.archive_url(F.col("p_partkey"), F.col("accession"), F.col("document"), "https://archive.example/").alias("url"))


@query("src_16_feed_items", """
SELECT page_id, trim(regexp_extract(x, '(?s)<a[^>]*>(.*?)</a>', 1)) AS a FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS x FROM pages)""")
def _(t):
    return feeds.feed_items(t.raw("pages"), "html", ["page_id"], "li", ["a"]).select("page_id", "a")


# --- text -----------------------------------------------------------------------------------
_STRIP = """trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query("str_01_strip_html", f"SELECT page_id, {_STRIP} AS text FROM pages")
def _(t):
    return t.raw("pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("str_01_strip_html_all_entities")
def _(t):
    return t.raw("pages").select("page_id", text.strip_html(F.col("html"), full_entities=True).alias("text"))


@query("str_02_symbol_from_url", r"""
SELECT page_id, coalesce(nullif(upper(regexp_extract(u, '(?i)[?&]s=([A-Z]{1,5})', 1)), ''), 'macro') AS symbol FROM (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '&s=' || regexp_extract(url, '/([a-z]{2})/', 1) END AS u FROM pages)""")
def _(t):
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(
        F.concat("url", F.lit("&s="), F.regexp_extract("url", "/([a-z]{2})/", 1)))
    return t.raw("pages").select("page_id", text.symbol_from_url(u).alias("symbol"))


@query("str_04_headline", """
SELECT page_id, trim(title || '. ' || body, '. ') AS headline FROM (
  SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS body FROM pages)""")
def _(t):
    h = F.col("html")
    return t.raw("pages").select("page_id", text.headline(text.tag_text(h, "title"), text.tag_text(h, "h1")).alias("headline"))


@query("str_05_document_id", "SELECT page_id, sha1(url || ':' || page_id || ':' || length(html)) AS document_id FROM pages")
def _(t):
    return t.raw("pages").select("page_id", text.feed_document_id(
        F.col("url"), F.col("page_id").cast("string"), F.length("html").cast("string")).alias("document_id"))


@query("str_08_commit_id_test", """
SELECT page_id, regexp_full_match(CASE WHEN page_id % 3 = 0 THEN url ELSE sha1(url) END, '[0-9a-f]{40}') AS is_commit FROM pages""")
def _(t):
    v = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.sha1("url"))
    return t.raw("pages").select("page_id", text.is_commit_id(v).alias("is_commit"))


@query("str_09_source_labels", "SELECT doc_id, 'rss_' || lower(source) AS source_label, lang FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.rss_source(F.col("source")).alias("source_label"), "lang")


@query("prj_03_blank_text_dropped", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0")
def _(t):
    return feeds.blank_dropped(t.raw("documents")).select("doc_id")


@query("jsn_01_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("hsh_01_config_hash", """
SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS config_hash FROM orders""")
def _(t):
    return t.raw("orders").select("o_orderkey", text.config_hash(F.col("o_custkey"), F.col("o_orderpriority")).alias("config_hash"))


@query("mth_06_export_rounding", f"""
SELECT symbol, ts, CASE WHEN isfinite(x) THEN round_even(x, 6) + 0.0 END AS x FROM (SELECT symbol, ts, CASE WHEN high > low THEN ("close" - open) / (high - low) END AS x FROM bars)""")
def _(t):
    x = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("open")) / (F.col("high") - F.col("low"))).when(
        F.col("volume") > 40000, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return t.bars().select("symbol", "ts", special.tidy(x).alias("x"))


# --- checks ---------------------------------------------------------------------------------
def rules_sql(rows: str, rules: dict[str, str]) -> str:
    """Tall report of declared conditions over ``rows``; an unknown condition is a violation."""
    counted = ", ".join(f"count(*) FILTER (NOT coalesce({c}, false)) AS {n}" for n, c in rules.items())
    return f"SELECT n_rows, rule, n_violations FROM (SELECT count(*) AS n_rows, {counted} FROM ({rows})) UNPIVOT (n_violations FOR rule IN ({', '.join(rules)}))"


def given(*columns: str) -> dict[str, str]:
    return {f"{c}_present": f'"{c}" IS NOT NULL' for c in columns}


_CAL = {"year_range": "year BETWEEN 1900 AND 2099", "month_range": "month BETWEEN 1 AND 12"}
_DIRTY_BARS = """SELECT CASE WHEN k % 19 <> 0 THEN symbol END AS symbol, ts, CASE WHEN k % 11 = 0 THEN 0 ELSE open END AS open, high, CASE WHEN k % 13 <> 0 THEN low END AS low,
 CASE WHEN k % 23 = 0 THEN -"close" ELSE "close" END AS "close", CASE WHEN k % 17 = 0 THEN -volume ELSE volume END AS volume, ts AS ingested_at,
 year(ts) + CASE WHEN k % 29 = 0 THEN 200 ELSE 0 END AS year, month(ts) AS month FROM (SELECT *, CAST(floor(round(volume, 3)) AS BIGINT) AS k FROM bars)"""


def exact(t):
    """The tables with bar volumes in the thousandths their ticks have: a sum of doubles may end
    just below or above a whole number, depending on the order of its ticks."""
    return t.with_sources(bars=lambda _: t.bars().withColumn("volume", F.round("volume", 3)))


def every(n: int):
    """Rows whose whole volume is divisible by ``n``."""
    return F.floor("_v") % n == 0


@query("val_01_bar_checks", rules_sql(_DIRTY_BARS, {
    **given("symbol", "ts", "open", "high", "low", "close", "volume", "ingested_at"),
    **{f"{c}_positive": f'"{c}" > 0' for c in ("open", "high", "low", "close")}, "volume_not_negative": "volume >= 0", **_CAL}))
def _(t):
    """Bars with planted faults: gaps, zero and negative prices, negative volumes, years out of range."""
    b = stamped(exact(t)).withColumn("_v", F.col("volume"))
    dirty = b.withColumns({
        "symbol": F.when(~every(19), F.col("symbol")), "open": F.when(every(11), 0.0).otherwise(F.col("open")), "low": F.when(~every(13), F.col("low")),
        "close": F.when(every(23), -F.col("close")).otherwise(F.col("close")), "volume": F.when(every(17), -F.col("volume")).otherwise(F.col("volume")),
        "year": F.col("year") + F.when(every(29), 200).otherwise(0)})
    return checks.check(dirty, checks.rules("bars")).select("n_rows", "rule", "n_violations")


_DIRTY_EOD = """SELECT symbol, ts, open, high, low, CASE WHEN k % 37 <> 0 THEN "close" END AS "close", k AS volume, open / 2 AS adjOpen, high / 2 AS adjHigh, low / 2 AS adjLow, "close" / 2 AS adjClose,
 CASE WHEN k % 29 = 0 THEN NULL WHEN k % 7 = 0 THEN -k ELSE k END AS adjVolume, CASE WHEN k % 31 <> 0 THEN 0.25 END AS divCash, CASE WHEN k % 97 = 0 THEN 0 ELSE 1 END AS splitFactor,
 ts AS ingested_at, year(ts) AS year, month(ts) AS month FROM (SELECT *, CAST(floor(round(volume, 3)) AS BIGINT) AS k FROM bars)"""


@query("val_02_eod_checks", rules_sql(_DIRTY_EOD, {
    **given("symbol", "ts", "open", "high", "low", "close", "volume", "adjOpen", "adjHigh", "adjLow", "adjClose", "adjVolume", "divCash", "splitFactor", "ingested_at"),
    "volume_not_negative": "volume >= 0", "adjVolume_not_negative": "adjVolume >= 0", "splitFactor_positive": "splitFactor > 0", **_CAL}))
def _(t):
    """Adjusted bars with planted faults: gaps, negative volumes, split factors of zero."""
    e = typed_and_stamped(eod(exact(t)), "ts", stamp()).withColumn("_v", F.col("volume"))
    dirty = e.withColumns({
        "close": F.when(~every(37), F.col("close")),
        "adjVolume": F.when(every(29), None).when(every(7), -F.col("adjVolume")).otherwise(F.col("adjVolume")),
        "divCash": F.when(~every(31), F.col("divCash")), "splitFactor": F.when(every(97), 0.0).otherwise(F.col("splitFactor"))})
    return checks.check(dirty, checks.rules("eod"))


@query("val_03_macro_checks", """
SELECT rule, CASE rule WHEN 'value_present' THEN bad ELSE 0 END AS n_violations, n_rows FROM (
 SELECT count(*) AS n_rows, count(CASE WHEN value > 30 THEN 1 END) AS bad FROM macro),
 (SELECT unnest(['timestamp_present', 'value_present', 'series_id_present', 'ingested_at_present']) AS rule)""")
def _(t):
    m = t.macro().withColumns({"ingested_at": stamp(), "value": F.when(F.col("value") <= 30, F.col("value"))})
    return checks.check(m, checks.rules("macro"))


@query("val_04_document_checks", """
SELECT rule, CASE rule WHEN 'symbol_present' THEN bad ELSE 0 END AS n_violations, n_rows FROM (
 SELECT count(*) AS n_rows, count(CASE WHEN lang = 'de' THEN 1 END) AS bad FROM documents),
 (SELECT unnest(['document_id_present', 'source_present', 'symbol_present', 'published_at_present', 'ingested_at_present', 'text_present']) AS rule)""")
def _(t):
    d = t.raw("documents").select(F.col("doc_id").alias("document_id"), "source", F.when(F.col("lang") != "de", F.col("lang")).alias("symbol"),
                                  stamp().alias("published_at"), stamp().alias("ingested_at"), "text")
    return checks.check(d, checks.rules("documents"))


@query("val_05_scored_checks", """
SELECT rule, CASE rule WHEN 'sentiment_positive_unit' THEN bad ELSE 0 END AS n_violations, n_rows FROM (
 SELECT count(*) AS n_rows, count(CASE WHEN value / 200 > 1 THEN 1 END) AS bad FROM events),
 (SELECT unnest(['document_id_present','symbol_present','published_at_present','scored_at_present','model_name_present','model_version_present','sentiment_positive_present',
 'sentiment_negative_present','sentiment_neutral_present','sentiment_score_present','sentiment_positive_unit','sentiment_negative_unit','sentiment_neutral_unit','score_range']) AS rule)""")
def _(t):
    pos = F.col("value") / 200
    e = t.raw("events").select(
        F.col("event_id").alias("document_id"), F.lit("S0").alias("symbol"), F.col("ts").alias("published_at"), F.col("ts").alias("scored_at"),
        F.lit("lexicon").alias("model_name"), F.lit("1").alias("model_version"), pos.alias("sentiment_positive"),
        F.greatest(F.lit(0.0), 1 - pos).alias("sentiment_negative"), F.lit(0.0).alias("sentiment_neutral"),
        F.least(F.lit(1.0), pos).alias("sentiment_score"))
    return checks.check(e, checks.rules("scored"))


@query("val_06_bar_sanity", """
SELECT symbol, count(*) AS n_rows, count(CASE WHEN "close" <= 0 THEN 1 END) AS non_positive_close, count(CASE WHEN high < low THEN 1 END) AS high_below_low,
 count(CASE WHEN high < "close" THEN 1 END) AS high_below_close, count(CASE WHEN low > "close" THEN 1 END) AS low_above_close,
 count(CASE WHEN volume < 0 THEN 1 END) AS negative_volume, count(CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR "close" IS NULL THEN 1 END) AS missing
FROM (SELECT symbol, ts, open, CASE WHEN volume > 50000 THEN low - 1 ELSE high END AS high, low, "close", volume FROM bars) GROUP BY symbol""")
def _(t):
    dirty = t.bars().withColumn("high", F.when(F.col("volume") > 50000, F.col("low") - 1).otherwise(F.col("high")))
    return checks.bar_sanity(dirty)


@query("val_07_price_contract", """
SELECT symbol, count(*) AS n_rows, count(*) FILTER (c IS NULL) AS n_missing, count(*) FILTER (c = 0) AS n_zero,
 count(*) > 21 AND count(*) FILTER (c IS NULL) = 0 AND count(*) FILTER (c = 0) = 0 AS ok
FROM (SELECT symbol, CASE WHEN k % 1009 = 0 THEN NULL WHEN k % 1013 = 0 THEN 0 ELSE "close" END AS c FROM (SELECT *, CAST(floor(volume) AS BIGINT) AS k FROM bars)) GROUP BY symbol""")
def _(t):
    b = t.bars().withColumn("_v", F.col("volume"))
    return checks.price_contract(b.withColumn("close", F.when(every(1009), None).when(every(1013), 0.0).otherwise(F.col("close"))), 21)


@query("val_08_replay_contract", """
SELECT n_rows, rule, CASE rule WHEN 'signal_ternary' THEN bad ELSE 0 END AS n_violations FROM (
 SELECT count(*) AS n_rows, count(CASE WHEN CAST(floor(round(volume, 3)) AS BIGINT) % 4 = 3 THEN 1 END) AS bad FROM bars), (SELECT unnest(['open_present', 'volume_present', 'signal_ternary']) AS rule)""")
def _(t):
    return checks.replay_contract(exact(t).bars().withColumn("signal", (F.floor("volume") % 4 - 1).cast("int")))


@query("val_10_missing_rates", f"""
WITH w AS (SELECT symbol, {', '.join(f'avg(CAST({c} IS NULL AS DOUBLE)) AS {c}' for c in ('ret_21d', 'vol_63d', 'ret_252d', 'ma200_ratio'))} FROM px_feat GROUP BY 1)
SELECT symbol, feature, {r6('missing_rate','missing_rate')}, missing_rate > 0.05 AS flagged FROM w UNPIVOT (missing_rate FOR feature IN (ret_21d, vol_63d, ret_252d, ma200_ratio))""")
def _(t):
    out = checks.missing_rates(feat.price_features(t.bars()), ["ret_21d", "vol_63d", "ret_252d", "ma200_ratio"])
    return out.withColumn("missing_rate", F.round("missing_rate", 6))


@query("val_11_label_sanity", f"""
WITH l AS (SELECT 'directional_5d' AS label_id, CAST(lead("close", 5) OVER (PARTITION BY symbol ORDER BY ts) > "close" AS DOUBLE) AS y FROM bars
 UNION ALL SELECT 'realized_vol_21d', ln({gated('stddev_samp','ret_1d',21,'1 FOLLOWING','21 FOLLOWING')}) FROM px_ret)
SELECT label_id, count(*) AS n_rows, count(CASE WHEN y IS NULL THEN 1 END) AS n_missing, {r6('avg(y)','mean')}, {r6('stddev_samp(y)','std')}, {r6('min(y)','min')}, {r6('max(y)','max')},
 {r6('avg(CAST(y > 0 AS DOUBLE))','positive_share')}, avg(CAST(y > 0 AS DOUBLE)) BETWEEN 0.35 AND 0.65 AS balanced FROM l GROUP BY 1""")
def _(t):
    out = checks.label_sanity(lab.target_labels(t.bars(), ["directional_5d", "realized_vol_21d"]))
    return out.select("label_id", "n_rows", "n_missing", *[r(c, c) for c in ("mean", "std", "min", "max", "positive_share")], "balanced")


@query("val_13_parity_gate", """
WITH m AS (SELECT ts, ts < TIMESTAMP '1998-01-01' AS early, rsi_14 IS NOT NULL AND day(ts) = 1 AS moved FROM px_feat WHERE ts <= TIMESTAMP '2000-06-30')
SELECT 4 * count(*) AS n_cells, count(*) FILTER (moved) AS n_mismatches, count(*) FILTER (moved) = 0 AND count(*) >= 250 AND count(DISTINCT early) >= 2 AS passed,
 count(*) AS n_pairs, count(DISTINCT early) AS n_regimes FROM m""")
def _(t):
    """The as-of build against the batch build, with one column moved on the first of each month."""
    cols = ["ret_21d", "vol_63d", "ma200_ratio", "rsi_14"]
    batch = feat.price_features(t.bars()).withColumn("regime", F.when(F.col("ts") < "1998-01-01", "a").otherwise("b"))
    live = feat.build_features(t.bars(), start="1995-01-01", end="2001-12-31", asof="2000-06-30")
    live = live.withColumn("rsi_14", F.col("rsi_14") + F.when(F.dayofmonth("ts") == 1, 1.0).otherwise(0.0))
    out = checks.parity_gate(batch, live, ["symbol", "ts"], cols, regime="regime")
    return out.select("n_cells", "n_mismatches", "passed", "n_pairs", "n_regimes")


_CATALOG = """SELECT p_name || '_' || (p_size % 7) AS name, [p_name || '_' || ((p_size + 1) % 7), p_brand] AS depends_on, p_partkey, p_type AS family FROM part"""


def catalog(t):
    return t.raw("part").select(
        F.concat("p_name", F.lit("_"), F.col("p_size") % 7).alias("name"),
        F.array(F.concat("p_name", F.lit("_"), (F.col("p_size") + 1) % 7), F.col("p_brand")).alias("depends_on"),
        "p_partkey", F.col("p_type").alias("family"))


@query("val_14_catalog_drift", f"""
WITH c AS ({_CATALOG}), p AS (SELECT DISTINCT name FROM c WHERE p_partkey % 3 = 0), q AS (SELECT DISTINCT name FROM c WHERE p_partkey % 5 <> 0)
SELECT coalesce(p.name, q.name) AS name, CASE WHEN p.name IS NULL THEN 'registered_only' ELSE 'produced_only' END AS side FROM p FULL JOIN q ON p.name = q.name WHERE p.name IS NULL OR q.name IS NULL""")
def _(t):
    c = catalog(t)
    return checks.one_sided_names(c.where("p_partkey % 3 = 0"), c.where("p_partkey % 5 <> 0"))


@query("val_15_catalog_integrity", f"""
WITH c AS ({_CATALOG})
SELECT 'duplicate' AS issue, name, CAST(NULL AS VARCHAR) AS ref FROM c GROUP BY name HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'dangling', name, ref FROM (SELECT name, unnest(depends_on) AS ref FROM c) WHERE ref NOT IN (SELECT name FROM c)""")
def _(t):
    return checks.catalog_integrity(catalog(t))


_REG = """SELECT 'st' || s_suppkey AS id, ['f' || (s_suppkey % 40), 'f' || (s_nationkey + 20)] AS feature_set_ref, 't' || (s_suppkey % 5) AS target_ref,
 'm' || (s_nationkey % 4) AS model_ref, ['S' || s_suppkey, 'S' || (s_suppkey * 2)] AS universe, s_acctbal > 0 AS enabled, 'o' || (s_suppkey * 3) AS provenance FROM supplier"""


def strategies(t):
    k = F.col("s_suppkey")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return t.raw("supplier").select(
        c("st", k).alias("id"), F.array(c("f", k % 40), c("f", F.col("s_nationkey") + 20)).alias("feature_set_ref"),
        c("t", k % 5).alias("target_ref"), c("m", F.col("s_nationkey") % 4).alias("model_ref"),
        F.array(c("S", k), c("S", k * 2)).alias("universe"), (F.col("s_acctbal") > 0).alias("enabled"), c("o", k * 3).alias("provenance"))


@query("val_16_registry_drift", f"""
WITH r AS ({_REG}), f AS (SELECT DISTINCT 'f' || p_size AS ref FROM part), s AS (SELECT DISTINCT symbol AS ref FROM bars),
ok AS (SELECT DISTINCT 'o' || o_orderkey AS ref FROM orders WHERE o_orderstatus = 'F')
SELECT id, 'feature' AS kind, ref FROM (SELECT DISTINCT id, unnest(feature_set_ref) AS ref FROM r) WHERE ref NOT IN (SELECT ref FROM f)
UNION ALL SELECT id, 'target', target_ref FROM r WHERE target_ref NOT IN ('t0', 't1', 't2')
UNION ALL SELECT id, 'model', model_ref FROM r WHERE model_ref NOT IN ('m0', 'm1')
UNION ALL SELECT id, 'provenance', provenance FROM r WHERE enabled AND provenance NOT IN (SELECT ref FROM ok)
UNION ALL SELECT id, 'symbol', ref FROM (SELECT DISTINCT id, unnest(universe) AS ref FROM r) WHERE ref NOT IN (SELECT ref FROM s)""")
def _(t):
    features = t.raw("part").select(F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("name"))
    passed = t.raw("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return checks.registry_drift(strategies(t), features, t.bars().select("symbol"), ["t0", "t1", "t2"], ["m0", "m1"], passed)


@query("val_17_ledger_integrity", """
WITH o AS (SELECT o_orderpriority AS agent, o_custkey AS id, o_orderkey AS seq, o_orderdate AS started_at, o_orderdate - INTERVAL 1 DAY * (CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END) AS completed_at,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 13 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS sharpe FROM orders),
b AS (SELECT *, lag(started_at) OVER (PARTITION BY agent ORDER BY seq) AS p FROM o)
SELECT agent, CAST(count(CASE WHEN p > started_at THEN 1 END) AS BIGINT) AS out_of_order, count(*) FILTER (completed_at < started_at) AS ended_early,
 count(*) FILTER (NOT isfinite(sharpe)) AS non_finite, count(*) - count(DISTINCT id) AS duplicate_ids FROM b GROUP BY agent""")
def _(t):
    day = F.expr("INTERVAL 1 DAY")
    score = F.when(F.col("o_orderkey") % 11 == 0, float("inf")).when(F.col("o_orderkey") % 13 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    done = F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderdate") - day).otherwise(F.col("o_orderdate"))
    o = t.raw("orders").select(F.col("o_orderpriority").alias("agent"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
                               F.col("o_orderdate").alias("started_at"), done.alias("completed_at"), score.alias("sharpe"))
    return checks.ledger_integrity(o, "agent")


@query("val_20_fold_length_invariant", """
WITH h AS (SELECT * FROM (VALUES ('drawdown_21d', 21), ('directional_5d', 5)) t(label_id, h)),
n AS (SELECT symbol, count(*) AS k FROM bars GROUP BY 1)
SELECT symbol, label_id, CAST(h AS INTEGER) AS horizon_bars, k - h AS n_labelled, round((k - h) / k::DOUBLE, 6) AS complete_share, 63 > h + 3 AS fold_long_enough, 63 < 2 * (h + 3) AS fold_tight FROM n, h""")
def _(t):
    l = lab.target_labels(t.bars(), ["drawdown_21d", "directional_5d"])
    out = l.groupBy("symbol", "label_id", "horizon_bars").agg(F.count("y").alias("n_labelled"), (F.count("y") / F.count(F.lit(1))).alias("s"))
    need = F.col("horizon_bars") + 3
    return out.select("symbol", "label_id", "horizon_bars", "n_labelled", r("s", "complete_share"),
                      (F.lit(63) > need).alias("fold_long_enough"), (F.lit(63) < 2 * need).alias("fold_tight"))


# --- filters and aggregates -----------------------------------------------------------------
@query("prj_06_asof_truncation", f"""SELECT symbol, count(*) AS n_bars, max(ts) AS last_ts FROM bars WHERE ts <= TIMESTAMP '1998-12-31' GROUP BY 1""")
def _(t):
    return tj.pit_panel(t.bars(), "1998-12-31").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.max("ts").alias("last_ts"))


@query("prj_09_corporate_actions", """
SELECT symbol, ts, CASE WHEN v % 41 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS "divCash", CASE WHEN v % 97 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS "splitFactor"
FROM (SELECT symbol, ts, CAST(floor(volume) AS BIGINT) AS v FROM bars) WHERE v % 41 = 0 OR v % 97 = 0""")
def _(t):
    return eod(t).where("divCash > 0 OR splitFactor <> 1").select("symbol", "ts", "divCash", "splitFactor")


@query("prj_02_complete_rows", """
SELECT series_id, count(*) AS n_rows FROM macro WHERE value <= 30 GROUP BY 1""")
def _(t):
    m = t.macro().withColumn("value", F.when(F.col("value") <= 30, F.col("value")))
    return m.dropna(subset=["timestamp", "value"]).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("agg_03_high_water_per_series", """SELECT series_id, count(*) AS n_rows, min("timestamp") AS first_ts, max("timestamp") AS last_ts FROM macro GROUP BY 1""")
def _(t):
    return t.macro().groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("agg_01_high_water_mark", "SELECT max(ts) AS latest FROM bars")
def _(t):
    lake = Lake(t.spark, scratch_dir(t.spark))
    lake.write_processed(stamped(t), "bars", ["year", "month"])
    return lake.high_water("bars", "ts")


@query("agg_02_high_water_by_source_prefix", """
SELECT CASE WHEN event_type LIKE 'c%' THEN 'c' ELSE 'other' END AS feed, max(ts) AS latest FROM events GROUP BY 1""")
def _(t):
    return t.raw("events").groupBy(F.when(F.col("event_type").startswith("c"), "c").otherwise("other").alias("feed")).agg(F.max("ts").alias("latest"))


@query("agg_05_distinct_symbols", "SELECT DISTINCT symbol FROM bars")
def _(t):
    return t.raw("lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("symbol")).distinct()


@query("agg_06_pivot_series", f"""
SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, {', '.join(r6(f"max(CASE WHEN series_id = '{s}' THEN value END)", s) for s in ('DGS10', 'DFF', 'VIXCLS'))} FROM macro
WHERE series_id IN ('DGS10', 'DFF', 'VIXCLS') GROUP BY 1""")
def _(t):
    m = t.macro().where(F.col("series_id").isin(*feat.MACRO_SERIES))
    wide = m.groupBy(F.to_date("timestamp").cast("string").alias("day")).pivot("series_id", list(feat.MACRO_SERIES)).agg(F.max_by("value", "timestamp"))
    return wide.select("day", *[r(s, s) for s in feat.MACRO_SERIES])


@query("agg_13_documents_per_symbol", "SELECT symbol, count(*) AS n_docs FROM docs GROUP BY 1")
def _(t):
    return t.docs().groupBy("symbol").agg(F.count(F.lit(1)).alias("n_docs"))


@query("agg_14_label_shares", f"""
SELECT signal, count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()','share')} FROM (
 SELECT CAST(coalesce(sign(ret_1d), 0) AS INTEGER) AS signal FROM px_ret) GROUP BY 1""")
def _(t):
    from pyspark.sql import Window

    s = t.bars().select(rep.sign_signal(win.pct_change("close", 1)).alias("signal"))
    out = s.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("agg_15_flag_by_year", f"""
SELECT CAST(year(ts) AS INTEGER) AS year, {r6('avg(CAST(ma200_ratio > 1 AS DOUBLE))','uptrend_share')} FROM px_feat GROUP BY 1""")
def _(t):
    f = feat.price_features(t.bars())
    return f.groupBy(F.year("ts").alias("year")).agg(r(F.avg((F.col("ma200_ratio") > 1).cast("double")), "uptrend_share"))


@query("agg_16_monthly_returns", f"""
SELECT run, CAST(year(ts) AS INTEGER) AS year, {', '.join(r6(f"product(CASE WHEN month(ts) = {m} THEN 1 + ret END) - 1", f'm{m}') for m in range(1, 13))} FROM rets GROUP BY 1, 2""")
def _(t):
    w = t.returns().withColumns({"year": F.year("ts"), "m": F.month("ts")}).groupBy("run", "year").pivot("m", list(range(1, 13))).agg(F.product(1 + F.col("ret")) - 1)
    return w.select("run", "year", *[r(F.col(str(m)), f"m{m}") for m in range(1, 13)])


@query("agg_17_coverage_matrix", f"""
SELECT symbol, CAST(year(ts) AS INTEGER) AS year, {', '.join(f"CAST(max(CASE WHEN month(ts) = {m} THEN 1 ELSE 0 END) AS INTEGER) AS m{m}" for m in range(1, 13))} FROM bars GROUP BY 1, 2""")
def _(t):
    return t.bars().groupBy("symbol", F.year("ts").alias("year")).agg(
        *[F.max(F.when(F.month("ts") == m, 1).otherwise(0)).alias(f"m{m}") for m in range(1, 13)])


@query("agg_18_histogram", """
WITH e AS (SELECT min(ret) AS lo, max(ret) AS hi FROM rets)
SELECT CAST(least(floor((ret - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM rets, e GROUP BY 1""")
def _(t):
    from tidemark.operators.reports import histogram

    return histogram(t.returns(), [], "ret", 30).select("bin", "n")


@query("agg_19_describe", f"""
SELECT count(ret) AS n, {r6('avg(ret)','mean')}, {r6('stddev_samp(ret)','std')}, {r6('min(ret)','min')}, {r6('quantile_cont(ret, 0.25)','p25')}, {r6('quantile_cont(ret, 0.5)','p50')}, {r6('quantile_cont(ret, 0.75)','p75')}, {r6('max(ret)','max')}, run FROM rets GROUP BY run""")
def _(t):
    x = "ret"
    return t.returns().groupBy("run").agg(
        F.count(x).alias("n"), r(F.avg(x), "mean"), r(F.stddev_samp(x), "std"), r(F.min(x), "min"), r(F.percentile(x, 0.25), "p25"),
        r(F.percentile(x, 0.5), "p50"), r(F.percentile(x, 0.75), "p75"), r(F.max(x), "max"))


@query("agg_20_direction_confusion", """
SELECT CAST(sign(p) AS INTEGER) AS predicted, count(CASE WHEN sign(y) = -1 THEN 1 END) AS down, count(CASE WHEN sign(y) = 1 THEN 1 END) AS up FROM (
 SELECT ret_5d AS p, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_feat) WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def _(t):
    b = t.bars().withColumns({"p": win.pct_change("close", 5), "y": lab.forward_return(1)}).where("p IS NOT NULL AND y IS NOT NULL")
    s = F.signum("y")
    return b.groupBy(F.signum("p").cast("int").alias("predicted")).agg(F.count_if(s == -1).alias("down"), F.count_if(s == 1).alias("up"))


@query("agg_26_document_coverage", f"SELECT symbol, {r6('avg(CAST(has_coverage AS DOUBLE))','coverage')} FROM doc_feat GROUP BY 1")
def _(t):
    d = tj.document_windows(t.docs(), t.bars())
    return d.groupBy("symbol").agg(r(F.avg(F.col("has_coverage").cast("double")), "coverage"))


@query("agg_28_calibration_line", f"""
SELECT symbol, {r6('regr_slope(y, p)','slope')}, {r6('regr_intercept(y, p)','intercept')}, {r6('avg(CAST(sign(y) = sign(p) AS DOUBLE))','hit_rate')}, {r6('corr(y, p)','corr')} FROM (
 SELECT symbol, ret_5d AS p, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_feat) WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def _(t):
    b = t.bars().withColumns({"p": win.pct_change("close", 5), "y": lab.forward_return(1)}).where("p IS NOT NULL AND y IS NOT NULL")
    return b.groupBy("symbol").agg(r(F.regr_slope("y", "p"), "slope"), r(F.regr_intercept("y", "p"), "intercept"),
                                   r(F.avg((F.signum("y") == F.signum("p")).cast("double")), "hit_rate"), r(special.correlation(F.col("y"), F.col("p")), "corr"))


@query("agg_21_mean_absolute_contribution", f"""
WITH u AS (SELECT symbol, unnest(['ret_5d', 'ret_21d', 'vol_21d']) AS feature, unnest([ret_5d, ret_21d, vol_21d]) AS c FROM px_feat)
SELECT feature, {r6('m','importance')}, {r6('m / sum(m) OVER ()','share')} FROM (SELECT feature, avg(abs(c)) AS m FROM u GROUP BY 1)""")
def _(t):
    from tidemark.operators.reports import mean_absolute_contribution

    out = mean_absolute_contribution(feat.price_features(t.bars()), ["ret_5d", "ret_21d", "vol_21d"])
    return out.select("feature", r("importance", "importance"), r("share", "share"))


@query("srt_02_latest_value", f"""SELECT series_id, {r6('arg_max(value, "timestamp")','latest')} FROM macro GROUP BY 1""")
def _(t):
    return t.macro().groupBy("series_id").agg(r(F.max_by("value", "timestamp"), "latest"))


@query("srt_09_strongest_prediction_by_class", f"""
SELECT symbol, CASE WHEN p > 0 AND y > 0 THEN 'correct_long' WHEN p < 0 AND y < 0 THEN 'correct_short' ELSE 'wrong' END AS outcome, arg_max(ts, abs(p)) AS ts, {r6('max(abs(p))','strength')} FROM (
 SELECT symbol, ts, ret_5d AS p, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_feat) WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""")
def _(t):
    b = t.bars().withColumns({"p": win.pct_change("close", 5), "y": lab.forward_return(1)}).where("p IS NOT NULL AND y IS NOT NULL")
    outcome = F.when((F.col("p") > 0) & (F.col("y") > 0), "correct_long").when((F.col("p") < 0) & (F.col("y") < 0), "correct_short").otherwise("wrong")
    return b.groupBy("symbol", outcome.alias("outcome")).agg(F.max_by("ts", F.abs("p")).alias("ts"), r(F.max(F.abs("p")), "strength"))
