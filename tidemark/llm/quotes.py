"""Conversations without quotes, ordered by reply: quotation linking in DataFrame functions only.

Lines that begin with > are quoted; the number of marks is their level. Each run of lines of
one level is a passage. Its normalised hash is looked up among the hashes of what earlier
messages of the conversation said themselves: whole messages, and consecutive paragraphs and
lines, as many as the passage has.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import materialized

MARKS = r"^(?:[ \t]*>)+"
#: A line that announces the quote below it.
ANNOUNCES = r"^(On|Am|Le|El) .*(wrote|schrieb|a écrit|escribió) ?:[ \t]*$"
#: Turns that share a bucket when the latest original is looked up.
BUCKET = 64


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    """(level, body) of every line; level 0 is the message's own."""
    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">")))).alias("level"),
                        F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"^ ", "").alias("body"))

    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), parse)


def parsed(messages: DataFrame, text: str) -> DataFrame:
    """``messages`` with body (own text) and quotes: (level, passage) of every quoted run.

    An announcing line right above a deeper level is dropped, at any level; it ends a run. Own
    text keeps a paragraph break where a quote was removed. Messages without > pass unparsed.
    """
    lines = F.col("_lines")
    announces = lambda x, i: F.regexp_like(x["body"], F.lit(ANNOUNCES)) & (
        F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > x["level"])
    dropped = F.struct(F.lit(-1).alias("level"), F.lit("").alias("body"))
    heard = F.transform(lines, lambda x, i: F.when(announces(x, i), dropped).otherwise(x))

    def step(acc: Column, x: Column) -> Column:
        same = (F.size(acc) > 0) & (F.element_at(acc, -1)["level"] == x["level"])
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1))
        longer = F.struct(x["level"].alias("level"), F.concat_ws("\n", last["passage"], x["body"]).alias("passage"))
        fresh = F.struct(x["level"].alias("level"), x["body"].alias("passage"))
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(fresh)))

    kind = "array<struct<level: int, passage: string>>"
    said = F.col("_runs")
    runs = F.filter(said, lambda q: (q["level"] > 0) & (F.trim(q["passage"]) != ""))
    own = F.filter(said, lambda q: (q["level"] == 0) & (F.trim(q["passage"], F.lit(" \t\n")) != ""))
    own = F.transform(own, lambda q: F.trim(q["passage"], F.lit("\n")))
    quoting = F.contains(F.col(text), F.lit(">"))
    return messages.withColumn("_lines", F.when(quoting, _lines(F.col(text)))).withColumn(
        "_runs", F.aggregate(heard, F.array().cast(kind), step)).withColumns({
            "body": F.when(quoting, F.trim(F.array_join(own, "\n\n"), F.lit(" \t\n"))).otherwise(F.col(text)),
            "quotes": F.coalesce(F.when(quoting, runs), F.array().cast(kind))}).drop("_lines", "_runs")


def _hashes(text: Column, border: str) -> Column:
    """Hashes of the parts of ``text`` between ``border``, without blank ones."""
    parts = F.filter(F.transform(F.split(text, border), normalised), lambda u: u != "")
    return F.transform(parts, lambda u: F.xxhash64(u))


LINES, PARAGRAPHS = "\n", r"\n\s*\n"


def _stretches(hashes: Column, lengths: Column) -> Column:
    """Hash of every stretch of consecutive parts, for every length asked."""
    def of(k: Column) -> Column:
        starts = F.when(F.size(hashes) >= k, F.sequence(F.lit(1), F.size(hashes) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, k)))

    return F.flatten(F.transform(lengths, of))


def latest_original(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """For each (conv, hash, turn) of ``quoted`` the latest earlier turn that said it.

    Both sides are laid in buckets of turns: a conversation or passage with a third of all
    rows is spread over its buckets, whose latest turns are carried on from bucket to bucket.
    """
    keys = quoted.select("conv", "hash").distinct()
    said = said.join(keys, ["conv", "hash"], "left_semi")
    both = quoted.select("conv", "hash", "turn").distinct().withColumn("from", F.lit(None).cast("long")).unionByName(
        said.select("conv", "hash", "turn").distinct().withColumn("from", F.col("turn")))
    both = both.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    before = Window.partitionBy("conv", "hash", "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("from").over(before)).where(F.col("from").isNull())
    past = Window.partitionBy("conv", "hash").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = both.groupBy("conv", "hash", "bucket").agg(F.max("from").alias("m")).select(
        "conv", "hash", "bucket", F.max("m").over(past).alias("far"))
    return near.join(far, ["conv", "hash", "bucket"]).select(
        "conv", "hash", "turn", F.coalesce("near", "far").alias("origin")).where(F.col("origin").isNotNull())


def roots(replies: DataFrame) -> DataFrame:
    """(conv, turn, root) of (conv, turn, parent): pointers are doubled until they end.

    Parents are earlier turns, so log2(longest chain) rounds do; each is written, so a lost
    executor costs one round.
    """
    state = materialized(replies.select("conv", "turn", F.col("parent").alias("root")))
    while True:
        up = state.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("_up"))
        joined = state.join(up, (F.col("conv") == F.col("_c")) & (F.col("root") == F.col("_t")), "left")
        new = materialized(joined.select("conv", "turn", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_more")))
        if not new.where("_more").limit(1).count():
            return new.drop("_more")
        state = new.drop("_more")


def link_quotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Messages without their quotes, in reply order.

    Result: conv, turn, role, text (own words), n_quotes, n_linked, reply_to (turn of the
    latest message quoted at the lowest linked level; null: quotes nothing that was said),
    thread_turn (root of the reply chain), position in the conversation: threads by their
    roots, replies after what they answer. Null texts stay null and say nothing; rows with a null
    conversation or turn are kept unlinked; rows that share a turn are one message for links
    and are ordered by role and text.
    """
    rows = messages.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                           F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    found = parsed(rows, "text")
    known = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    passage = F.col("q.passage")
    quoted = found.where(known & (F.size("quotes") > 0)).select("conv", "turn", F.explode("quotes").alias("q")).select(
        "conv", "turn", F.col("q.level").alias("level"), F.xxhash64(normalised(passage)).alias("whole"),
        _hashes(passage, LINES).alias("_ls"), _hashes(passage, PARAGRAPHS).alias("_ps"))
    named = ["conv", "turn", "level", "whole", "by_line", "by_paragraph"]
    quoted = materialized(quoted.select("*", F.xxhash64("_ls").alias("by_line"), F.xxhash64("_ps").alias("by_paragraph")).groupBy(*named).agg(
        F.count(F.lit(1)).alias("times"), F.max(F.size("_ls")).alias("n_lines"), F.max(F.size("_ps")).alias("n_paragraphs")))
    # Originals are cut into stretches as long as the conversation's passages, no others.
    asked = quoted.groupBy("conv").agg(F.collect_set("n_lines").alias("_kl"), F.collect_set("n_paragraphs").alias("_kp"))
    body = F.col("body")
    saying = found.where(known & body.isNotNull()).select("conv", "turn", "body").join(asked, "conv").select(
        "conv", "turn", "_kl", "_kp", F.xxhash64(normalised(body)).alias("_w"), _hashes(body, LINES).alias("_ls"), _hashes(body, PARAGRAPHS).alias("_ps"))
    units = F.concat(F.array("_w"), F.col("_ls"), F.col("_ps"), _stretches(F.col("_ls"), F.col("_kl")), _stretches(F.col("_ps"), F.col("_kp")))
    said = saying.where(F.size("_ls") > 0).select("conv", "turn", F.explode(F.array_distinct(units)).alias("hash"))
    wanted = quoted.select(*named, "times", F.explode(F.array_distinct(F.array("whole", "by_line", "by_paragraph"))).alias("hash"))
    linked = wanted.join(latest_original(wanted, said), ["conv", "hash", "turn"], "left").groupBy(*named).agg(
        F.max("origin").alias("origin"), F.first("times").alias("times"))
    lowest = F.min(F.when(F.col("origin").isNotNull(), F.struct(F.col("level"), (-F.col("origin")).alias("o"))))
    counted = F.coalesce(F.sum(F.when(F.col("origin").isNotNull(), F.col("times"))), F.lit(0))
    per = linked.groupBy("conv", "turn").agg(counted.alias("n_linked"), lowest.alias("_l")).select(
        "conv", "turn", "n_linked", (-F.col("_l.o")).alias("parent"))
    per = materialized(per)
    tops = roots(per.where(F.col("parent").isNotNull()))
    out = found.join(per.join(tops, ["conv", "turn"], "left"), ["conv", "turn"], "left")
    out = out.select("conv", "turn", "role", F.col("body").alias("text"), F.size("quotes").cast("long").alias("n_quotes"),
                     F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("reply_to"),
                     F.coalesce("root", "turn").alias("thread_turn"))
    return _positions(out).select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role),
                                  F.col("text").alias(text), "n_quotes", "n_linked", "reply_to", "thread_turn", "position")


def _counted(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by (conv, thread bucket, thread, turn bucket), and their totals by thread bucket."""
    counts = out.groupBy("conv", "_tb", "thread_turn", "_b").count()
    return counts, counts.groupBy("conv", "_tb").agg(F.sum("count").alias("total"))


def _positions(out: DataFrame) -> DataFrame:
    """Place in the conversation, from 0: counted in buckets of threads and of turns, whose
    totals are carried over the thread buckets first, then within each of them."""
    out = out.withColumns({"_b": F.floor(F.col("turn") / BUCKET), "_tb": F.floor(F.col("thread_turn") / BUCKET)})
    keys = ["conv", "thread_turn", "_b"]
    counts, totals = _counted(out)

    def before(w: Window, n: str) -> Column:
        return F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    past = totals.select(F.col("conv").alias("_c"), F.col("_tb").alias("_t"), before(Window.partitionBy("conv").orderBy("_tb"), "total").alias("_past"))
    here = counts.withColumn("_here", before(Window.partitionBy("conv", "_tb").orderBy("thread_turn", "_b"), "count"))
    places = here.join(past, F.col("conv").eqNullSafe(F.col("_c")) & F.col("_tb").eqNullSafe(F.col("_t"))).select(
        *[F.col(k).alias(f"_{k}") for k in keys], (F.col("_past") + F.col("_here")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "role", "text")) - 1
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return out.withColumn("_n", within).join(places, same).withColumn("position", F.col("_n") + F.col("_before"))
