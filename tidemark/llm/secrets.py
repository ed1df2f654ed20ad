"""Secret scans behind a trigram inverted index, in DataFrame functions only.

From each rule's regex follows a Boolean query over trigrams that every match must contain.
The index lists, for each trigram that some query mentions, the texts that hold it;
intersecting the postings gives each rule's candidates, and only those are searched with the
regex. A rule without mandatory trigrams has no query and searches every text.
"""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import materialized


class Rule:
    """kind, regex (of the syntax that Python and Java share); a match counts if its group
    ``group`` has ``least`` characters."""

    def __init__(self, kind: str, pattern: str, group: int = 0, least: int = 0):
        self.kind, self.pattern, self.group, self.least = kind, pattern, group, least


#: Fixed values. The first three are the base kinds, in their listed order.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # The same matches as [0-9a-f]+ of 24 characters or more, without stopping at every short run.
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("bearer", r"(?i)bearer [A-Za-z0-9._~+/-]{20,}"),
]
BASE = ("assign", "access", "hex")

#: A query is None (everything), a trigram, or ("and" | "or", queries).
Query = None | str | tuple
MOST_STRINGS = 32


def _all(queries: Sequence[Query]) -> Query:
    found = list(dict.fromkeys(q for q in queries if q is not None))
    return None if not found else found[0] if len(found) == 1 else ("and", tuple(found))


def _any(queries: Sequence[Query]) -> Query:
    found = list(dict.fromkeys(queries))
    plain = [q for q in found if isinstance(q, str) or q and all(isinstance(x, str) for x in q[1]) and q[0] == "and"]
    found = [q for q in found if q not in plain or not any(trigrams(x) < trigrams(q) for x in plain)]  # the weaker one will do
    return None if not found or None in found else found[0] if len(found) == 1 else ("or", tuple(found))


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _analyse(nodes) -> tuple[set[str] | None, Query]:
    """(all strings it can match, if they are few; query that holds for every match)."""
    strings: set[str] | None = {""}
    queries: list[Query] = []
    run = {""}  # strings of the exact run that is still open
    for code, value in nodes:
        if code is op.LITERAL:
            exact, query = {chr(value).lower()}, None
        elif code is op.SUBPATTERN:
            exact, query = _analyse(value[3])
        elif code is op.BRANCH:
            parts = [_analyse(b) for b in value[1]]
            exact = set().union(*[p[0] for p in parts]) if all(p[0] is not None for p in parts) else None
            query = None if exact is not None else _any([_of_strings(p[0]) if p[0] is not None else p[1] for p in parts])
        elif code is op.MAX_REPEAT:
            low, high, body = value
            inner, query = _analyse(body)
            exact = inner | {""} if (low, high) == (0, 1) and inner is not None else None
            query = None if low == 0 else query if inner is None else _of_strings(inner)
        elif code is op.IN and all(k is op.LITERAL for k, _ in value):
            exact, query = {chr(v).lower() for _, v in value}, None
        else:
            exact, query = None, None
        grown = {a + b for a in run for b in exact} if exact is not None else None
        if grown is not None and len(grown) <= MOST_STRINGS:
            run = grown
            strings = {a + b for a in strings for b in exact} if strings is not None else None
            strings = strings if strings is not None and len(strings) <= MOST_STRINGS else None
            continue
        queries += [_of_strings(run), query if exact is None else _of_strings(exact)]
        run, strings = (exact if exact is not None and len(exact) <= MOST_STRINGS else {""}), None
    return strings, _all(queries + [_of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """The query of a regex, over lower-cased trigrams; None if it has no mandatory trigram."""
    return _analyse(parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def text_key(text: Column) -> Column:
    """Postings name texts, not rows: copies share theirs. A collision only adds a candidate."""
    return F.xxhash64(text)


def postings(texts: DataFrame, text: str, wanted: Sequence[str]) -> DataFrame:
    """The inverted index: (trigram, text key) for every wanted trigram that a text holds."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in wanted]))
    return texts.select(F.explode(found).alias("trigram"), text_key(F.col(text)).alias("key"))


def _holds(query: Query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    parts = [_holds(q, present) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(text key, kinds whose query its postings satisfy); a text has at most as many
    postings as there are wanted trigrams, so the groups are bounded."""
    present = index.groupBy("key").agg(F.collect_set("trigram").alias("_t"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("_t")), F.lit(k)) for k, q in queries.items()]))
    return present.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end, kind) in code points: the
    places follow from the lengths of the matches and of the gaps between them."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"),
                         F.split(text, rule.pattern, -1).alias("s"))
    kind = "struct<start: int, rank: int, end: int, kind: string>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["s"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(F.length(x["g"]) >= max(rule.least, 1), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(F.regexp_like(text, pattern), F.aggregate(parts, zero, step, lambda acc: acc["out"]))


def find_secrets(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
                 rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """The columns ``keep`` and ``spans``: (start, rank, end, kind), by start, then rule.

    A null text is empty. Overlapping spans of different kinds all stay; spans of one kind
    never overlap. Rows are judged one by one; repeated rows repeat. Postings are keyed by the
    text's hash, so null or repeated ids don't matter. The candidate table is written before
    the join: Spark knows its size and broadcasts it only if small.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")
    texts = docs.select(*[F.col(f"`{c}`") for c in keep], whole)
    indexed = {k: q for k, q in queries.items() if q is not None}
    if indexed:
        wanted = sorted(set().union(*map(trigrams, indexed.values())))
        index = postings(docs.select(whole), "_text", wanted)
        table = materialized(candidates(index, indexed)).withColumnRenamed("key", "_key")
        texts = texts.join(table, text_key(F.col("_text")) == F.col("_key"), "left")
    found = []
    for rank, rule in enumerate(rules):
        spans = _spans(F.col("_text"), rule, rank)
        found.append(F.when(F.array_contains("kinds", rule.kind), spans) if rule.kind in indexed else spans)
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    spans = F.array_sort(F.concat(*[F.coalesce(s, none) for s in found]))
    return texts.select(*[F.col(f"`{c}`") for c in keep], spans.alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mask."""
    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars",
                 rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """All documents, secrets masked in their texts; ``length``, if given, is brought up to date.

    A null text stays null.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = names[docs.columns.index(text)]
    found = find_secrets(plain, names, at, rules)
    found = found.withColumn(at, masked(F.col(at), F.col("spans")))
    if length is not None and length in docs.columns:
        n = names[docs.columns.index(length)]
        hit = F.size("spans") > 0
        found = found.withColumn(n, F.when(hit, F.length(at).cast(plain.schema[n].dataType)).otherwise(F.col(n)))
    return found.select(*names).toDF(*docs.columns)
