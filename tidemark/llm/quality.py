"""Quality rules with risk-controlled thresholds.

Every text gets a few measures. Labelled documents then select, per stratum, how far the
measures may go: the cutoffs are lowered step by step in an order fixed beforehand, as long as
an exact binomial test shows that all rules together reject at most a set share of good documents.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import betainc
from tidemark.llm.arrays import PrefixHash, Words, byte_set, byte_symbols, covered, mixed, per_row
from tidemark.llm.frames import map_texts, materialized

WINDOW = 8
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: The characters that count as symbols.
SYMBOLS = byte_set(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = ", ".join(f"{m} long" for m in MEASURES)


def _distinct_per_row(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=n)


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    words = Words(data, offsets, NOT_SPACE)
    chars = per_row(words.inside & ((data & 0xC0) != 0x80), offsets)
    hashes = PrefixHash(byte_symbols()[data])
    # Lines: cut at every newline and at the ends of texts.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_start = np.unique(line_start[line_start < len(data)])
    line_end = np.append(line_start[1:], len(data))
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.where((line_end > 0) & (data[line_end - 1] == 10), line_end - 1, line_end) if len(line_end) else line_end
    has_word = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_row, line_start, line_end = line_row[has_word], line_start[has_word], line_end[has_word]
    lines = np.bincount(line_row, minlength=n)
    dup = lines - _distinct_per_row(line_row, hashes.of(line_start, line_end), n)
    # Windows of words that occur twice or more in their text.
    repeat = np.zeros(n, np.int64)
    at = words.windows(WINDOW)
    if len(at):
        seq = PrefixHash(hashes.of(words.start, words.end))
        key = seq.of(at, at + WINDOW)
        key = mixed(key ^ mixed(words.row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeat = per_row(covered(at[twice], WINDOW, len(words.start)), words.first)
    return [words.count, chars, per_row(SYMBOLS[data], offsets), dup, repeat]


def measures(docs: DataFrame, keep: Sequence[str] = ("doc_id", "lang"), text: str = "text") -> DataFrame:
    """Word count, characters in words, symbols, repeated lines, words in repeated windows.

    Whole texts; null and empty texts have zeros everywhere. Line and window equality is
    decided by 64-bit hashes within one text. Rows are independent of each other, so
    repeated rows and ids stay as they are.
    """
    return map_texts(docs, keep, text, FIELDS, _measure)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Score of each rule in 1/GRID steps; a higher score is worse. Fixed before labels are seen.
GRID = 64


def rule_scores() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    share = {
        "symbols": 2 * F.col("n_symbols") / chars,
        "dup_lines": 8 * F.col("n_dup_lines") / words,
        "repeats": F.col("n_repeat_words") / words,
        "short": 20 / (20 + F.col("n_words")),
    }
    return {k: F.least(F.lit(GRID), F.floor(v * GRID)).cast("int") for k, v in share.items()}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact through the incomplete beta function."""
    return 1.0 if k >= n else betainc(n - k, k + 1, 1.0 - p)


def select_cutoff(good: np.ndarray, bad: np.ndarray, limit: float, level: float) -> int | None:
    """The cutoff of a rule: scores at or over it are rejected.

    good and bad count labelled documents by score. Among the cutoffs whose test at
    ``level`` shows a false rejection rate of at most ``limit``, the one that rejects most
    bad documents, then fewest good ones. None if no such cutoff rejects a bad document.
    """
    lost, caught, n = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1], int(good.sum())
    best = None
    for c in range(1, len(good)):
        if caught[c] and binomial_tail(int(lost[c]), n, limit) <= level:
            rank = (int(caught[c]), -int(lost[c]))
            if best is None or rank > best[0]:
                best = (rank, c)
    return best[1] if best else None


#: One in so many good labels only guides the order of the steps and is not tested with.
GUIDE = 16


def walk(bad: np.ndarray, n_bad: np.ndarray, guide: np.ndarray, n_guide: np.ndarray) -> list[tuple[int, int]]:
    """Steps (rule, cutoff), strictest set of cutoffs first: each lowers one rule's cutoff to the
    next score that catches another bad document, at the least cost in guiding documents for
    each; among equals, the first rule. bad and guide: rows of scores, n_bad and n_guide: how often.
    """
    steps = []
    while len(bad) and bad.max() > 0:
        options = []
        for r in range(bad.shape[1]):
            c = int(bad[:, r].max())
            if c > 0:
                options.append((n_guide[guide[:, r] >= c].sum() / n_bad[bad[:, r] >= c].sum(), r, c))
        _, r, c = min(options)
        steps.append((r, c))
        left, clear = bad[:, r] < c, guide[:, r] < c
        bad, n_bad, guide, n_guide = bad[left], n_bad[left], guide[clear], n_guide[clear]
    return steps


def along(steps: list[tuple[int, int]], scores: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Documents by place on the walk, as scores: the first step rejects the highest score,
    those that no step rejects have 0."""
    place = np.zeros(len(scores), np.int64)
    for k, (r, c) in enumerate(steps):
        place = np.where((place == 0) & (scores[:, r] >= c), len(steps) - k, place)
    out = np.zeros(len(steps) + 1, np.int64)
    np.add.at(out, place, times)
    return out


def shares(labels: Sequence[int], limit: float, risk: float) -> int:
    """Strata among which the risk is split: only those that their number of good labels lets
    pass a test at their share at all."""
    k = 1
    while sum((1 - limit) ** n <= risk / k for n in labels) > k:
        k += 1
    return k


def thresholds(labelled: DataFrame, stratum: str, label: str, rules: Mapping[str, Column], limit: float = 0.01,
               risk: float = 0.05) -> DataFrame:
    """One row per stratum and rule with a cutoff, from the labelled rows.

    With probability 1 - risk, in all strata at once, the rules together reject at most
    ``limit`` of a stratum's good documents. A stratum's cutoffs are nested steps whose order
    depends on its bad documents and on a sixteenth of its good ones (column ``_guide``); the other good ones test them in that order up to the first failure, so
    the steps need no correction, and the level is risk / ``shares``. Rows without a label or
    stratum value: no label is left out, no stratum is a stratum of its own. Strata with too few
    labels get no cutoff, hence reject nothing. Counts are aggregated by (stratum, scores) first: a
    task sees at most as many rows as the grid has points, however many labels there are.
    """
    names = list(rules)
    good, guide = F.col("_good"), F.col("_guide")
    scored = labelled.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), (F.col(label) > 0).alias("_good"), "_guide",
        *[v.alias(f"s{i}") for i, v in enumerate(rules.values())])
    at = [f"s{i}" for i in range(len(names))]
    counts = materialized(scored.groupBy("stratum", *at).agg(
        F.count_if(good & ~guide).alias("good"), F.count_if(good & guide).alias("guide"), F.count_if(~good).alias("bad")))
    tested = counts.groupBy("stratum").agg(F.sum("good").alias("n"))
    tested = tested.where(F.pow(F.lit(1 - limit), F.col("n")) <= risk)
    level = risk / shares([r.n for r in tested.select("n").collect()], limit, risk)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = pdf[at].to_numpy(np.int64)
        n = {k: pdf[k].to_numpy(np.int64) for k in ("good", "guide", "bad")}
        bad, guiding = n["bad"] > 0, n["guide"] > 0
        steps = walk(scores[bad], n["bad"][bad], scores[guiding], n["guide"][guiding])
        cut = select_cutoff(along(steps, scores, n["good"]), along(steps, scores, n["bad"]), limit, level)
        taken = dict(steps[:len(steps) - cut + 1]) if cut is not None else {}
        return pd.DataFrame([(pdf.stratum.iloc[0], names[r], c) for r, c in taken.items()], columns=["stratum", "rule", "cutoff"])

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, rule string, cutoff int")


def quality_rules(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang",
                  label: str = "quality", limit: float = 0.01, risk: float = 0.05) -> DataFrame:
    """Measures of every document and whether the rules keep it.

    Result: id, the measures, base_failed, failed_rules (array), kept. Base failures are
    never kept; otherwise a document goes if a measure reaches its stratum's cutoff. A
    document labelled several times counts once per label; unlabelled ones have no say.
    Null ids keep their rows and match no label. Empty tables give empty results.
    """
    found = materialized(measures(docs, list(dict.fromkeys([id, stratum])), text))
    return _judged(found, labels, id, stratum, label, limit, risk).select(
        id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")


def _judged(found: DataFrame, labels: DataFrame, id: str, stratum: str, label: str, limit: float, risk: float) -> DataFrame:
    """``found`` (written measures) with base_failed, failed_rules, kept."""
    rules = rule_scores()
    narrow = found.drop(*[c for c in found.columns if c not in (id, stratum, *MEASURES)])
    # The rules act on what passes the base: only that is counted for or against them.
    labelled = narrow.where(~base_failed()).join(
        labels.select(F.col(id).alias("_l"), F.col(label).alias("_label")), F.col(id) == F.col("_l")).withColumn(
        "_guide", F.pmod(F.xxhash64(id), F.lit(GUIDE)) == 0)
    table = thresholds(labelled, stratum, "_label", rules, limit, risk).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cuts"))
    out = found.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(
        materialized(table).withColumnRenamed("stratum", "_s"), "_s", "left")
    failed = F.filter(F.array(*[F.when(v >= F.col("_cuts")[k], F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    out = out.withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang",
              label: str = "quality", limit: float = 0.01, risk: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with their columns, whatever they are called.

    Measures and text stay in one row, so the texts are written once and never shuffled.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (id, text, stratum)}
    found = materialized(measures(docs.toDF(*names), names, at[text]))
    known = labels.select(F.col(id).alias(at[id]), F.col(label).alias("_quality"))
    kept = _judged(found, known, at[id], at[stratum], "_quality", limit, risk).where("kept")
    return kept.select(*names).toDF(*docs.columns)
