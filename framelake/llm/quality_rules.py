"""Quality rules: measures of each text, and verdicts on whole hosts with shrunken failure rates.

A text fails on its own measures. Failures are then counted by host; a host's rate is shrunk
towards the rate of all hosts with a beta prior whose two parameters come from the hosts themselves
(method of moments), so that a host with few documents is not judged by one bad page. A host whose
shrunken rate for any rule passes the limit loses all its documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.runtime import fresh, join_lookup, small_batches, staged

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = {"too_short": "n_words < 50", "repetitive": "100 * n_repeat_words > 50 * n_words"}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pair = a[:-2] * len(ids) + a[1:-1]  # exact while a text has under 2**21 words; then ranks keep it so
    if len(ids) >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair * len(ids) + a[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order][1:] == triple[order][:-1]
    twice = np.zeros(len(triple), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    within = np.zeros(len(a), bool)
    for shift in range(3):
        within[shift : shift + len(twice)] |= twice
    return int(within.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The measures of one text: words, their code points, symbols, repeated lines, words in repeats."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at \x20 and \x09-\x0D only
    blank = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS[1:-1]))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeated_words(words)


def measured(text: Column) -> Column:
    """Struct column of the measures of a text."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES)).astype("int64")

    return measures(text)


def with_measures(df: DataFrame, text: str = "text", name: str = "q") -> DataFrame:
    """Add a struct column ``name`` with the measures and one boolean per rule (and ``base_failed``)."""
    small_batches(df.sparkSession)
    out = df.withColumn(name, measured(F.col(text)))
    rules = {n: F.expr(re.sub(r"\bn_\w+", lambda m: f"`{name}`.{m[0]}", e)) for n, e in RULES.items()}
    failed = F.lit(False)
    for c in rules.values():
        failed = failed | c
    return out.withColumn(name, F.struct(F.col(f"`{name}`.*"), *[c.alias(n) for n, c in rules.items()], failed.alias("base_failed")))


def host_verdicts(failures: DataFrame, host: str, rules: list[str], limit: float = 0.5, prior_hosts: int = 2) -> DataFrame:
    """``(host, documents, host_failed, rate_<rule>...)`` from rows of a host and one boolean per rule.

    The prior of each rule: over hosts weighted by their documents, mean m and variance v of the
    rates less what chance alone would give; its weight is ``m * (1 - m) / v - 1``, between 1 and
    10 000. With fewer than ``prior_hosts`` hosts or without spread the weight is the largest, so
    every host has the common rate. Null hosts form one host of their own.
    """
    counts = staged(failures.groupBy(host).agg(F.count("*").alias("documents"), *[F.sum(F.col(r).cast("long")).alias(f"k_{r}") for r in rules]))
    total = counts.agg(
        F.sum("documents").alias("n"),
        F.count("*").alias("hosts"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in rules],
        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("documents")).alias(f"s_{r}") for r in rules],
    ).first()
    prior = {}
    for r in rules:
        n = total["n"] or 0
        m = (total[f"k_{r}"] or 0) / n if n else 0.0
        between = (total[f"s_{r}"] or 0) / n - m * m - m * (1 - m) * (total["hosts"] - 1) / n if n else 0.0
        weight = min(1e4, max(1.0, m * (1 - m) / between - 1)) if between > 1e-12 and total["hosts"] >= prior_hosts else 1e4
        prior[r] = (m * weight, weight)
    rates = {f"rate_{r}": (F.col(f"k_{r}") + F.lit(prior[r][0])) / (F.col("documents") + F.lit(prior[r][1])) for r in rules}
    out = counts.withColumns(rates)
    return out.select(host, "documents", F.greatest(*[F.col(f"rate_{r}") for r in rules], F.lit(0.0)).__gt__(limit).alias("host_failed"), *rates)


def judge(df: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5, keep: list[str] | None = None, names: tuple[str, str] = ("q", "kept")) -> DataFrame:
    """Rows of ``df`` (or only the columns ``keep``) with ``q`` (measures and failed rules) and ``kept``.

    A null or empty text has no words and fails as too short. Texts are measured whole and once: the
    measured rows are staged. Rows with equal ids or texts are judged each on its own. The host of a
    third of all documents costs no more than others: counts are combined before the shuffle and
    verdicts come back by a size-checked lookup. An empty table gives an empty one. Columns with one
    of the two ``names`` are replaced; other columns may have any names.
    """
    q, kept = names
    work = df.drop(q, kept)
    if keep is not None:
        work = work.select(text, host, *[c for c in keep if c not in (text, host)])
    place, failed = fresh(work.withColumns({q: F.lit(0), kept: F.lit(0)}), "host", "host_failed")
    rows = with_measures(work, text, q).withColumn(place, F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")))
    rows = staged(rows if keep is None else rows.drop(*({text, host} - set(keep))))
    rules = list(RULES)
    hosts = host_verdicts(rows.select(place, *[F.col(f"`{q}`.{r}").alias(r) for r in rules]), place, rules, limit)
    bad = staged(hosts.where("host_failed").select(place, F.col("host_failed").alias(failed)))
    out = join_lookup(rows, bad, [place])
    return out.withColumn(kept, ~F.col(f"`{q}`.base_failed") & ~F.coalesce(failed, F.lit(False))).drop(place, failed)
