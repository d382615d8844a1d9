"""Quality rules: base limits and a decision list learned from labels, in DataFrame expressions only.

`learn` turns labelled documents into counts per cell of binned measures (one
aggregation), grows conjunctions of thresholds by FOIL gain on two thirds of
the sample, prunes them on the rest, and keeps those that are precise there.
The result is an ordered list, emitted as one Spark conditional expression.

The labels used are a bounded sample (`SAMPLE`, chosen by a hash of doc_id and label), so
the sample may be broadcast; the different texts that they label are bounded again, and cells are at most as many as these rows.

Defined results: a null text has no words and fails the base rule; a null
doc_id or label is not learned from; repeated rows (of documents or labels) are learned from once and judged each on its own;
an empty table gives an empty table, and without labels the learned list is
empty.  Other columns pass through `keep` untouched whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import BLANK_CHARS, let, total, without, words

#: Labelled rows that the list is learned from, at most (in expectation).
SAMPLE = 20_000
#: A rule must be so precise on the pruning sample, and hold for so many of its rows.
PRECISION, LEAST_ROWS = 0.95, 5
MOST_RULES, MOST_CONDITIONS = 8, 3
QUANTILES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.85, 0.9, 0.95, 0.98, 0.99, 0.995)

#: Fixed by the contract of the query.
SYMBOLS, LEAST_WORDS, WINDOW, REPEATED_PERCENT = "#*$%&|<>", 20, 8, 30

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("symbol_rate", "upper_rate", "mark_rate", "repeat_rate", "dup_line_rate", "distinct_rate", "word_length")


def _repeat_words(ws: Column) -> Column:
    """Words inside windows of 8 that are found twice or more, each word once."""

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - p), F.lit(WINDOW)).cast("long")))

    def repeated(hashes: Column) -> Column:
        def flagged(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
            return F.array_sort(F.array_compact(F.transform(s, lambda x, k: F.when(twin(x, k - 1) | twin(x, k + 1), x["p"]))))

        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(placed, flagged), covered)).otherwise(F.lit(0).cast("long"))

    def windows(keys: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(keys) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(keys, i, WINDOW)))

    keys = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) > WINDOW, let(let(keys, windows), repeated)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, the counts of the base rule and the measures of the learned rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*carried, text.alias("text"), words(text).alias("ws"))

    def lines(t: Column) -> Column:
        full = F.filter(F.split(t, "\n", -1), lambda x: without(x, BLANK_CHARS) != "")
        return let(full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))

    counted = split.select(
        *carried,
        F.size("ws").cast("long").alias("n_words"),
        F.length(without(F.col("text"), BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(without(F.col("text"), _UPPER))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(without(F.col("text"), "!?"))).cast("long").alias("n_marks"),
        F.size(F.array_distinct("ws")).alias("n_distinct"),
        lines(F.col("text")).alias("lines"),
        _repeat_words(F.col("ws")).alias("n_repeat_words"),
    )
    rate = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return counted.select(
        *carried,
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_upper", "word_chars").alias("upper_rate"),
        rate("n_marks", "n_words").alias("mark_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        (F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).cast("double").alias("dup_line_rate"),
        rate("n_distinct", "n_words").alias("distinct_rate"),
        rate("word_chars", "n_words").alias("word_length"),
    )


@dataclass(frozen=True)
class Condition:
    """measure >= limit, or measure < limit."""

    measure: str
    at_least: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.measure) >= self.limit if self.at_least else F.col(self.measure) < self.limit


Rule = tuple[Condition, ...]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Conjunctions that hold for documents labelled quality 0, in the order in which they were found."""
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").distinct()
    share = min(1.0, 0.95 * sample / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", "quality"), F.lit(1_000_000)) < int(share * 1_000_000))
    labelled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").distinct()
    # a doc_id may have any number of texts, so the rows are bounded, too
    n = labelled.count()
    if n > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", "quality", "text", F.lit(2)), F.lit(1_000_000)) < int(sample / n * 1_000_000))
    # each row is used several times below; the table is bounded by the sample
    held = measure(labelled, "doc_id", "quality").select("doc_id", "quality", *MEASURES).persist()
    try:
        limits = held.agg(*[F.percentile_approx(m, list(QUANTILES), 10_000).alias(m) for m in MEASURES]).first()
        cuts = {m: sorted(set(limits[m] or ())) for m in MEASURES}
        binned = [sum(((F.col(m) >= c).cast("int") for c in cuts[m]), F.lit(0)).alias(m) for m in MEASURES]
        prune = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prune")
        cells = held.groupBy(*binned, prune).agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")).collect()
    finally:
        held.unpersist()
    return cover([tuple(c) for c in cells], cuts)


def cover(cells: list[tuple], cuts: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over (bin of each measure..., prune, bad, good) counts."""
    k = len(MEASURES)
    grow = [c for c in cells if not c[k]]
    held = [c for c in cells if c[k]]
    tests = [(i, up, b) for i, m in enumerate(MEASURES) for b in range(1, len(cuts[m]) + 1) for up in (True, False)]
    fits = lambda c, rule: all((c[i] >= b) == up for i, up, b in rule)
    count = lambda rows: (sum(c[k + 1] for c in rows), sum(c[k + 2] for c in rows))
    found: list[Rule] = []
    while len(found) < MOST_RULES:
        rule, rows = [], grow
        p, n = count(rows)
        while p and n and len(rule) < MOST_CONDITIONS:
            base, best = log2(p / (p + n)), None
            sums: dict[tuple, list[int]] = {}
            for i in range(k):
                by_bin = [[0, 0] for _ in range(len(cuts[MEASURES[i]]) + 1)]
                for c in rows:
                    by_bin[c[i]][0] += c[k + 1]
                    by_bin[c[i]][1] += c[k + 2]
                low = [0, 0]
                for b in range(1, len(by_bin)):
                    low = [low[0] + by_bin[b - 1][0], low[1] + by_bin[b - 1][1]]
                    sums[i, False, b], sums[i, True, b] = low, [p - low[0], n - low[1]]
            for test in tests:
                q, m = sums[test]
                if q and (best is None or q * (log2(q / (q + m)) - base) > best[0]):
                    best = (q * (log2(q / (q + m)) - base), test)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            rows = [c for c in rows if fits(c, [best[1]])]
            p, n = count(rows)
        while rule:
            worth = []
            for size in range(1, len(rule) + 1):
                q, m = count([c for c in held if fits(c, rule[:size])])
                worth.append(((q - m) / (q + m) if q + m else -1.0, -size, q, m))
            _, size, q, m = max(worth)
            rule = rule[:-size]
            break
        if not rule or q + m < LEAST_ROWS or q < PRECISION * (q + m):
            break
        found.append(tuple(Condition(MEASURES[i], up, cuts[MEASURES[i]][b - 1]) for i, up, b in rule))
        grow = [c for c in grow if not fits(c, rule)]
        held = [c for c in held if not fits(c, rule)]
    return found


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column()
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, the learned rule that rejects the document (or null), and kept."""
    rules = learn(docs, labels)
    return measure(docs, "doc_id").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        verdict(rules).alias("rejected_by"),
        (~F.col("base_failed") & verdict(rules).isNull()).alias("kept"),
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that neither the base rule nor the learned list rejects."""
    rules = learn(docs, labels)
    packed = docs.select(F.struct("*").alias("whole"), F.col("text"))
    return measure(packed, "whole").filter(~F.col("base_failed") & verdict(rules).isNull()).select("whole.*")
