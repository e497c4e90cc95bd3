r"""Quality rules: a learned decision list over counted statistics of each text.

``measure`` counts, with SQL functions alone, the words, their characters, symbols,
lines that repeat an earlier line, words in repeated 5-word windows, and words equal
to the one before.  ``learn``
turns labelled statistics into an ordered list of threshold conjunctions by
sequential covering: a rule grows, one condition at a time, on two thirds of the
labelled documents not yet covered; its last conditions are pruned away as the other
third advises; it is kept if it is precise and common enough there.  Each step is
one aggregation of all labelled rows to counts by (statistic, bin), so the driver
sees some hundred numbers whatever the corpus.  ``verdict`` is the list as one
nested SQL conditional.

Defined cases: null and empty texts have all counts 0 and fail the base rule; texts
without labels, an empty label table or labels of one kind give an empty list, which
keeps all; null labels are not used, nor are rows without ``doc_id``, which are judged
like others; repeated rows count each; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, SPACE_CLASS, let, saved, text_of, unused, words_of, written

WINDOW = 5
SYMBOLS = "[#*$%&|<>]+"
#: Thresholds tried: midpoints between this many quantiles of a statistic.
QUANTILES = 50
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must reject bad documents at this rate, and cover this many, on the pruning third.
PRECISION = 0.9
SUPPORT = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echo_words")


def statistics(count=F.col) -> dict[str, Column]:
    """The statistics that rules may test; ``count`` gives the column of a count's name."""
    words = F.greatest(count("n_words"), F.lit(1))
    return {
        "n_words": count("n_words").cast("double"),
        "mean_word_chars": count("word_chars") / words,
        "symbols_per_word": count("n_symbols") / words,
        "dup_lines_per_word": count("n_dup_lines") / words,
        "repeat_words_per_word": count("n_repeat_words") / words,
        "echo_words_per_word": count("n_echo_words") / words,
    }


def repetition(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows found twice or more in the text, and words equal to the one before."""

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda x, other: F.coalesce(other["key"] == x["key"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            places = F.sort_array(F.transform(twice, lambda x: x["at"]))

            def total(at: Column) -> Column:
                reach = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(at, i + 1) - p), F.lit(WINDOW)))
                return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

            return let(places, total)

        keyed = F.transform(windows, lambda x, i: F.struct(x.alias("key"), i.alias("at")))
        none = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(none, F.lit(0)).otherwise(let(F.sort_array(keyed), of_sorted))

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        repeated = F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(windows, covered))
        echo = F.size(F.filter(h, lambda x, i: F.coalesce(F.get(h, i - 1) == x, F.lit(False))))
        return F.struct(repeated.alias("rep"), echo.alias("echo"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def counts_of(text: Column) -> Column:
    """Struct of the counts of a text."""

    def all_counts(own: Column) -> Column:
        lines = F.filter(F.split(own, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
        words = let(words_of(own), lambda w: F.struct(F.size(w).alias("n"), repetition(w).alias("again")))
        return let(
            words,
            lambda w: F.struct(
                w["n"].cast("long").alias("n_words"),
                F.length(F.regexp_replace(own, f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
                (F.length(own) - F.length(F.regexp_replace(own, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                w["again"]["rep"].cast("long").alias("n_repeat_words"),
                w["again"]["echo"].cast("long").alias("n_echo_words"),
            ),
        )

    return let(text, all_counts)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document."""
    return docs.select("doc_id", counts_of(text_of()).alias("counts")).select("doc_id", "counts.*")


def base_failed(count=F.col) -> Column:
    """The fixed rule: too short, or too repetitive."""
    return (count("n_words") < 10) | (100 * count("n_repeat_words") > 20 * count("n_words"))


@dataclass(frozen=True)
class Condition:
    """``statistic > threshold``, or ``<=`` where not above; holds for bins from (or below) ``bin``."""

    statistic: str
    above: bool
    threshold: float
    nth: int
    bin: int

    def on_bins(self) -> Column:
        own = F.col("bins")[self.nth]
        return own >= self.bin if self.above else own < self.bin

    def on_counts(self, count=F.col) -> Column:
        own = statistics(count)[self.statistic]
        return own > self.threshold if self.above else own <= self.threshold


def all_of(conditions, test) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & test(x)
    return out


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """Midpoints between neighbouring quantiles of each statistic."""
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = labelled.agg(*(F.percentile_approx(v, at, 10_000).alias(k) for k, v in statistics().items())).first()
    out = {}
    for k in statistics():
        values = sorted(set(row[k] or []))
        out[k] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return out


def bin_of(value: Column, cuts: list[float]) -> Column:
    """Number of the cuts that lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < value))


def step(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition | None, float]:
    """The condition of the greatest gain over the rows, and that gain.

    Gain is FOIL's: the bad rows covered, times the bits by which the rule's rate of
    bad rows rises.  Of equal gains the stricter threshold wins, so that rules stay
    clear of good documents.
    """
    counts = rows.select("bad", F.posexplode("bins").alias("nth", "bin")).groupBy("nth", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")
    )
    table = {(r["nth"], r["bin"]): (r["n"], r["bad"]) for r in counts.collect()}  # statistics x bins rows at most
    best, most = None, (0.0, 0.0, "")
    for nth, (name, values) in enumerate(cuts.items()):
        own = [table.get((nth, b), (0, 0)) for b in range(len(values) + 1)]
        n_all, bad_all = (sum(x[i] for x in own) for i in (0, 1))
        if not bad_all or bad_all == n_all:
            return None, 0.0
        n = bad = 0
        for b, value in enumerate(values, 1):
            n, bad = n + own[b - 1][0], bad + own[b - 1][1]
            for above, covered, hit in ((True, n_all - n, bad_all - bad), (False, n, bad)):
                if not hit:
                    continue
                gain = hit * (log2(hit / covered) - log2(bad_all / n_all))
                strict = value if above else -value
                if (gain, strict) > most[:2] and gain > 0:
                    best, most = Condition(name, above, value, nth, b), (gain, strict, name)
    return best, most[0]


def learn(counts: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules that reject, in order, from the counts of documents and ``labels(doc_id, quality)``."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id"), F.col("quality"))
    labelled = counts.where(~base_failed()).join(known, "doc_id").select(*COUNTS, "quality", "doc_id")
    labelled = saved(labelled)
    cuts = thresholds(labelled)
    bins = F.array(*(bin_of(statistics()[k], v) for k, v in cuts.items()))
    prune = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    left = saved(labelled.select((F.col("quality") == 0).cast("long").alias("bad"), bins.alias("bins"), prune.alias("prune")))
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            grow = left.where(~F.col("prune") & all_of(rule, Condition.on_bins))
            found, _ = step(grow, cuts)
            if found is None:
                break
            rule.append(found)
        if not rule:
            break
        ends = [all_of(rule[: k + 1], Condition.on_bins) for k in range(len(rule))]
        sums = left.where("prune").agg(
            *(F.count_if(c).alias(f"n{k}") for k, c in enumerate(ends)),
            *(F.coalesce(F.sum(F.when(c, F.col("bad"))), F.lit(0)).alias(f"bad{k}") for k, c in enumerate(ends)),
        ).first()
        worth = [((2 * sums[f"bad{k}"] - sums[f"n{k}"]) / max(1, sums[f"n{k}"]), -k) for k in range(len(rule))]
        k = -max(worth)[1]
        if sums[f"bad{k}"] < SUPPORT or sums[f"bad{k}"] < PRECISION * sums[f"n{k}"]:
            break
        rules.append(rule[: k + 1])
        left = left.where(~all_of(rules[-1], Condition.on_bins))
    return rules


def verdict(rules: list[list[Condition]], count=F.col) -> Column:
    """The list as one conditional: false where a rule fires, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(all_of(rule, lambda x: x.on_counts(count)), F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, for every document; the list is learned from the labels."""
    counts = saved(measure(docs))
    rules = learn(counts, labels)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the documents that the rules keep, all columns.

    Each text is counted once: rows and counts are written together, learning reads the
    counts alone, and texts are not shuffled.
    """
    names, all_counts = {c: unused(docs, f"quarry_{c}") for c in COUNTS}, unused(docs, "quarry_counts")
    counted = docs.withColumn(all_counts, counts_of(text_of()))
    counted = counted.withColumns({new: F.col(f"{all_counts}.{c}") for c, new in names.items()}).drop(all_counts)
    counted = written(counted)
    rules = learn(counted.select("doc_id", *(F.col(new).alias(c) for c, new in names.items())), labels)
    count = lambda name: F.col(names[name])
    return counted.where(~base_failed(count) & verdict(rules, count)).select(*(F.col(f"`{c}`") for c in docs.columns))
