"""Learned decision lists on text statistics.

Statistics of a text are column expressions. From labelled rows, thresholds are taken
halfway between quantiles and the rows are counted by the bins they fall into; that table of counts is all the
learner sees. It covers the bad rows one rule at a time: a rule is grown by the condition of
largest information gain, on two thirds of the rows, and pruned on the rest as long as its
worth there does not fall. Rules that are not precise enough on the rest end the list. The
list becomes one conditional expression of Spark, evaluated where the text is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common
from shelfmark.llm.exprs import bind
from shelfmark.session import materialize

#: Bound of the training sample, in labelled rows.
MAX_ROWS = 20_000
QUANTILES = 24
MAX_RULES, MAX_CONDITIONS = 12, 4
#: A rule must be right on this share of the rows it rejects, grown and pruned.
PRECISION = 0.9
_SPACE = r"\x20\x09-\x0D"

RATIOS = (
    "symbol_share", "bang_share", "capital_share", "dup_line_share", "repeat_share",
    "distinct_share", "word_length", "line_words",
)


def repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more, the first included.

    Windows are compared by hash first; only where hashes repeat are the windows themselves
    sorted and compared.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)

    def window(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(3)]

    def exact() -> Column:
        windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i")))
        return bind(F.sort_array(windows), repeats)

    def repeats(ordered: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(ordered, k - 1)["w"] == x["w"])
            after = (k + 1 < F.size(ordered)) & (F.get(ordered, k + 1)["w"] == x["w"])
            return before | after

        places = F.sort_array(F.transform(F.filter(ordered, again), lambda x: x["i"]))
        return bind(places, covered)

    def covered(places: Column) -> Column:
        new = F.transform(
            places, lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(places, k - 1)))
        )
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    hashes = F.transform(starts, lambda i: F.xxhash64(*window(i)))
    none = bind(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < 3, F.lit(0)).when(none, F.lit(0)).otherwise(exact())


def _count(text: Column, not_these: str) -> Column:
    return F.length(F.regexp_replace(text, not_these, ""))


def statistics(text: Column) -> Column:
    """One struct of counts; words are parted by space, tab, line and page breaks."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(rf"[^{_SPACE}]"))

    def of_words(words: Column) -> Column:
        return bind(
            lines,
            lambda full: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                _count(text, r"[^#*$%&|<>]++").cast("long").alias("n_symbols"),
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                repeated_words(words).cast("long").alias("n_repeat_words"),
                F.size(full).cast("long").alias("n_lines"),
                F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
                _count(text, r"[^!?]++").cast("long").alias("n_bangs"),
                _count(text, r"[^A-Z]++").cast("long").alias("n_capitals"),
            ),
        )

    return bind(F.regexp_extract_all(text, F.lit(rf"[^{_SPACE}]+"), F.lit(0)), of_words)


Source = Callable[[str], Column]


def base_failed(of: Source = F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def ratios(of: Source = F.col) -> list[Column]:
    """The statistics the rules speak of, as shares; 0 where there are no words."""

    def share(part: str, whole: str) -> Column:
        return F.when(of(whole) > 0, F.round(of(part) / of(whole), 6)).otherwise(0.0)

    return [
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_bangs", "word_chars").alias("bang_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_words", "n_lines").alias("line_words"),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` with counts, ratios and ``base_failed``, one row for each row of ``docs``."""
    rows = docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    return rows.select("*", *ratios(), base_failed().alias("base_failed"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self, of: Source = F.col) -> Column:
        value = of(self.name)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


@dataclass
class Cell:
    """Labelled rows that share their bins: ``bins[name]`` is the number of thresholds below."""

    bins: dict[str, int]
    bad: int
    good: int


class Learner:
    """Sequential covering over cells."""

    def __init__(self, thresholds: dict[str, list[float]]):
        self.thresholds = thresholds
        self.conditions = [
            Condition(name, above, t) for name, some in thresholds.items() for t in some for above in (True, False)
        ]
        self.place = {(n, t): k for n, some in thresholds.items() for k, t in enumerate(some)}

    def holds(self, c: Condition, cell: Cell) -> bool:
        return (cell.bins[c.name] > self.place[c.name, c.threshold]) == c.above

    def covered(self, rule: Rule, cells: list[Cell]) -> list[Cell]:
        return [x for x in cells if all(self.holds(c, x) for c in rule)]

    @staticmethod
    def count(cells: list[Cell]) -> tuple[int, int]:
        return sum(x.bad for x in cells), sum(x.good for x in cells)

    def grow(self, cells: list[Cell]) -> Rule:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            bad, good = self.count(cells)
            if not bad or not good:
                break
            now = math.log2(bad / (bad + good))
            best, gain = None, 1e-9
            for c in self.conditions:
                b, g = self.count([x for x in cells if self.holds(c, x)])
                if b and (value := b * (math.log2(b / (b + g)) - now)) > gain:
                    best, gain = c, value
            if best is None:
                break
            rule += (best,)
            cells = [x for x in cells if self.holds(best, x)]
        return rule

    def prune(self, rule: Rule, cells: list[Cell]) -> Rule:
        """Drop last conditions while (bad - good) / (bad + good) does not fall."""

        def worth(r: Rule) -> float:
            bad, good = self.count(self.covered(r, cells))
            return (bad - good) / (bad + good) if bad + good else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        return rule

    def learn(self, growing: list[Cell], pruning: list[Cell], precision: float = PRECISION) -> list[Rule]:
        rules: list[Rule] = []
        while len(rules) < MAX_RULES and self.count(growing)[0]:
            rule = self.prune(self.grow(growing), pruning)
            (b1, g1), (b2, g2) = (self.count(self.covered(rule, x)) for x in (growing, pruning))
            if not rule or not b2 or b1 < precision * (b1 + g1) or b2 < precision * (b2 + g2):
                break
            rules.append(rule)
            for cells in (growing, pruning):
                gone = set(map(id, self.covered(rule, cells)))
                cells[:] = [x for x in cells if id(x) not in gone]
        return rules


def between(values: list[float]) -> list[float]:
    """Thresholds halfway between neighbouring distinct values."""
    distinct = sorted(set(values))
    return [(a + b) / 2 for a, b in zip(distinct, distinct[1:])]


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules that reject, in order; empty without labelled rows of both kinds.

    Rows that fail the base check anyway teach nothing. Labels of the held-out class are not
    read.
    """
    sample = common.labelled_texts(docs, common.bounded_labels(labels, label, max_rows))
    stats = sample.select("doc_id", "label", statistics(F.col("text")).alias("s"))
    # Stored before it is filtered, lest the filter computes the statistics again.
    stats = materialize(stats, "rule-statistics").select("doc_id", "label", "s.*")
    rows = stats.where(~base_failed()).select("doc_id", "label", *ratios())
    cuts = [k / QUANTILES for k in range(1, QUANTILES)] + [0.99, 0.995]
    found = rows.agg(*[F.percentile(name, cuts).alias(name) for name in RATIOS]).first()
    thresholds = {name: between(found[name] or []) for name in RATIOS}
    bins = [
        F.size(F.filter(F.array(*map(F.lit, some)), lambda t: t < F.col(name))).alias(name)
        if some else F.lit(0).alias(name)
        for name, some in thresholds.items()
    ]
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning")
    counted = (
        rows.select(part, "label", *bins).groupBy("pruning", *RATIOS)
        .agg(F.sum((F.col("label") == 0).cast("int")).alias("bad"), F.sum((F.col("label") != 0).cast("int")).alias("good"))
        .orderBy("pruning", *RATIOS).collect()
    )
    cells: dict[bool, list[Cell]] = {True: [], False: []}
    for r in counted:
        cells[r["pruning"]].append(Cell({n: r[n] for n in RATIOS}, r["bad"], r["good"]))
    return Learner(thresholds).learn(cells[False], cells[True])


def verdict(rules: list[Rule], of: Source = F.col) -> Column:
    """The list as one conditional expression: false from the first rule that holds."""
    out: Column | None = None
    for rule in rules:
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(of)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` of every row.

    A null or empty text has no words and fails the base check. Null ids stay, repeated rows
    are judged each, other columns are left behind, an empty table gives no rows.
    """
    rows = described(common.texts(docs, id_col, text_col))
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filter_kept(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and no others.

    The whole decision is one expression of the text, so a filter that the optimizer moves
    computes the statistics once.
    """

    def decided(stats: Column) -> Column:
        shares = F.struct(*ratios(lambda name: stats[name]))
        passed = ~base_failed(lambda name: stats[name])
        return bind(shares, lambda share: passed & verdict(rules, lambda name: share[name]))

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.where(bind(statistics(text), decided))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels and judge every document."""
    return judge(docs, learn_rules(docs, labels))
