"""Quality rules as a learned decision list, in DataFrame expressions only.

Sequential covering over labelled statistics: grow a conjunction of thresholds that
separates rejects from accepts on two thirds of the labelled rows (FOIL gain), prune it on
the rest, take the rows it covers away, and go on.  The list comes out as one ordered
``when`` expression.  Every step is one aggregation with a bounded result, because each
statistic is cut to at most ``MAX_BIN + 1`` steps of a fixed grid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import computed, count_where, labelled_sample, with_labels, words
from quillgraph.session import durable

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MAX_BIN = 127
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RAW = [*BASE, "n_lines", "n_capitals", "n_marks", "n_distinct"]

#: statistic name -> (steps per unit, expression over the counts)
_SHARE = {
    "symbol_percent": "100.0 * n_symbols / greatest(word_chars, 1)",
    "capital_percent": "100.0 * n_capitals / greatest(word_chars, 1)",
    "mark_percent": "100.0 * n_marks / greatest(word_chars, 1)",
    "dup_line_percent": "100.0 * n_dup_lines / greatest(n_lines, 1)",
    "repeat_percent": "100.0 * n_repeat_words / greatest(n_words, 1)",
    "distinct_percent": "100.0 * n_distinct / greatest(n_words, 1)",
    "quarter_word_length": "4.0 * word_chars / greatest(n_words, 1)",
    "quarter_log2_words": "4.0 * log2(n_words + 1)",
}


@dataclass
class Rule:
    """A conjunction of (statistic, '>=' or '<=', step); it rejects what it covers."""

    tests: list[tuple[str, str, int]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, step in self.tests:
            out = out & (F.col(name) >= step if sign == ">=" else F.col(name) <= step)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {v}" for n, s, v in self.tests)


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and those the statistics need, all in linear time per text.

    A 5-word window is known by a 64-bit hash within its own text.  Texts whose windows are
    all different, as most are, stop there; the others sort theirs and add up the stretches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    split = docs.withColumn("_w", words(F.col("text"))).withColumn("_l", F.filter(F.split(text, "\n"), has_word))
    n = F.size("_w")
    window = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    hashed = split.withColumn("_h", windows)
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    by_hash = hashed.withColumn("_p", F.when(repeats, placed))
    twice = lambda x, i: (x["h"] == F.get("_p", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("_p", F.greatest(i - 1, F.lit(0)))["h"]))
    starts = by_hash.withColumn("_s", F.sort_array(F.transform(F.filter("_p", twice), lambda x: x["i"])))
    span = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_s", i + 1) - x, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("_s", span), F.lit(0), lambda a, b: a + b)
    counted = computed(
        starts,
        n_words=n.cast("long"),
        word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_symbols=count_where(text, SYMBOLS),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"),
        n_lines=F.size("_l").cast("long"),
        n_capitals=count_where(text, "A-Z"),
        n_marks=count_where(text, "!?"),
        n_distinct=F.size(F.array_distinct("_w")).cast("long"),
    )
    kept = [c for c in docs.columns if c not in _RAW]
    return counted.select(*kept, *_RAW)


def with_statistics(counted: DataFrame) -> DataFrame:
    """The counts with each statistic as a step 0..MAX_BIN of its grid."""
    return counted.withColumns({k: F.expr(f"cast(least({MAX_BIN}, floor({v})) as int)") for k, v in _SHARE.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn(labelled: DataFrame, *, max_rules: int = 12, max_tests: int = 4, min_cover: int = 10, min_precision: float = 0.9) -> list[Rule]:
    """Grow and prune rules on rows with the statistics and ``y`` (0: reject).

    ``labelled`` should be durable.  A rule enters the list if it covers ``min_cover`` rejects
    and is right on at least ``min_precision`` of the pruning rows it covers.  No rejects or no
    labels: no rules.
    """
    rest = labelled.withColumn("_grow", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) < 2)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule = _prune(rest.filter(~F.col("_grow")), _grow(rest.filter("_grow"), max_tests, min_cover))
        if rule is None:
            break
        covered = rest.filter(rule.column()).agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good")).first()
        if covered["bad"] < min_cover or covered["bad"] < min_precision * (covered["bad"] + covered["good"]):
            break
        rules.append(rule)
        rest = rest.filter(~rule.column())
    return rules


def _grow(rows: DataFrame, max_tests: int, min_cover: int) -> Rule:
    rule = Rule()
    while len(rule.tests) < max_tests:
        steps = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("step")) for k in _SHARE]))
        counts = (
            rows.filter(rule.column())
            .select("y", steps.alias("s"))
            .groupBy("s.name", "s.step")
            .agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good"))
            .collect()  # at most (MAX_BIN + 1) rows a statistic
        )
        best = _best_test(counts, min_cover)
        if best is None:
            break
        rule.tests.append(best)
    return rule


def _best_test(counts: list, min_cover: int) -> tuple[str, str, int] | None:
    """The threshold with the largest FOIL gain; ties go to the first by name, sign and step."""
    table = {k: {} for k in _SHARE}
    for r in counts:
        table[r["name"]][r["step"]] = (r["bad"], r["good"])
    bad = sum(b for b, _ in table["symbol_percent"].values())
    good = sum(g for _, g in table["symbol_percent"].values())
    if not bad or not good:
        return None
    before, best = math.log2(bad / (bad + good)), (1e-9, None)
    for name in sorted(table):
        for sign, order in ((">=", -1), ("<=", 1)):
            b = g = 0
            for step in sorted(table[name], reverse=order < 0):
                b, g = b + table[name][step][0], g + table[name][step][1]
                if b >= min_cover and b + g < bad + good:
                    gain = b * (math.log2(b / (b + g)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, sign, step))
    return best[1]


def _prune(rows: DataFrame, rule: Rule) -> Rule | None:
    """The start of the rule that is best on rows it was not grown on; shorter wins ties."""
    if not rule.tests:
        return None
    starts = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    sums = [F.count_if(r.column() & (F.col("y") == y)).alias(f"c{k}_{y}") for k, r in enumerate(starts) for y in (0, 1)]
    seen = rows.agg(*sums).first()
    worth = [(seen[f"c{k}_0"] - seen[f"c{k}_1"]) / max(1, seen[f"c{k}_0"] + seen[f"c{k}_1"]) for k in range(len(starts))]
    return starts[max(range(len(starts)), key=lambda k: (worth[k], -k))]


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects, as one ordered conditional expression."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 30_000) -> list[Rule]:
    """Rules learned from at most about ``max_labelled`` labelled documents (hash sample)."""
    sample = labelled_sample(labels, "quality", max_labelled)
    rows = with_statistics(with_counts(with_labels(docs, sample)))
    passing = rows.filter(~base_failed()).select("doc_id", "y", *_SHARE)
    return learn(durable(passing))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; columns of these names are replaced.

    A null or empty text has no words: all counts 0, base_failed true.  Repeated rows each get
    their own verdict; an empty table gives an empty table.
    """
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # no other column can clash
    marked = with_statistics(with_counts(boxed)).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})
    own = [*BASE, "base_failed", "kept"]
    return marked.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in own], *own)
