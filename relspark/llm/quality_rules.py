"""Quality rules: a base of fixed limits, then a learned decision list of threshold conjunctions.

Words are runs of characters other than the six ASCII white space characters. Each text is reduced to a
few whole numbers (`statistics`), all by column functions inside the row: nothing is shuffled, and the
work on a text grows with its length times the logarithm of it. The list is learned by sequential
covering from labelled statistics: a rule grows on two thirds of the sample by the threshold of the best
information gain, is pruned from its end on the other third, and stays only if it is precise there; what it
covers is taken away and the next one grows. The list becomes one ordered conditional expression.

Windows of three words are compared by a 64-bit hash. Null text counts as empty and has no words; a blank
text too: the base rejects both. A very long text is taken whole. Repeated and tied rows get the same result
each; an id with several labels counts as bad if one of them is bad, an id with several texts
is learned from once (least statistics). No usable labels: no rules, and the base alone decides. An
empty table gives an empty result. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.rows import column, text_of

#: Limits of the base.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Texts of each label to learn from, at most: those with the least hash of their id.
PER_CLASS = 3000
MOST_RULES, MOST_CONDITIONS = 12, 4
#: A rule must be right in this share of what it covers in the pruning part, and cover so many bad texts.
LEAST_PRECISION, LEAST_COVER = 0.95, 3

_BLANK = r"[\x20\x09-\x0D]+"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_marks", "n_capitals"]
#: What rules look at: a name, and the two counts whose quotient it is (None: 1).
FEATURES = {
    "words": ("n_words", None),
    "letters_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "capitals_per_letter": ("n_capitals", "word_chars"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "distinct_words": ("n_distinct", "n_words"),
}


def _left_of(text: Column, chars: str) -> Column:
    """Number of characters of a class in a text."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def statistics(docs: DataFrame, keys: list[Column], text_column: str = "text") -> DataFrame:
    """The given columns and the counts of each row's text, as long."""
    n = len(keys)
    rows = docs.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], text_of(docs, text_column).alias("text"))
    kept = [f"_k{i}" for i in range(n)]
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *kept, "text", F.array_remove(F.split("text", _BLANK), "").alias("words"), lines.alias("lines")
    )
    joined = F.array_join("words", "")
    grams = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    size = F.size("words")
    rows = rows.select(
        *kept,
        size.cast("long").alias("n_words"),
        F.char_length(joined).cast("long").alias("word_chars"),
        _left_of(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _left_of(F.col("text"), ".,;:!?").alias("n_marks"),
        _left_of(F.col("text"), "A-Z").alias("n_capitals"),
        F.when(size >= 3, F.slice(grams, 1, F.greatest(size - 2, F.lit(1)))).alias("grams"),
    )
    # most texts have no window twice: only the others are sorted
    some = F.size(F.array_distinct("grams")) < F.size("grams")
    pairs = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    counts = [c for c in _COUNTS if c != "n_repeat_words"]
    rows = rows.select(*kept, *counts, F.when(some, pairs).alias("pairs"))

    def twice(pair: Column, k: Column) -> Column:
        return F.coalesce(pair["g"] == F.get("pairs", k - 1)["g"], F.lit(False)) | F.coalesce(
            pair["g"] == F.get("pairs", k + 1)["g"], F.lit(False)
        )

    places = F.sort_array(F.transform(F.filter("pairs", twice), lambda p: p["i"]))
    rows = rows.select(*kept, *counts, places.alias("places"))
    # a window covers its three words, less those that the next repeated window covers
    steps = F.transform("places", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - x, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)
    found = F.struct(*kept, *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    # a filter on these counts stays above the generator; below it Spark would put whole expressions into lambdas
    return rows.select(F.inline_outer(F.array(found)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] > self.limit) == self.above

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:g}"


Rule = tuple[Condition, ...]


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    if under is None:
        return F.col(over).cast("double")
    # texts that pass the base have words, hence letters and lines
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def _covered(rule: Rule, rows: list) -> list:
    return [r for r in rows if all(c.holds(r[0]) for c in rule)]


def _counts(rows: list) -> tuple[int, int]:
    bad = sum(label == 0 for _, label in rows)
    return bad, len(rows) - bad


def best_condition(rows: list) -> Condition | None:
    """The threshold with the greatest gain: bad texts kept, times bits gained on the share of bad ones."""
    all_bad, all_good = _counts(rows)
    if not all_bad or not all_good:
        return None
    base = math.log2(all_bad / (all_bad + all_good))
    best, found = 1e-9, None
    for name in FEATURES:
        ordered = sorted((row[name], label) for row, label in rows)
        bad = good = 0
        for (value, label), (after, _) in zip(ordered, ordered[1:], strict=False):
            bad, good = bad + (label == 0), good + (label != 0)
            if value == after:
                continue
            for above, p, n in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                gain = p * (math.log2(p / (p + n)) - base) if p else 0
                if gain > best:
                    best, found = gain, Condition(name, above, (value + after) / 2)
    return found


def grown(rows: list) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS and (condition := best_condition(rows)):
        rule += (condition,)
        rows = _covered((condition,), rows)
    return rule


def pruned(rule: Rule, rows: list) -> tuple[Rule, int, int]:
    """The beginning of the rule that does best on other rows, with the bad and good ones it covers."""

    def worth(some: Rule) -> tuple:
        bad, good = _counts(_covered(some, rows))
        return ((bad - good) / (bad + good) if bad + good else -1.0, bad)

    best = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())
    return best, *_counts(_covered(best, rows))


def decision_list(rows: list[tuple[dict[str, float], int]]) -> list[Rule]:
    """Rules for bad texts, in the order in which they were found; every third row prunes."""
    prune, grow = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule = grown(grow)
        if not rule:
            break
        rule, bad, good = pruned(rule, prune)
        if bad < LEAST_COVER or bad < LEAST_PRECISION * (bad + good):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r[0]) for c in rule)] for part in (grow, prune))
    return rules


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str = "quality",
    per_class: int = PER_CLASS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> list[Rule]:
    """Learn the list from at most per_class texts of each label that pass the base.

    What comes to the driver is at most 2 * per_class rows of numbers.
    """
    key, label = column(labels, id_column).alias("id"), column(labels, label_column).alias("label")
    known = labels.select(key, label).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.min("label").alias("label")).withColumn("place", F.xxhash64("id"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("place", "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(column(docs, id_column).alias("id"), text_of(docs, text_column).alias("text"))
    texts = texts.join(F.broadcast(chosen), "id")  # at most 2 * per_class rows
    found = statistics(texts, [F.col("place"), F.col("id"), F.col("label")]).where(~base_failed())
    values = F.struct(*[feature(name).alias(name) for name in FEATURES])
    rows = found.groupBy("_k0", "_k1", "_k2").agg(F.min(values).alias("values")).orderBy("_k0", "_k1").collect()
    return decision_list([(r["values"].asDict(), r["_k2"]) for r in rows])


def fired(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1 on; null if none does."""
    found = None
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        found = F.when(holds, number) if found is None else found.when(holds, number)
    return F.lit(None).cast("int") if found is None else found.cast("int")


def judged(
    docs: DataFrame, rules: list[Rule], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(<id>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept) of every row.

    `rule` is the learned rule that rejects a text which passes the base.
    """
    found = statistics(docs, [column(docs, id_column)], text_column)
    found = found.withColumn("base_failed", base_failed())
    found = found.withColumn("rule", F.when(~F.col("base_failed"), fired(rules)))
    return found.select(
        F.col("_k0").alias(id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "rule",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
    )
