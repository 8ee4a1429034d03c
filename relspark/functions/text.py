"""Clean-up and tokens of result texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relspark.functions.vectors import bind

# The clean-up patterns of rule lists and detection names.
RULE_DROPPED = r"[^a-zA-Z0-9.,_]"
RULE_WORD = "yara"
NAME_SUFFIX = r"[!@~][a-zA-Z0-9\s+]+"
NAME_GROUP = r"[(|\[{][a-zA-Z0-9\s+]*[)|\]}]"
NAME_PUNCTUATION = r"[.!:_\-\\/\[\]]"
MIN_TOKEN_LENGTH = 4


def clean_rules(text: Column) -> Column:
    """The rule list inside a rule-match result as a comma string.

    Only letters, digits, `.`, `,` and `_` stay, then every `yara` is deleted, also inside names.
    Names keep the `rule` prefix that the member name leaves behind.
    """
    return F.replace(F.regexp_replace(text, RULE_DROPPED, ""), F.lit(RULE_WORD), F.lit(""))


def rule_names(text: Column) -> Column:
    """The real rule names of a rule-match result, from its JSON."""
    parsed = F.from_json(text, "yara array<struct<rule:string>>")
    return F.filter(parsed["yara"]["rule"], lambda r: r.isNotNull())


def clean_detection(name: Column) -> Column:
    """A vendor's detection name without quotes, suffixes and bracketed groups; punctuation is blank."""
    plain = F.replace(name, F.lit('"'), F.lit(""))
    plain = F.regexp_replace(plain, NAME_SUFFIX, "")
    plain = F.regexp_replace(plain, NAME_GROUP, "")
    return F.regexp_replace(plain, NAME_PUNCTUATION, " ")


def is_keyword(token: Column) -> Column:
    """Long enough and free of digits."""
    return (F.length(token) >= MIN_TOKEN_LENGTH) & ~token.rlike("[0-9]")


def detection_words(name: Column) -> Column:
    """The words of one detection name, keywords or not."""
    return F.split(clean_detection(name), " ")


def detection_tokens(name: Column) -> Column:
    """The lower-case keyword tokens of one detection name."""
    return F.transform(F.filter(detection_words(name), is_keyword), F.lower)


def split_tokens(value: Column) -> Column:
    """Split a comma string; trailing empty tokens are dropped.

    The empty string is one empty token, a string of commas only has none.
    """

    def split(cut: Column) -> Column:
        return (
            F.when(value == "", F.array(F.lit("")))
            .when(cut == "", F.array().cast("array<string>"))
            .otherwise(F.split(cut, ","))
        )

    return bind(F.regexp_replace(value, ",+$", ""), split)


def token_counts(tokens: Column) -> Column:
    """array<struct<token, n, distinct>> of an array of tokens: each token, how often it occurs, and
    the number of distinct tokens.

    The array is sorted and its runs are measured, so the work stays in the row and grows with
    n log n.
    """

    def run_starts(s: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )

    def measure(s: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda start, k: F.struct(
                F.get(s, start).alias("token"),
                (F.coalesce(F.get(starts, k + 1), F.size(s)) - start).alias("n"),
                F.size(starts).alias("distinct"),
            ),
        )

    empty = F.array().cast("array<struct<token:string,n:int,distinct:int>>")

    def count(s: Column) -> Column:
        counted = bind(run_starts(s), lambda starts: measure(s, starts))
        return F.when(F.size(s) > 0, counted).otherwise(empty)

    return bind(F.sort_array(tokens), count)


def overlap_score(left: Column, right: Column, as_sets: bool = False) -> Column:
    """Overlap of two comma strings that are already in one row.

    Shared tokens, counted with repeats (or once each, `as_sets`), over distinct tokens of both.
    A text without tokens scores 0.
    """

    def score(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        if as_sets:
            shared = F.size(F.array_intersect(a, b))
        else:
            common = F.transform(
                token_counts(a),
                lambda t: F.least(t["n"], F.size(F.filter(b, lambda x: x == t["token"]))),
            )
            shared = F.aggregate(common, F.lit(0), lambda acc, n: acc + n)
        return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / union).otherwise(F.lit(0.0))

    return bind(split_tokens(left), lambda a: bind(split_tokens(right), lambda b: score(a, b)))


def qualified_name(library: Column, function: Column) -> Column:
    return F.concat_ws(".", library, function)
