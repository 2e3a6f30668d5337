"""Quality rules whose cutoffs carry a guarantee on labelled holdouts.

Each rule is a number per document, higher is worse, and a row of cutoffs from lenient to
strict. For every stratum and rule the labelled good documents are the holdout: a cutoff is
certified when the exact binomial tail P(X <= rejected good | n good, share ``alpha``) is at
most ``delta / tests``, so its true share of false rejections is below ``alpha`` with that
confidence. Cutoffs are tested in their order and the first failure ends the row (no further
correction inside a row); ``tests`` is the number of rows, strata times rules (Bonferroni).
Among the certified cutoffs the one with the best gap between rejected bad and rejected good
documents is taken, the lenient one on ties. A row without a certified cutoff rejects nothing.

Built-in expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.rows import text_key, without
from shelfmark.operators.keys import lookup_join
from shelfmark.session import cut

#: One or more characters of white space; words are what lies between.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Rule -> cutoffs, lenient first. A document fails a rule when its value is above the cutoff.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "dup_line_share": (0.9, 0.7, 0.5, 0.3, 0.2, 0.1),
    "repeat_word_share": (0.19, 0.17, 0.15, 0.12, 0.1, 0.05),
    "capital_share": (0.9, 0.8, 0.7, 0.5, 0.3, 0.2),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas inside use it often."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words covered by runs of ``width`` words that occur twice or more in the array."""
    none = F.lit(0).cast("long")

    def covered(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["w"] == F.get(s, j)["w"]
        repeated = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda j: ((j > 0) & same(j, j - 1)) | ((j < F.size(s) - 1) & same(j, j + 1)),
        )
        begins = F.sort_array(F.transform(repeated, lambda j: F.get(s, j)["p"]))
        return F.aggregate(
            begins,
            F.struct(none.alias("to"), none.alias("n")),
            lambda a, p: F.struct((p + width).alias("to"), (a["n"] + p + width - F.greatest(p, a["to"])).alias("n")),
            lambda a: a["n"],
        )

    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("w"), i.cast("long").alias("p")),
    )
    return let(F.sort_array(runs), covered)


def text_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns of :data:`STATS` (long) of each whole text; a null has no words.

    Runs of five words are compared by 64-bit hashes first: different hashes prove different
    runs. Only a text in which two hashes agree has its runs compared as strings.
    """
    keep = df.columns
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BLANK), "")
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0)
    split = df.withColumns({"_words": words, "_lines": lines})
    hashed = split.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col("_h"), i + k)
    runs = F.when(F.size("_h") >= 5, F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)])))
    runs = hashed.withColumn("_runs", F.coalesce(runs, F.array().cast("array<bigint>")))
    repeats = F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), repeat_words(F.col("_words"))).otherwise(F.lit(0))
    return runs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\p{Lu}")), F.lit(0)).cast("long").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """Rule -> value of a document, 0 where it has no words."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
    }


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series eight steps further up."""
    up = x + 8
    series = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5)
    below = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return series - F.log(below)


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X of n trials with chance p; 0 where k is at or above the mean.

    Terms fall from the k-th down by growing ratios, and far below the mean's spread they no
    longer count in a double: as many are added as some ten spreads hold.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 100).cast("int")
    one = F.lit(1.0)
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(one.alias("t"), one.alias("s")),
        lambda a, i: let(
            a["t"] * (k - i) * (1 - p) / ((n - k + i + 1) * p), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"))
        ),
        lambda a: a["s"],
    )
    return F.when(k >= n * p, F.lit(0.0)).otherwise(top + F.log(total))


def certified_cutoffs(
    judged: DataFrame, cutoffs: Mapping[str, Sequence[float]], alpha: float, delta: float, stratum: str = "stratum", good: str = "good"
) -> DataFrame:
    """(stratum, n_docs, one column per rule): the chosen cutoff, null where none is certified.

    ``judged`` holds the stratum, ``good`` (true, false, null: no label) and a column per rule.
    Counted in one aggregation with partial sums; a stratum is one row from then on.
    """
    bad, fine = F.col(good) == F.lit(False), F.col(good) == F.lit(True)
    over = [(r, i, F.col(r) > c) for r, cs in cutoffs.items() for i, c in enumerate(cs)]
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    counted = cut(judged.groupBy(stratum).agg(
        F.count("*").alias("n_docs"),
        count(fine).alias("n_good"),
        count(bad).alias("n_bad"),
        *[count(fine & hit).alias(f"good_{r}_{i}") for r, i, hit in over],
        *[count(bad & hit).alias(f"bad_{r}_{i}") for r, i, hit in over],
    ))
    tests = max(counted.count(), 1) * len(cutoffs)
    least = math.log(delta / tests)
    chosen, joined = {}, counted
    for rule, values in cutoffs.items():
        passed = F.lit(True)
        for i, c in enumerate(values):
            passed = passed & (log_binomial_tail(F.col(f"good_{rule}_{i}"), F.col("n_good"), alpha) <= least)
            gap = F.when(F.col("n_bad") > 0, F.col(f"bad_{rule}_{i}") / F.col("n_bad")).otherwise(F.lit(0.0)) - F.col(f"good_{rule}_{i}") / F.col("n_good")
            joined = joined.withColumn(f"_gap_{rule}_{i}", F.when(passed & (F.col("n_good") > 0), gap))
            passed = F.col(f"_gap_{rule}_{i}").isNotNull()
        gaps = [F.col(f"_gap_{rule}_{i}") for i in range(len(values))]
        top = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
        pick = F.coalesce(*[F.when(g == top, F.lit(float(c))) for g, c in zip(gaps, values)])
        chosen[rule] = F.when(top > 0, pick)
    return joined.select(stratum, "n_docs", *[v.alias(f"cut_{r}") for r, v in chosen.items()])


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    alpha: float = 0.02,
    delta: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    cutoffs: Mapping[str, Sequence[float]] | None = None,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(id, the stats, base_failed, kept, failed_rules) for every row of ``docs``.

    The strata are the values of ``stratum_col``, null being one; each rule falsely rejects at
    most ``alpha`` of the good documents of a stratum, all at once with confidence ``1 - delta``.
    All labelled documents are the holdout; the stats of all documents are computed once and
    written to the checkpoint folder. Rows with a null or repeated id get their own verdict; a
    null id has no label. A document with several labels is good only if none says 0; a null
    label counts as none. A null text has no words and fails the base rule. Empty tables give
    no rows; without labels no cutoff is certified and the base rule alone decides. Of the
    inputs only the named columns are read. ``carry`` adds columns of ``docs`` to the result.
    """
    cutoffs = CUTOFFS if cutoffs is None else cutoffs
    carry = carry or {}
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), stratum.alias("stratum"), *[c.alias(n) for n, c in carry.items()])
    stats = cut(text_stats(rows, "_text").drop("_text"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg((F.min(label_col) > 0).alias("good"))
    values = rule_values()
    judged = stats.join(marks, stats["_id"] == marks["_label_id"], "left").select(
        "stratum", "good", *[values[r].alias(r) for r in cutoffs]
    )
    table = cut(certified_cutoffs(judged, cutoffs, alpha, delta))
    picks = [f"cut_{r}" for r in cutoffs]
    met = lookup_join(stats, table, "stratum", picks, "n_docs", F.xxhash64("_id", "word_chars", "n_words"))
    failed = F.array_compact(F.array(*[F.when(values[r] > F.col(f"cut_{r}"), F.lit(r)) for r in cutoffs]))
    return met.select(
        F.col("_id").alias(id_col), *carry, *STATS, base_failed().alias("base_failed"), failed.alias("failed_rules")
    ).select(
        id_col, *carry, *STATS, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules"
    )


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns as they are."""
    found = quality_verdicts(docs, labels, id_col=id_col, text_col=text_col, carry={"key": text_key(id_col, text_col)}, **how)
    return without(docs, cut(found.where(~F.col("kept")).select(F.col(id_col).alias("id"), "key")), id_col, text_col)
