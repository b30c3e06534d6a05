"""Quality rules as weak supervision.

Each rule votes good, votes bad, or abstains.  How right its votes are on good and on bad documents is
not set but estimated: expectation-maximisation over the counts of vote patterns in the whole table.
The posterior probability of a good document then replaces the demand that all rules pass.

Estimates are the most probable ones under priors worth some tens of documents, which any table outvotes: a rule that is wrong on a third
of the good documents is found to be so, and its vote alone then rejects none.  What tells junk of one symptom from a noisy rule is that
each symptom is measured in more than one way (``GROUPS``): on good documents rules of a group are wrong apart, on junk they are right together.

Scale: measures are native expressions of one text, made in one pass that writes them, with the columns that the
caller wants, as a table.  From there patterns are counted, at most ``3 ** len(RULES)`` rows whatever the table's
size and in practice some hundreds, the driver runs the iterations over these, and the posterior is a column expression.  No text is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, quoted, stored, words_of

#: Words of a window whose repetition counts.
REPEAT = 8
#: Iterations of expectation-maximisation at most, and the relative change of the objective that ends them.
ROUNDS, ENOUGH = 500, 1e-10
#: What each share is taken to have seen before: right and wrong votes on bad documents, good and bad documents.
BEFORE = 1.0
#: Votes on good documents that each rule is taken to have cast before, and the share of them that was right.
BEFORE_GOOD, RIGHT_BEFORE = 20.0, 0.99
#: Posterior probability from which a document is kept.
KEEP = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim", "n_capitals", "n_letters", "n_stutter", "n_symbolic", "n_bare", "n_symbol_runs"]

#: name, measure, votes good at most / at least, votes bad from; the sign says which side is bad.
RULES: list[tuple[str, str, float, float]] = [
    ("length", "-n_words", -40, -19),
    ("long_words", "word_chars / n_words", 10, 16),
    ("short_words", "-word_chars / n_words", -2.5, -1.5),
    ("symbols", "n_symbols / n_words", 0.05, 0.3),
    ("exclaiming", "n_exclaim / n_words", 0.05, 0.3),
    ("capitals", "n_capitals / n_words", 0.1, 0.5),
    ("letters", "-n_letters / word_chars", -0.8, -0.6),
    ("lines", "n_dup_lines / n_lines", 0.1, 0.5),
    ("repeats", "n_repeat_words / n_words", 0.1, 0.3),
    ("stutter", "n_stutter / n_words", 0.05, 0.3),
    ("symbolic_words", "n_symbolic / n_words", 0.05, 0.3),
    ("bare_words", "n_bare / n_words", 0.05, 0.3),
    ("symbol_runs", "n_symbol_runs / n_words", 0.02, 0.2),
]
#: Rules that look at one symptom, each in its own way.
GROUPS = {
    "symbols": ("symbols", "symbolic_words", "bare_words", "symbol_runs", "letters"),
    "repetition": ("lines", "repeats", "stutter"),
    "shouting": ("exclaiming", "capitals"),
    "odd words": ("long_words", "short_words", "letters"),
}


def measures(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with a column for each of ``MEASURES``; null text is empty.

    Columns, not a struct: the optimizer would copy a struct's expressions to each of its readers.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))
    step1 = docs.select("*", whole.alias("_text"), words_of(text).alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    # a window's hash in three doublings: of 2, 4 and 8 words (slices would copy the array for each window)
    step2 = step1.withColumn("_1", F.transform("_words", lambda w: F.xxhash64(w)))
    for wide in (1, 2, 4):
        step2 = step2.withColumn(f"_{2 * wide}", F.transform(f"_{wide}", _paired(f"_{wide}", wide)))
    step2 = step2.withColumn("_hashes", F.slice(f"_{REPEAT}", 1, F.greatest(n - (REPEAT - 1), F.lit(0))))
    # only where some window repeats are they sorted: equal ones are neighbours then
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    step3 = step2.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: (F.get("_sorted", k - 1)["h"] == x["h"]) | (F.get("_sorted", k + 1)["h"] == x["h"])
    starts = F.sort_array(F.transform(F.filter("_sorted", lambda x, k: F.coalesce(near(x, k), F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-REPEAT).alias("last"), F.lit(0).alias("sum")),
        lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(REPEAT), i - s["last"])).alias("sum")),
        lambda s: s["sum"],
    )
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    stutter = F.size(F.filter("_1", lambda h, i: F.coalesce(h == F.get("_1", i - 1), F.lit(False))))
    made = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_exclaim": count("!"),
        "n_capitals": count(r"\p{Lu}{2,}"),
        "n_letters": F.length(F.regexp_replace("_text", r"\P{L}+", "")),
        "n_stutter": stutter,
        "n_symbolic": count(f"(?<![^{BLANK}])[^{BLANK}#*$%&|<>]*+[#*$%&|<>]"),
        "n_bare": count(rf"(?<![^{BLANK}])[^{BLANK}\p{{L}}\p{{N}}]++(?![^{BLANK}])"),
        "n_symbol_runs": count("[#*$%&|<>]{2,}+"),
    }
    return step3.select(*[F.col(quoted(c)) for c in docs.columns], *[made[x].cast("long").alias(f"_{x}") for x in MEASURES])


def _paired(column: str, ahead: int):
    """Hashes each element with the one ``ahead`` of it; past the end that is null."""
    return lambda h, i: F.xxhash64(h, F.get(column, i + ahead))


def votes(rules: list[tuple[str, str, float, float]] | None = None) -> list[Column]:
    """One column a rule: 1 good, -1 bad, 0 abstains, as it does where its measure is undefined."""
    out = []
    for name, measure, good, bad in RULES if rules is None else rules:
        m = F.expr(_measure_sql(measure))
        out.append(F.when(m >= bad, -1).when(m <= good, 1).otherwise(0).cast("tinyint").alias(name))
    return out


def _measure_sql(measure: str) -> str:
    """The measure in SQL over the columns; a zero divisor gives null."""
    top, _, under = measure.partition(" / ")
    sign, top = ("-", top[1:]) if top[0] == "-" else ("", top)
    return f"{sign}_{top}" + (f" / nullif(_{under}, 0)" if under else "")


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> dict:
    """Prior and, for each rule, P(votes good | good, votes) and P(votes bad | bad, votes).

    ``patterns`` are votes and how many documents cast them.  The start takes a document for bad if
    any rule says so.  No documents: the estimates are their priors.  ``objective`` has the logarithm of what is maximised,
    up to a constant, after each iteration; it never falls.
    """
    patterns = sorted(patterns)
    votes = np.array([v for v, _ in patterns], dtype=np.int8).reshape(len(patterns), rules)
    n = np.array([k for _, k in patterns], dtype=np.float64)
    says_good, says_bad = (votes == 1).astype(np.float64), (votes == -1).astype(np.float64)
    p = np.where((votes == -1).any(axis=1), 0.01, 0.99)
    sure, doubt = BEFORE_GOOD * RIGHT_BEFORE, BEFORE_GOOD * (1 - RIGHT_BEFORE)
    model: dict = {"objective": []}
    for _ in range(ROUNDS):
        good, bad = n * p, n * (1 - p)
        prior = (good.sum() + BEFORE) / (n.sum() + 2 * BEFORE)
        hit, miss, let, caught = good @ says_good, good @ says_bad, bad @ says_good, bad @ says_bad
        on_good = (hit + sure) / (hit + miss + sure + doubt)
        on_bad = (caught + BEFORE) / (caught + let + 2 * BEFORE)
        g = math.log(prior) + says_good @ np.log(on_good) + says_bad @ np.log(1 - on_good)
        b = math.log(1 - prior) + says_good @ np.log(1 - on_bad) + says_bad @ np.log(on_bad)
        both = np.logaddexp(g, b)
        before = BEFORE * math.log(prior * (1 - prior)) + (sure * np.log(on_good) + doubt * np.log(1 - on_good)).sum() + (BEFORE * np.log(on_bad * (1 - on_bad))).sum()
        value = float(before + n @ both)
        p = np.exp(g - both)
        model |= {"prior": float(prior), "on_good": on_good.tolist(), "on_bad": on_bad.tolist()}
        model["objective"].append(value)
        if len(model["objective"]) > 1 and value - model["objective"][-2] <= ENOUGH * max(1.0, abs(value)):
            break
    return model


def posterior(model: dict, names: list[str]) -> Column:
    """Probability that a document is good, of columns with its votes."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, a, c in zip(names, model["on_good"], model["on_bad"], strict=True):
        odds = odds + F.when(F.col(name) == 1, F.lit(math.log(a / (1 - c)))).when(F.col(name) == -1, F.lit(math.log((1 - a) / c))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("_n_words") < 20) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * 30)


def judge(docs: DataFrame, *, text_col: str = "text", keep: float = KEEP, with_text: bool = True) -> DataFrame:
    """``docs`` with the measures (``_n_words`` and so on), ``base_failed``, ``p_good`` and ``kept``.

    Too short or too repetitive texts fail the base rules and go whatever the posterior.  A null or
    empty text has no words and fails; one of any length is measured whole.  Repeated rows vote each for themselves.  A posterior
    equal to ``keep`` keeps.  An empty table gives no rows.  Columns of ``docs`` stay, but for those named as the added ones,
    which are replaced, and the text if it is not wanted.
    """
    names = [r[0] for r in RULES]
    new = [*[f"_{x}" for x in MEASURES], "base_failed", "p_good", "kept"]
    given = [c for c in docs.columns if c not in new and (with_text or c != text_col)]
    # under plain names, since a table may hold no two that differ in case only
    rows = docs.select(F.struct(F.lit(0).alias("c"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(given)]).alias("_row"), F.col(quoted(text_col)).alias("_t"))
    made = stored(measures(rows, F.col("_t")).drop("_t"))
    voted = made.select("*", *[v.alias(f"_v_{x}") for v, x in zip(votes(), names, strict=True)])
    voting = [f"_v_{x}" for x in names]
    counted = voted.groupBy(*voting).agg(F.count("*").alias("n")).collect()  # 3 ** len(RULES) rows at most
    model = fit([(tuple(r[x] for x in voting), r["n"]) for r in counted], len(names))
    judged = voted.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(model, voting)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))
    return judged.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(given)], *new)
