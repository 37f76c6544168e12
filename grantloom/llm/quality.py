"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean expression over the documents' own text: true rejects. Cost and selectivity of every rule are
estimated on a sample, in one pass, and the rules are then asked in the order of rejections per cost, inside one CASE
expression: a document that a rule rejects is not shown to the later ones. A rule's cost on a document is the work it does
there: the characters it goes through, times what a character costs that kind of expression (EACH). That is counted and
not timed, as times of jobs this short differ by more than the rules do, and gave another order in every run. The order is
greedy: after each rule, rejections and costs of the others are those on the sampled documents that it leaves. It changes
what is computed, never the verdict.

The sample is drawn from all files, each row with the same probability. Nothing is shuffled: every column is computed from
its own row, so hot sources and copies don't matter. Null and empty texts have no words and fail the base rules. Repeated
rows and ties get the same verdict each; extra columns are kept, whatever their names, where they don't clash with those
added here (which replace them). Write the result before filtering on it: Catalyst would push such a filter below the
steps and compute them again inside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import SPACE_CLASS, saved, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _long(c: Column) -> Column:
    return c.cast("long")


def with_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds COUNTS. Arrays are made in steps, each used more than once, so that Catalyst keeps every step's result."""
    kept = [c for c in docs.columns if c not in COUNTS]
    names = [c if c == "text" else f"x{k}" for k, c in enumerate(kept)]  # none begins with an underscore
    text = F.coalesce(F.col("text"), F.lit(""))
    steps = docs.select(*kept).toDF(*names).select(*names, words_of(F.col("text")).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}")).alias("_lines"))
    steps = steps.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_each"))
    # get() takes constant time; slice() would copy the whole array for every window.
    hashes = F.when(F.size("_each") < window, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("_each") - window), lambda i: F.xxhash64(*[F.get(F.col("_each"), i + k) for k in range(window)])))
    steps = steps.select("*", hashes.alias("_hashes"))
    # Sorted with their places only where a window occurs twice; equal windows are then neighbours.
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.when(F.size(F.array_distinct("_hashes")) == F.size("_hashes"), empty).otherwise(F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    steps = steps.select("*", placed.alias("_placed"))
    pairs = F.col("_placed")
    twice = F.filter(pairs, lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
    covered = F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return steps.select(
        *names,
        _long(F.size("_words")).alias("n_words"),
        _long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        _long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
        _long(F.size("_lines")).alias("n_lines"),
        _long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(F.size("_placed") == 0, F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
    ).toDF(*kept, *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """rejects: a boolean expression; work: what it costs on a document."""

    rejects: Column
    work: Column


#: What a character costs, as a multiple of an arithmetic comparison: to split or compare it, and to match it. An
#: expression costs one besides.
EACH = {"split": 0.01, "match": 0.03}


def rules() -> dict[str, Rule]:
    """By name, what each rejects. All are ratios, so a document's length alone decides nothing.

    symbols, duplicate_lines, word_length: too many or too long for the number of words or lines. bullets, ellipses: lines
    that begin or end so. letters: words without any letter. digits, capitals: of the characters of words. few_words: words
    that differ. long_word: one of 1000 characters or more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines, n = F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_words")
    words = SPACE_CLASS[1:-1]
    counted = lambda pattern: F.regexp_count(text, F.lit(pattern))
    none, split, match = F.lit(1.0), 1 + EACH["split"] * F.length(text), 1 + EACH["match"] * F.length(text)
    beginning = lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("\u2022")
    ending = lambda x: x.endswith("...") | x.endswith("\u2026")
    return {
        "symbols": Rule(10 * F.col("n_symbols") > 5 * n, none),
        "duplicate_lines": Rule(100 * F.col("n_dup_lines") > 50 * F.col("n_lines"), none),
        "word_length": Rule((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n), none),
        "bullets": Rule(F.size(F.filter(F.split(text, "\n"), beginning)) > 0.9 * lines, split),
        "ellipses": Rule(F.size(F.filter(F.split(text, "\n"), ending)) > 0.3 * lines, split),
        # A whole word without letters: nothing but white space before and after it.
        "letters": Rule(counted(rf"(?<![^{words}])[^\p{{L}}{words}]++(?![^{words}])") > 0.4 * n, match),
        "digits": Rule(counted("[0-9]") > 0.5 * F.col("word_chars"), match),
        "capitals": Rule(counted(r"\p{Lu}") > 0.7 * F.col("word_chars"), match),
        "few_words": Rule(20 * F.size(F.array_distinct(words_of(text))) < n, match + split),
        "long_word": Rule(text.rlike(f"[^{words}]{{1000}}"), match),
    }


def best_order(names: list[str], patterns: list[tuple[list[bool], list[float], int]]) -> list[str]:
    """Greedy by rejections per cost. patterns: which rules reject, what each rule costs, over so many documents of a kind."""
    left, order = list(range(len(names))), []
    while left:
        ratio = lambda k: (sum(n for rejects, _, n in patterns if rejects[k]) + 0.1) / (sum(cost[k] for _, cost, _ in patterns) + 1e-9)
        best = max(left, key=lambda k: (ratio(k), -k))
        order.append(names[best])
        left.remove(best)
        patterns = [p for p in patterns if not p[0][best]]
    return order


def ordered_rules(docs: DataFrame, sample_rows: int = 1000) -> list[str]:
    """The rules' names, the best one first, by about so many documents of the sample."""
    n = docs.count()
    some = docs.select("text").sample(min(1.0, sample_rows / max(1, n)), seed=7) if n > sample_rows else docs.select("text")
    sample = saved(with_counts(some), "quality-sample").filter(~base_failed())
    every = rules()
    rejects = F.array(*[F.coalesce(r.rejects, F.lit(False)) for r in every.values()])
    work = [F.sum(r.work).alias(f"work{k}") for k, r in enumerate(every.values())]
    # One row per set of rules that reject together: 2 ** rules at most.
    rows = sample.groupBy(rejects.alias("rejects")).agg(*work, F.count("*").alias("n")).collect()
    return best_order(list(every), [(r["rejects"], [r[f"work{k}"] for k in range(len(every))], r["n"]) for r in rows])


def cascade(docs: DataFrame, order: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Adds COUNTS, base_failed and kept. order: the rules' names; estimated on a sample if not given."""
    order = ordered_rules(docs) if order is None else order
    counted = with_counts(docs.drop("base_failed", "kept"), window)
    failed = base_failed()
    kept = F.when(failed, False)
    every = rules()
    for name in order:
        kept = kept.when(F.coalesce(every[name].rejects, F.lit(False)), False)
    return counted.withColumns({"base_failed": failed, "kept": kept.otherwise(True)})
