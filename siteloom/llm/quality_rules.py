"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far each is right, a posterior decides.

``measure`` gives a text's counts, all with built-in functions inside one row. ``votes`` turns them into +1 (good), -1 (bad) or
0 (abstains) for each rule. ``fit`` runs expectation-maximisation over the table of vote patterns - at most 3 ** rules rows,
whatever the corpus - one aggregate a step; only one row of rates returns to the driver. ``judge`` gives
the verdicts, ``keep_good`` the rows that stay.

The model: a text is good with probability ``prior``; rule r, when it votes, says good with rate ``good[r]`` on good texts and
``bad[r]`` on bad ones, independently. Abstaining tells nothing. Rates are smoothed towards ``START`` so that no rate is 0 or 1.

Defined cases: null and empty texts have no words, all counts 0, and fail the base rules; repeated rows each count; an empty
table gives no rows (fit then returns its starting rates). Words are runs of characters other than space and 9 to 13.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siteloom.session import stage

SPACE = "[ \\t\\n\\x0B\\f\\r]"
#: Common words of the four languages, at least two of which prose of some length should hold.
STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "der", "die", "und", "das", "den", "mit", "von", "de", "la", "que",
              "el", "los", "en", "et", "les", "des", "le", "un", "une", "est", "pour", "por", "para", "con"]
#: Rates of a good vote on good and on bad texts, and the share of good texts, before any data; and their weight in rows.
START, WEIGHT = (0.9, 0.4, 0.7), 1.0


def length_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``m`` of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the votes need."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__w", F.array_remove(F.split(body, f"{SPACE}+"), ""))
    d = d.withColumn("__n", F.size("__w"))
    # Hashes of the windows of three words, in order.
    d = d.withColumn("__h", F.when(F.col("__n") >= 3, F.transform(
        F.sequence(F.lit(1), F.col("__n") - 2),
        lambda i: F.xxhash64(F.get("__w", i - 1), F.get("__w", i), F.get("__w", i + 1)))).otherwise(F.array().cast("array<bigint>")))
    # Places of windows that occur again: neighbours of equal hash once sorted by (hash, place). Most texts need no sort.
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    d = d.withColumn("__s", F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hash_at = lambda j: F.get("__s", j)["h"]
    d = d.withColumn("__p", F.sort_array(F.transform(
        F.filter("__s", lambda x, j: (hash_at(j - 1) == x["h"]) | F.coalesce(hash_at(j + 1) == x["h"], F.lit(False))), lambda x: x["i"])))
    # Each such window covers three words; overlaps count once.
    covered = F.aggregate(F.sequence(F.lit(1), F.size("__p") - 1), F.lit(3),
                          lambda n, j: n + F.least(F.lit(3), F.get("__p", j) - F.get("__p", j - 1)))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    d = d.withColumn("__lines", lines)
    letters = length_without(body, "\\P{L}+")
    return d.withColumn("m", F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.char_length(body) - length_without(body, "[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("__p") > 1, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("n_lines"), letters.alias("n_letters"), length_without(body, "\\P{Lu}+").alias("n_upper"),
        F.size(F.array_intersect("__w", F.array(*map(F.lit, STOP_WORDS)))).alias("n_stop"),
        F.size(F.array_distinct("__w")).alias("n_distinct"),
    )).drop("__w", "__n", "__h", "__s", "__p", "__lines")


def vote(bad: Column, good: Column) -> Column:
    """-1, +1 or 0; a bad sign goes before a good one, and a sign that can't be computed is none."""
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def votes() -> dict[str, Column]:
    """The rules over the struct ``m``."""
    m = lambda k: F.col(f"m.{k}")
    words = F.nullif(m("n_words"), F.lit(0))
    share = lambda k, of="word_chars": m(k) / F.nullif(m(of), F.lit(0))
    marks = (m("word_chars") - m("n_letters")) / F.nullif(m("word_chars"), F.lit(0))
    return {
        "length": vote(m("n_words") < 50, m("n_words") >= 100),
        "word_length": vote(~(m("word_chars") / words).between(2.5, 12), (m("word_chars") / words).between(3, 9)),
        "symbols": vote(m("n_symbols") / words > 0.1, m("n_symbols") / words < 0.02),
        "lines": vote(m("n_dup_lines") / F.nullif(m("n_lines"), F.lit(0)) > 0.3, m("n_dup_lines") == 0),
        "repeats": vote(m("n_repeat_words") / words > 0.35, m("n_repeat_words") / words < 0.2),
        "capitals": vote(share("n_upper", "n_letters") > 0.4, share("n_upper", "n_letters") < 0.15),
        "common_words": vote((m("n_stop") < 2) & (m("n_words") >= 30), m("n_stop") >= 3),
        "marks": vote(marks > 0.15, marks < 0.08),
        "variety": vote(m("n_distinct") / words < 0.1, m("n_distinct") / words > 0.2),
    }


def likelihood(rules: list[str], rates: dict, kind: str) -> Column:
    """Log-probability of a row's votes on texts of a kind."""
    out = F.lit(0.0)
    for r in rules:
        p = rates[kind][r]
        out = out + F.when(F.col(f"v.{r}") > 0, F.log(F.lit(p))).when(F.col(f"v.{r}") < 0, F.log(F.lit(1 - p))).otherwise(0.0)
    return out


def posterior(rules: list[str], rates: dict) -> Column:
    """Probability that a text with the votes ``v`` is good."""
    odds = F.log(F.lit(rates["prior"])) - F.log(F.lit(1 - rates["prior"])) + likelihood(rules, rates, "good") - likelihood(rules, rates, "bad")
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rules: list[str], steps: int = 30, enough: float = 1e-4) -> dict:
    """Rates by expectation-maximisation over rows (v, n); stops when no rate moves by more than ``enough``."""
    rates = {"prior": START[2], "good": dict.fromkeys(rules, START[0]), "bad": dict.fromkeys(rules, START[1])}
    for _ in range(steps):
        p = F.col("p")
        sums = [F.sum(F.col("n") * p).alias("good"), F.sum("n").alias("all")]
        for r in rules:
            said, spoke = (F.col(f"v.{r}") > 0).cast("int"), (F.col(f"v.{r}") != 0).cast("int")
            sums += [F.sum(F.col("n") * p * said).alias(f"gg_{r}"), F.sum(F.col("n") * p * spoke).alias(f"g_{r}"),
                     F.sum(F.col("n") * (1 - p) * said).alias(f"bg_{r}"), F.sum(F.col("n") * (1 - p) * spoke).alias(f"b_{r}")]
        row = patterns.withColumn("p", posterior(rules, rates)).agg(*sums).first()
        if not row["all"]:
            return rates
        smooth = lambda a, b, start: (a + WEIGHT * start) / (b + WEIGHT)
        new = {"prior": smooth(row["good"], row["all"], START[2]),
               "good": {r: smooth(row[f"gg_{r}"], row[f"g_{r}"], START[0]) for r in rules},
               "bad": {r: smooth(row[f"bg_{r}"], row[f"b_{r}"], START[1]) for r in rules}}
        moved = max(abs(new[k][r] - rates[k][r]) for k in ("good", "bad") for r in rules)
        rates = new
        if moved < enough:
            break
    return rates


def spoken(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """(row, m, v): the columns to carry in one struct, so that no name of theirs can clash, the counts and the votes."""
    held = docs.select((F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)).alias("row"), F.col(text).alias("__text"))
    return measure(held, "__text").drop("__text").withColumn("v", F.struct(*[c.alias(r) for r, c in votes().items()]))


def verdict(said: DataFrame, rates: dict, threshold: float) -> DataFrame:
    failed = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    out = said.withColumn("base_failed", failed).withColumn("quality", posterior(list(votes()), rates))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def vote_table(said: DataFrame) -> DataFrame:
    return stage(said.groupBy("v").agg(F.count(F.lit(1)).alias("n")))


def judge(docs: DataFrame, carry: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """row (struct of ``carry``), m, v, base_failed, quality (posterior) and kept for every row of ``docs``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated windows; such a text is never kept.
    Texts are measured once; votes and counts are staged.
    """
    said = stage(spoken(docs, text, carry))
    return verdict(said, fit(vote_table(said), list(votes())), threshold)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with its columns. Texts are measured twice rather than staged.

    The filter also reads a row number: below a number Spark pushes no filter, which would repeat the measures for each rule.
    """
    rates = fit(vote_table(spoken(docs, text, [])), list(votes()))
    held = spoken(docs, text, docs.columns).withColumn("at", F.monotonically_increasing_id())
    return verdict(held, rates, threshold).filter(F.col("kept") & (F.col("at") >= 0)).select("row.*")
