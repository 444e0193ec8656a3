"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each rule is a measure of a whole text, greater for worse ones. Per stratum and rule a cutoff is picked on labelled rows, none of which was used to make the measures: with n
good rows, of which k lie above a cutoff, the exact binomial probability P(Bin(n, risk) <= k) bounds the chance that the cutoff truly rejects more than ``risk`` of the good texts.
Cutoffs are tried from the most lenient on, and the last one is taken before the first that fails (a fixed sequence, which needs no correction of its own). The levels are
Bonferroni's: the stratum's allowed share of false rejections is divided by the number of rules, and the doubt by that of rules and strata. So with probability 1 - ``doubt`` in no stratum
more than ``risk`` of the good texts are rejected by all rules together. As this holds for all cutoffs at once, those may be left out afterwards that find few bad
texts: a rule is used in a stratum where it rejects a share of the labelled bad rows at least ``lift`` times that of the good ones. A stratum with too few good rows for
any bound has no cutoff, and its texts are held to the base rules alone.

Measures are compared in steps of a ``STEPS``-th, so that a stratum's rows are counted per step before they move. The bound presumes that labelled rows are like the others of their stratum.

Defined results: null and empty texts have no words and fail the base rules; a null stratum is a stratum; labels count where all rows of a doc_id agree and neither is null; documents that share a
doc_id each take its label; repeated rows each get a row; other columns are ignored; empty tables give an empty result or base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small

#: White space, and the symbols that are counted.
SPACE, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"
STEPS = 1000


def _divided(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rules() -> dict[str, Column]:
    """By name a measure of the counted columns, greater for worse texts; what exceeds 1 counts as 1."""
    col = F.col
    return {
        "symbols": _divided(col("n_symbols"), col("word_chars")),
        "capitals": _divided(col("n_capitals"), col("word_chars")),
        "exclamations": _divided(col("n_exclamations"), col("n_words")),
        "repeated_words": _divided(col("n_repeat_words"), col("n_words")),
        "repeated_lines": _divided(col("n_dup_lines"), col("n_lines")),
        "lone_symbols": _divided(col("n_lone"), col("n_words")),
    }


def measured(documents: DataFrame, *others: str) -> DataFrame:
    """Per row doc_id, the other columns, and what the rules count in the whole text."""
    text = F.coalesce("text", F.lit(""))
    df = documents.select("doc_id", *others, text.alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", f"[{SPACE}]+"), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda s: s.rlike(f"[^{SPACE}]")))
    starts = F.sequence(F.lit(1), F.size("words") - 2)
    window = lambda i: F.struct(F.concat_ws(" ", *(F.element_at("words", i + d) for d in range(3))).alias("w"), i.alias("i"))
    # equal windows are neighbours once sorted; a window that is found again is one whose neighbour is equal
    df = df.withColumn("sorted", F.when(F.size("words") >= 4, F.sort_array(F.transform(starts, window))))
    near = lambda k: F.get("sorted", k)["w"]
    again = F.filter(F.transform("sorted", lambda s, k: F.when((s["w"] == near(k - 1)) | (s["w"] == near(k + 1)), s["i"])), lambda i: i.isNotNull())
    df = df.withColumn("again", F.sort_array(again))
    # words covered: each start adds as many as there are up to the next one, three at most
    covered = F.aggregate(F.transform("again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    size = lambda pattern: F.char_length(F.regexp_replace("text", pattern, "")).cast("long")
    return df.select(
        "doc_id",
        *others,
        F.size("words").cast("long").alias("n_words"),
        size(f"[{SPACE}]+").alias("word_chars"),
        size(f"[^{SYMBOLS}]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        size(r"[^\p{Lu}]+").alias("n_capitals"),
        size("[^!]+").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_lone"),
    )


def _steps(names: list[str]) -> Column:
    """A row's measures as (rule, step)."""
    all_rules = rules()
    step = lambda m: F.floor(F.least(m, F.lit(1.0)) * STEPS).cast("int")
    return F.array(*(F.struct(F.lit(name).alias("rule"), step(all_rules[name]).alias("step")) for name in names))


def most_rejected(n: Column, risk: float, level: Column) -> Column:
    """The greatest k with P(Bin(n, risk) <= k) <= level; -1 if there is none. Sums exact probabilities, by their logarithms."""
    odds = risk / (1 - risk)
    begin = F.struct(F.lit(-1).cast("long").alias("k"), (n * F.log1p(F.lit(-risk))).alias("term"), (n * F.log1p(F.lit(-risk))).alias("total"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j) / (j + 1)) + F.log(F.lit(odds))
        high = F.greatest(s["total"], term)
        total = high + F.log(F.exp(s["total"] - high) + F.exp(term - high))
        return F.when(s["total"] <= F.log(level), F.struct(j.alias("k"), term.alias("term"), total.alias("total"))).otherwise(s)

    # far above the mean no k can pass
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk)), begin, step)["k"]


def known_quality(labels: DataFrame) -> DataFrame:
    """doc_id, good: where all label rows of a doc_id agree."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b"))
    return known.where("a = b").select("doc_id", (F.col("a") == 1).alias("good"))


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float, doubt: float, lift: float) -> DataFrame:
    """stratum, rule, cutoff (texts in steps above it are rejected), of rules in use; rows are measured(), with stratum."""
    names = list(rules())
    each = risk / len(names)
    seen = rows.join(known_quality(labels), "doc_id").select("stratum", "good", F.inline(_steps(names)))
    bins = durable(seen.groupBy("stratum", "rule", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    tests = max(1, bins.select("stratum", "rule").distinct().count())
    above = Window.partitionBy("stratum", "rule").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum", "rule")
    df = bins.withColumns({
        "good_above": F.coalesce(F.sum("good").over(above), F.lit(0)),
        "bad_above": F.coalesce(F.sum("bad").over(above), F.lit(0)),
        "n_good": F.sum("good").over(whole),
        "n_bad": F.sum("bad").over(whole),
    })
    allowed = df.select("n_good").distinct().withColumn("allowed", most_rejected(F.col("n_good"), each, F.lit(doubt / tests)))
    df = df.join(small(durable(allowed)), "n_good").where(F.col("good_above") <= F.col("allowed"))
    least = F.row_number().over(Window.partitionBy("stratum", "rule").orderBy("step"))
    worth = (F.col("bad_above") > 0) & (F.col("bad_above") * F.col("n_good") >= lift * F.col("good_above") * F.col("n_bad"))
    return df.withColumn("no", least).where((F.col("no") == 1) & worth).select("stratum", "rule", F.col("step").alias("cutoff"))


def judged(documents: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.03, doubt: float = 0.05, lift: float = 5.0) -> DataFrame:
    """Per row: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by (rules, comma-joined), kept."""
    rows = durable(measured(documents.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text"), "stratum"))
    cut = cutoffs(rows, labels, risk, doubt, lift).groupBy(F.col("stratum").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    df = rows.join(small(durable(cut)), F.col("stratum").eqNullSafe(F.col("of")), "left")
    failed = F.filter(_steps(list(rules())), lambda s: s["step"] > F.element_at("cuts", s["rule"]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumns({"base_failed": base, "rejected_by": F.coalesce(F.array_join(F.array_sort(F.transform(failed, lambda s: s["rule"])), ","), F.lit(""))})
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
    return df.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
