"""Quality rules whose cutoffs are chosen by exact binomial bounds, in DataFrame operations only.

Every rule is a ratio; a document is rejected where one exceeds its cutoff. Cutoffs are learned
and then tested, per stratum (language):

1. Documents that are not held out give a ladder of steps. On step ``i`` each rule has the
   smallest cutoff of a fixed grid that at most ``i`` / ``STEP`` of these documents exceed, so
   all rules tighten together.
2. The held-out documents, labelled as of good quality and past the fixed base rules, test the
   steps from the loosest on: a step passes if so few false rejections, by all rules together,
   or fewer, have a binomial probability of at most ``error`` / strata at the limit ``risk``.
   The last step before the first that fails gives the cutoffs.

A sequence in a fixed order that ends with its first failure needs no correction for its length,
and strata are corrected for by Bonferroni. So with probability 1 - ``error`` no stratum loses
more than ``risk`` of its good documents to the rules. Where no step passes, for instance in a
stratum with few labels, the rules reject nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseflux.functions.once import compute_once
from verseflux.lineage import cut_lineage
from verseflux.llm.common import SPACES, without

_SPACE = SPACES.decode()
_INDEX = (1 << 31) - 1
GRID = [(i / 24) ** 2 for i in range(25)]
RULES = ["symbols", "dup_lines", "repeats", "capitals", "long_words"]
#: Limit of false rejections per stratum by all rules, and the error probability of all limits.
RISK = 0.03
ERROR = 0.05
#: Steps of the ladder, and the share of documents per step and rule as a fraction.
STEPS = 41
STEP = 400
#: Terms of a binomial sum that are added one by one; what follows is bounded by a geometric
#: series, which can only make a test stricter.
TERMS = 4000


def _neighbours_equal(rows: str, column: str) -> Column:
    """Members of a sorted array of (hash bits, index) whose hash bits a neighbour shares."""
    return F.expr(
        f"filter({rows}, (x, i) -> (i > 0 AND shiftright(x, 31) = shiftright({column}[greatest(i - 1, 0)], 31))"
        f" OR (i + 1 < size({column}) AND shiftright(x, 31) = shiftright({column}[least(i + 1, size({column}) - 1)], 31)))"
    )


def signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the base columns of the whole text and ``capitals`` and ``n_lines``.

    Windows of three words are compared by hash bits: sorted numbers of 33 bits and place find
    the windows that may be repeated, and other 33 bits decide among those; sorts of plain
    numbers only, so a long or repetitive text costs n log n.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "capitals", "n_lines"]
    text = F.coalesce(F.col("__text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    length = F.length(text)
    df = df.withColumn("__text", F.col(text_col))
    df = without(df, made)
    df = compute_once(
        df,
        __words=words,
        __lines=lines,
        n_symbols=(length - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        capitals=(length - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long"),
    ).drop("__text")

    def packed(seed: int, places: str) -> Column:
        hashed = f"xxhash64({seed}, __words[i - 1], __words[i], __words[i + 1])"
        return F.expr(f"sort_array(transform({places}, i -> ({hashed} & ~{_INDEX}L) | CAST(i AS BIGINT)))")

    every = "if(size(__words) < 3, CAST(array() AS array<int>), sequence(1, size(__words) - 2))"
    df = compute_once(df, __sorted=packed(1, every))
    maybe = F.transform(_neighbours_equal("__sorted", "__sorted"), lambda x: x.bitwiseAND(_INDEX).cast("int"))
    df = compute_once(df, __maybe=maybe).drop("__sorted")
    df = compute_once(df, __again=packed(2, "__maybe")).drop("__maybe")
    places = F.transform(_neighbours_equal("__again", "__again"), lambda x: x.bitwiseAND(_INDEX).cast("int"))
    # Windows at i - 1 .. i + 1 in order; each adds the words that the one before has not.
    covered = F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(0).alias("n"), F.lit(-10).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    df = df.withColumn("n_repeat_words", covered)
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    chars = F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    df = df.withColumn("word_chars", chars).withColumn("n_lines", F.size("__lines").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    return df.drop("__words", "__lines", "__again")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "capitals": F.col("capitals") / chars,
        "long_words": F.col("word_chars") / (words * 32),
    }


def _log_factorial(n: str) -> str:
    """By a table up to 20 and by Stirling's series beyond, to some 1e-12."""
    x = f"({n} + 1.0D)"
    series = (
        f"({x} - 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + 1.0D / (12 * {x})"
        f" - 1.0D / (360 * {x} * {x} * {x}) + 1.0D / (1260 * {x} * {x} * {x} * {x} * {x})"
    )
    return f"(CASE WHEN {n} <= 20 THEN ln(CAST(factorial(CAST({n} AS INT)) AS DOUBLE)) ELSE {series} END)"


def log_binomial_tail(k: str, n: str, p: float) -> Column:
    """ln P(X <= k) of n trials with probability p, for k < n p; never too small."""
    odds = repr((1 - p) / p)
    top = (
        f"{_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')}"
        f" + {k} * {math.log(p)!r}D + ({n} - {k}) * {math.log1p(-p)!r}D"
    )
    total = (
        f"aggregate(sequence(0, CAST(least({k}, {TERMS}) AS INT)), struct(0.0D AS s, 1.0D AS t),"
        f" (a, i) -> struct(a.s + a.t AS s, a.t * ({k} - i) / ({n} - {k} + i + 1.0D) * {odds}D AS t),"
        f" a -> a.s + CASE WHEN {k} > {TERMS} THEN a.t / (1 - {k} / ({n} - {k} + 1.0D) * {odds}D) ELSE 0.0D END)"
    )
    return F.expr(f"{top} + ln({total})")


def _counted(docs: DataFrame) -> DataFrame:
    """Documents by ``stratum``, ``rule`` and ``below``, the number of cutoffs that the ratio exceeds."""
    below = [F.struct(F.lit(r).alias("rule"), _below(r).alias("below")) for r in RULES]
    return docs.select("stratum", F.inline(F.array(*below))).groupBy("stratum", "rule", "below").agg(F.count("*").alias("docs"))


def _below(column: str) -> Column:
    text = "array(" + ", ".join(f"{g!r}D" for g in GRID) + ")"
    return F.expr(f"size(filter({text}, g -> g < {column}))")


def ladder(good: DataFrame, everyone: DataFrame) -> DataFrame:
    """``stratum`` and ``steps``, an array of structs: the ``step`` and a place in the grid for
    each rule (null: no cutoff is exceeded by few enough).

    ``everyone`` holds the rows of ``good`` too; only the others count.
    """
    signed = _counted(everyone).unionByName(_counted(good).withColumn("docs", -F.col("docs")))
    others = signed.groupBy("stratum", "rule", "below").agg(F.sum("docs").alias("docs"))
    # At most strata x rules x grid rows from here on.
    lists = others.groupBy("stratum", "rule").agg(
        F.sum("docs").alias("n"), F.collect_list(F.struct("below", "docs")).alias("cells")
    )
    tails = lists.select(
        "stratum", "rule", "n",
        F.expr(
            f"transform(sequence(0, {len(GRID) - 1}), p -> aggregate(cells, 0L, (a, c) -> a + if(c.below > p, c.docs, 0L)))"
        ).alias("tails"),
    ).where("n > 0")
    # Tails fall with the place: the first that is small enough is the smallest cutoff.
    few = f"filter(sequence(0, {len(GRID) - 1}), p -> {STEP} * tails[p] <= step * n)"
    places = tails.select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"), "tails", "n")
    places = places.select("stratum", "rule", "step", F.expr(f"get({few}, 0)").alias("place"))
    wide = places.groupBy("stratum", "step").agg(*[F.min(F.when(F.col("rule") == r, F.col("place"))).alias(r) for r in RULES])
    return wide.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("step", *RULES))).alias("steps"))


def choose_cutoffs(good: DataFrame, everyone: DataFrame, risk: float, error: float) -> DataFrame:
    """``stratum`` and a column per rule with its cutoff (null: rejects nothing).

    ``good``: one row per held-out good document with ``stratum`` and the rules' ratios.
    ``everyone``: the same columns for all documents, those of ``good`` among them.
    """
    steps = cut_lineage(ladder(good, everyone).withColumnRenamed("stratum", "__stratum"))  # a row per stratum
    placed = good.select("stratum", *[_below(r).alias(f"__{r}") for r in RULES])
    met = placed.join(steps, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    # Steps tighten, so a document that a step rejects is rejected by those after it too.
    rejects = " OR ".join(f"coalesce(__{r} > s.{r}, false)" for r in RULES)
    met = met.select("stratum", F.coalesce(F.expr(f"size(filter(steps, s -> NOT ({rejects})))"), F.lit(0)).alias("survived"))
    counted = cut_lineage(met.groupBy("stratum", "survived").agg(F.count("*").alias("docs")))
    strata = counted.select("stratum").distinct().count()
    lists = counted.groupBy("stratum").agg(
        F.sum("docs").alias("n"), F.collect_list(F.struct("survived", "docs")).alias("cells")
    )
    tests = lists.select("stratum", "n", "cells", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    false = "aggregate(cells, 0L, (a, c) -> a + if(c.survived <= step, c.docs, 0L))"
    tests = tests.select("stratum", "n", "step", F.expr(false).alias("k"))
    # False rejections rise along the ladder, so the steps that pass are those before the first failure.
    passed = tests.where(F.col("k") < F.col("n") * F.lit(risk))
    passed = passed.where(log_binomial_tail("k", "n", risk) <= math.log(error / max(1, strata)))
    last = passed.groupBy("stratum").agg(F.max("step").alias("last"))
    chosen = last.join(steps, F.col("stratum").eqNullSafe(F.col("__stratum"))).withColumn("__at", F.expr("steps[last]"))
    grid = F.array(*map(F.lit, GRID))
    return chosen.select("stratum", *[F.get(grid, F.col(f"__at.{r}")).alias(f"cut_{r}") for r in RULES])


def quality_filter(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """One row per document: the id, ``n_words``, the base columns, ``base_failed``, ``kept``,
    ``stratum`` and the cutoffs of its stratum.

    ``labels`` has the id and ``quality`` (1: good); a document with several labels counts once,
    as good if all say so; rows that repeat an id count as labelled documents each. Null and
    empty texts have no words and fail the base rules. A null stratum is a stratum of its own.
    Without labels, or without documents that are not held out, no rule rejects. An empty table gives an empty one; other columns of ``df``
    are not read.
    """
    plain = df.select(F.col(id_col).alias("__id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("__body"))
    own = signals(plain, "__body").drop("__body").withColumn("base_failed", base_failed())
    own = cut_lineage(own.withColumns({f"ratio_{name}": value for name, value in ratios().items()}))
    known = labels.groupBy(F.col(id_col).alias("__doc")).agg(F.min("quality").alias("quality")).where("quality = 1")
    past = own.where("NOT base_failed").select("__id", "stratum", *[F.col(f"ratio_{r}").alias(r) for r in RULES])
    good = past.join(known, F.col("__id") == F.col("__doc"))
    cutoffs = choose_cutoffs(good, past, risk, error)
    cutoffs = cutoffs.withColumnRenamed("stratum", "__stratum")
    judged = own.join(cutoffs, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(f"ratio_{r}") > F.col(f"cut_{r}"), F.lit(False))
    return judged.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "stratum", *[f"cut_{r}" for r in RULES],
    )

