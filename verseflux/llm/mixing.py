"""Mixing sources to target weights, in DataFrame operations only.

1. The words of a source form one stream: documents in a fixed order, packed into blocks of
   ``block`` words (the last one shorter). Where a document begins in its stream is a running
   total in two levels, so that no task orders a whole source.
2. A source's target words are a number of slots, one block each; a source is read in rounds,
   every block once a round, at most ``CEILING`` rounds.
3. Each output shard draws the sources of its slots, so its source counts are multinomial; what
   a source lacks after these draws fills the last shards, and what was drawn beyond its slots
   is void. A source's slots are numbered in the order of the shards.
4. Slot number -> round and index in the round -> block, through a permutation of the source's
   blocks; blocks are joined by that index. The last slot is cut to the words still lacking.

Only the table of sources (one row each) is ever ordered as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseflux.lineage import cut_lineage
from verseflux.llm.common import id_or_last

BLOCK_WORDS = 64
SHARD_SLOTS = 256
#: How often a source is repeated at most.
CEILING = 3
#: Share of the slots that fills up what the draws left open.
OPEN_SHARE = 1 / 16
#: Places of the guide table from drawn numbers to sources.
GUIDE = 4096
_DRAW = 1 << 40
#: Multipliers of the index permutations: primes beyond every prime factor that matters; a
#: source takes the first one from its own place on that does not divide its number of blocks.
_PRIMES = (1048573, 1048571, 1048559, 1048549)
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(column: str):
    return F.coalesce(F.expr(f"regexp_count(`{column}`, r'{WORD}')").cast("long"), F.lit(0).cast("long"))


def _in_parts(df: DataFrame, keys: list[str], part: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before this one, by (part, order) per keys."""
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = df.groupBy(*keys, part).agg(F.sum(value).alias("__sum"))
    parts = parts.select(*keys, part, F.coalesce(F.sum("__sum").over(across), zero).alias("__base"))
    rows = df.withColumn("__in", F.coalesce(F.sum(value).over(inside), zero))
    return rows.join(parts, [*keys, part]).withColumn(out, F.col("__base") + F.col("__in")).drop("__base", "__in")


def source_plan(sizes: DataFrame, block: int, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: number, size, target, blocks, and how its slots are read."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "no")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("no", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * CEILING).withColumn("room", F.col("most") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy())
    # If all sources with less room stop at their ceiling, this is left for the others' weights.
    s = s.withColumn("left", total - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(after))
    s = s.withColumn("fits", F.col("left") * F.lit(1.0) <= F.col("room") * F.col("open"))
    first = F.min(F.when(F.col("fits"), F.struct("room", "no", "left", "open"))).over(Window.partitionBy())
    s = s.withColumn("first", first)
    free = F.struct("room", "no") >= F.struct("first.room", "first.no")
    share = F.col("first.left").cast("double") * F.col("weight") / F.col("first.open")
    s = s.withColumn("target", F.coalesce(F.when(free, F.least(share, F.col("most").cast("double"))), F.col("most").cast("double")))
    s = s.withColumn("words", F.least(F.round("target").cast("long"), F.col("most")))
    s = s.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    primes = F.array(*map(F.lit, _PRIMES))
    fit = F.filter(primes, lambda p: F.col("blocks") % p != 0)
    s = s.withColumn("mul", F.when(F.col("blocks") > 0, F.element_at(fit, (F.col("no") % F.size(fit) + 1).cast("int"))))
    s = s.withColumn("add", F.when(F.col("blocks") > 0, (F.col("no") * 7919 + 104729) % F.col("blocks")))
    s = s.withColumn("tail", F.expr(f"source_size - (blocks - 1) * {block}"))
    s = s.withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
    s = s.withColumn("rest", F.col("words") - F.col("rounds") * F.col("source_size"))
    s = s.withColumn("tail_at", F.expr("((blocks - 1) * mul + add) % blocks"))
    full = F.expr(f"(rest + {block - 1}) div {block}")
    longer = F.expr(f"(rest + {block} - tail + {block - 1}) div {block}")
    s = s.withColumn("rest_slots", F.when(F.col("rest") <= 0, 0).when(F.col("tail_at") >= full, full).otherwise(longer))
    s = s.withColumn("slots", F.coalesce(F.col("rounds") * F.col("blocks") + F.col("rest_slots"), F.lit(0)))
    read = F.expr(f"rest_slots * {block} - if(tail_at < rest_slots, {block} - tail, 0)")
    s = s.withColumn("cut", F.when(F.col("rest") > 0, read - F.col("rest")).otherwise(0))
    names = ["source", "no", "source_size", "target", "blocks", "mul", "add", "tail", "slots", "cut"]
    return s.select(*[F.col(n).cast("double" if n == "target" else "long").alias(n) if n != "source" else F.col(n) for n in names])


def per_source(sources: DataFrame) -> DataFrame:
    """A table with a row or few per source, for a join: broadcast if it is small, which is
    checked. Left to the planner, the other side may look small before its rows are made."""
    return F.broadcast(sources) if sources.count() <= 20_000 else sources.hint("merge")


def shard_slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(no, number, shard): every slot of every source once, dealt to output shards."""
    spark = sources.sparkSession
    upto = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("slots").over(Window.partitionBy())
    bound = F.sum("slots").over(upto)
    lots = sources.where("slots > 0").select(
        "no",
        F.floor((bound - F.col("slots")) / total * _DRAW).alias("low"),
        F.floor(bound / total * _DRAW).alias("high"),
    )
    place = F.explode(F.sequence(F.expr(f"low div {_DRAW // GUIDE}"), F.expr(f"(high - 1) div {_DRAW // GUIDE}")))
    guide = lots.where("high > low").withColumn("place", place)
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = max(0, int(n * (1 - OPEN_SHARE)) // shard_slots)
    drawn = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(shard_slots - 1))).alias("slot"))
    drawn = drawn.withColumn("u", F.pmod(F.xxhash64("shard", "slot", F.lit(seed)), F.lit(_DRAW)))
    drawn = drawn.withColumn("place", F.expr(f"u div {_DRAW // GUIDE}"))
    counts = drawn.join(per_source(guide), "place").where("u >= low AND u < high").groupBy("no", "shard").agg(F.count("*").alias("n"))
    step = max(1, math.isqrt(shards))
    counts = cut_lineage(counts.withColumn("part", F.expr(f"shard div {step}")))
    numbered = _in_parts(counts, ["no"], "part", ["shard"], "n", "start")
    taken = numbered.select("no", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("number"))
    met = counts.groupBy("no").agg(F.sum("n").alias("met"))
    limits = sources.select("no", "slots").where("slots > 0")
    taken = taken.join(per_source(limits), "no").where("number < slots").select("no", "number", "shard")
    lacking = limits.join(met, "no", "left").withColumn("from", F.coalesce("met", F.lit(0).cast("long"))).where("slots > from")
    lacking = lacking.withColumn("run", F.explode(F.expr(f"sequence(0, (slots - from - 1) div {shard_slots})")))
    number = F.explode(F.expr(f"sequence(from + run * {shard_slots}, least(slots, from + (run + 1) * {shard_slots}) - 1)"))
    rest = lacking.withColumn("number", number)
    extra = F.lit(shards) + F.pmod(F.xxhash64("no", "number", F.lit(seed)), F.lit(max(1, math.ceil((n - shards * shard_slots) / shard_slots))))
    return taken.unionByName(rest.select("no", "number", extra.alias("shard")))


def mix_pieces(
    df: DataFrame,
    key: list[str],
    size: str = "size",
    block: int = BLOCK_WORDS,
    slots_per_shard: int = SHARD_SLOTS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's plan, and every piece that the mix takes of them.

    ``df`` has ``source``, a size in words and ``key`` columns; ``key[0]`` is a long. The
    documents get ``row`` (their own number of (source, start)); pieces have ``no``, ``start``,
    ``round`` (how many times the source was read through before), ``first`` (word of the
    document), ``words`` and ``shard``.
    """
    docs = cut_lineage(df.select(*key, "source", F.col(size).cast("long").alias("size")))
    rows = docs.count()
    sources = cut_lineage(source_plan(docs, block))
    places = 2 * math.isqrt(rows) + 1
    docs = docs.join(per_source(sources), docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    docs = docs.withColumn("part", F.pmod(F.col(key[0]), F.lit(places)))
    docs = _in_parts(docs, ["no"], "part", [*key, "size"], "size", "start")
    docs = cut_lineage(docs)
    spread = docs.where("size > 0").select(
        "no", "start", "size", "blocks", "mul", "add", "tail",
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"),
    )
    spread = spread.select(
        "no",
        "start",
        F.expr("(block * mul + add) % blocks").alias("index"),
        F.expr(f"greatest(start - block * {block}, 0)").alias("low"),
        F.expr(f"least(start + size - block * {block}, {block})").alias("high"),
        F.expr(f"block * {block} - start").alias("shift"),
        F.expr(f"if(block = blocks - 1, tail, {block})").alias("length"),
    )
    slots = shard_slots(sources, slots_per_shard, seed)
    rounds = sources.select(F.col("no").alias("no"), F.col("blocks").alias("n_blocks"), F.col("slots").alias("n_slots"), F.col("cut").alias("n_cut"))
    slots = slots.join(per_source(rounds), "no").select(
        "no",
        "shard",
        F.expr("number % n_blocks").alias("index"),
        F.expr("number div n_blocks").alias("round"),
        F.expr("if(number = n_slots - 1, n_cut, 0)").alias("cut"),
    )
    # Both sides grow with the input; their sizes before the rows are made say nothing.
    pieces = spread.hint("merge").join(slots, ["no", "index"])
    words = F.expr("least(high, length - cut) - low")
    pieces = pieces.withColumn("words", words).where("words > 0")
    return docs, pieces.select("no", "start", "round", F.expr("shift + low").alias("first"), "words", "shard")


def mix_sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``size``, ``source_size``, ``target`` and ``taken``
    (words that the mix takes, repeats counted).

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the words of
    all documents; a source stops at three times its own, and the excess goes to the others by
    weight. A null text has no words; documents without words take nothing, and so do all
    documents if none has words. Rows that repeat an id are documents of their own. A null id
    comes last in its stream. An empty table gives an empty one; other columns are not read.
    """
    sized = df.select(
        id_or_last(id_col).alias("__key"),
        F.col(id_col).alias(id_col),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_col).alias("size"),
    )
    docs, pieces = mix_pieces(sized, ["__key", id_col])
    taken = pieces.groupBy("no", "start").agg(F.sum("words").alias("taken"))
    # Documents without words share the start of the next one.
    some = docs.withColumn("__start", F.when(F.col("size") > 0, F.col("start")))
    taken = taken.select(F.col("no").alias("__no"), F.col("start").alias("__at"), "taken")
    joined = some.join(taken, (F.col("no") == F.col("__no")) & (F.col("__start") == F.col("__at")), "left")
    return joined.select(
        id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mix_documents(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str | None = "n_chars"
) -> DataFrame:
    """The mix itself, in the columns of ``df``: a row for every document and round of its
    source, with the words that the mix takes of it in this round, in their order and with the
    white space after each; a text that is taken whole stays as it is. ``chars_col`` is counted
    anew where the text changes.

    Documents that take nothing are gone; sources, targets, nulls, ties and repeated rows are
    treated as in ``mix_sizes``.
    """
    marked = df.withColumn("__key", id_or_last(id_col)).withColumn("__hash", F.xxhash64(text_col))
    sized = marked.select("__key", "__hash", F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    docs, pieces = mix_pieces(sized, ["__key", "__hash"])
    taken = pieces.groupBy(F.col("no").alias("__no"), F.col("start").alias("__at"), "round").agg(
        F.sort_array(F.collect_list(F.struct("first", "words"))).alias("__ranges"), F.sum("words").alias("__words")
    )
    some = docs.where("size > 0").select("no", "start", "size", F.col("__key").alias("__k"), F.col("__hash").alias("__h"))
    copies = some.join(taken, (F.col("no") == F.col("__no")) & (F.col("start") == F.col("__at")))
    copies = copies.select("__k", "__h", F.col("size").alias("__size"), "__ranges", "__words")
    # Equal rows are taken from each on its own; one row with their text is enough to join.
    marked = marked.dropDuplicates(["__key", "__hash"])
    met = marked.join(copies, (F.col("__key") == F.col("__k")) & (F.col("__hash") == F.col("__h")))
    words = f"regexp_extract_all(`{text_col}`, r'{WORD}[\\x20\\x09-\\x0D]*', 0)"
    part = f"array_join(flatten(transform(__ranges, x -> slice({words}, CAST(x.first + 1 AS INT), CAST(x.words AS INT)))), '')"
    whole = F.col("__words") == F.col("__size")
    met = met.withColumn("__text", F.when(whole, F.col(text_col)).otherwise(F.expr(part)))
    out = [F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if chars_col in df.columns:
        kind = df.schema[chars_col].dataType
        count = F.when(whole, F.col(chars_col)).otherwise(F.length("__text")).cast(kind)
        out = [count.alias(c) if c == chars_col else x for c, x in zip(df.columns, out, strict=True)]
    return met.select(*out)
