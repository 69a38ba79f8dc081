"""Mixing sources to target weights, by blocks of words and pseudorandom draws.

The words of a source, document after document, are cut into blocks of fixed length. The mix
is a list of slots, dealt to output shards of fixed size; for each shard the number of slots
of each source is a multinomial draw with the sources' shares. The k-th slot of a source maps
to its block at place k of a pseudorandom permutation (a new one for each pass over the
source), and slots meet blocks in an equi-join by source and block number.

Draws alone scatter around the shares, and could pass the limit of three times a source. So
each source has a quota of slots that adds up to all slots; what a source draws beyond its
quota goes, slot by slot, to the sources that drew less. Only that difference, about the square
root of all slots, changes hands.

All steps are DataFrame functions. A slot's source and a permutation follow from numbers alone,
so reruns and lost tasks give the same mix.

Targets: sources in order of code points, null last, weigh 1, 2, 3, 1, 2, 3, ...; they share
all words by weight, but none gets more than three times its own words; the excess goes to the
others by weight. (The share that fills all words is the largest of the shares that result
when the 0, 1, 2, ... sources lowest in words per weight are held at their limit.)

Defined cases: a null or empty text has no words and is never taken; a null source is a source of
its own, apart from the empty name; a source without words has target 0; repeated rows are
documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import staged
from ..session import settle
from .common import KEY, SPACE, WORD, once, row_key, running_total, shuffle_partitions, text_or_empty, whole_row

#: Words of a block, slots of an output shard.
BLOCK, SHARD = 64, 8192
WEIGHTS = (1, 2, 3)
#: How often the words of a source may be taken.
REPEATS = 3
#: Rounds of a permutation.
ROUNDS = 12

PRIME = 2147483647


def scatter(a: str, b: str) -> str:
    """SQL for a pseudorandom number from 0 to PRIME - 1 from two numbers."""
    t = f"((({a}) % {PRIME} * 1103515245 + ({b}) % {PRIME} * 69621 + 40014) % {PRIME})"
    return f"(({t} * {t} + 12345) % {PRIME} * 48271 % {PRIME})"


def permutation_keys(size: str, seed: str, rounds: int = ROUNDS) -> str:
    """SQL for the keys of the pseudorandom permutation ``seed`` of 0 to ``size`` - 1."""
    return (f"transform(sequence(1L, {rounds}L), r -> CAST(floor({scatter(seed, 'r')} / CAST({PRIME} AS DOUBLE) * {size}) "
            "AS BIGINT))")


def permuted(place: str, size: str, keys: str) -> str:
    """SQL for the place of ``place`` in the permutation of these keys.

    Swap-or-not rounds: a round pairs x with key - x and swaps the two or not by a
    pseudorandom bit of the pair, so it permutes any range without search.
    """
    other = f"((k - x + {size}) % {size})"
    bit = f"{scatter(f'greatest(x, {other})', 'k')} % 2"
    return f"aggregate({keys}, {place}, (x, k) -> CASE WHEN {bit} = 1 THEN {other} ELSE x END)"


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Id, source, row key and number of words of every row, written once."""
    return settle(docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), *row_key(id_column, text, source),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size")), "sizes")


def source_targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source: number, words, target, blocks and quota of slots, written once."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", w))
    low = Window.orderBy(F.expr(f"{REPEATS} * source_size / weight"), "number")
    upto, rest = low.rowsBetween(Window.unboundedPreceding, -1), low.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("per_weight", (
        F.sum("source_size").over(everything)
        - F.coalesce(F.sum(F.col("source_size") * REPEATS).over(upto), F.lit(0))).cast("double")
        / F.sum("weight").over(rest))
    rows = rows.withColumn("target", F.least(
        (F.col("source_size") * REPEATS).cast("double"), F.max("per_weight").over(everything) * F.col("weight")))
    rows = rows.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn(
        "quota", F.expr("coalesce(CAST(round(target * blocks / nullif(source_size, 0)) AS BIGINT), 0)"))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return settle(rows.withColumn("low", F.coalesce(F.sum("quota").over(before), F.lit(0))), "sources")


def drawn_blocks(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """The mix as slots: ``shard``, ``number`` of the source, ``pass`` over it and ``block``."""
    spark = sources.sparkSession
    slots, count = sources.agg(F.sum("quota"), F.count("*")).first()
    slots = slots or 0
    # draws: equal buckets of the unit interval meet the sources that reach into them
    buckets = max(1, 4 * count)
    shares = sources.where("quota > 0").selectExpr(
        "number", f"CAST(low AS DOUBLE) / {slots or 1} AS from_share", f"CAST(low + quota AS DOUBLE) / {slots or 1} AS to_share")
    shares = shares.withColumn("bucket", F.explode(F.expr(
        f"sequence(CAST(floor(from_share * {buckets}) AS BIGINT), CAST(floor(to_share * {buckets}) AS BIGINT))")))
    draw = spark.range(slots).selectExpr(f"id div {shard} AS shard", f"id % {shard} AS slot").selectExpr(
        "shard", f"{scatter('shard', 'slot')} / CAST({PRIME} AS DOUBLE) AS share").withColumn(
        "bucket", F.expr(f"CAST(floor(share * {buckets}) AS BIGINT)"))
    counts = settle(draw.join(shares, "bucket").where("share >= from_share AND share < to_share")
                    .groupBy("shard", "number").agg(F.count("*").alias("n")), "draws")
    # what goes beyond a quota ...
    placed = running_total(counts, ["number"], ["shard"], {"k": F.col("n")}).join(
        sources.select("number", "quota"), "number").withColumn(
        "used", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("k"))))
    placed = settle(placed.withColumn("over", F.col("n") - F.col("used")), "placed")
    surplus = placed.where("over > 0").select(F.lit(0).alias("all"), "shard", "number", "over")
    spare = running_total(surplus, ["all"], ["shard", "number"], {"at": F.col("over")})
    spare = spare.select("shard", F.explode(F.expr("sequence(at, at + over - 1)")).alias("at"))
    # ... goes to what is missing from others
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    missing = (sources.join(counts.groupBy("number").agg(F.sum("n").alias("drawn")), "number", "left")
               .selectExpr("number", "coalesce(drawn, 0) AS drawn", "quota - coalesce(drawn, 0) AS lack").where("lack > 0")
               .withColumn("start", F.coalesce(F.sum("lack").over(before), F.lit(0))))
    missing = missing.select("number", "drawn", "start", F.explode(F.expr("sequence(start, start + lack - 1)")).alias("at"))
    given = spare.join(missing, "at").selectExpr("shard", "number", "drawn + at - start AS k")
    # few narrow rows become all slots here: spread them over all tasks first
    kept = placed.where("used > 0").repartition(shuffle_partitions(spark), "shard", "number").select(
        "shard", "number", F.explode(F.expr("sequence(k, k + used - 1)")).alias("k"))
    # the keys of a permutation are worked out once for each pass over a source
    passes = sources.selectExpr("number", "blocks", f"explode(sequence(0L, {REPEATS - 1}L)) AS pass")
    passes = passes.withColumn("keys", F.expr(permutation_keys("blocks", "(number * 64 + pass)"))).drop("blocks")
    slots = kept.unionByName(given).join(sources.select("number", "blocks"), "number")
    slots = slots.selectExpr("shard", "number", "k div blocks AS pass", "k % blocks AS place", "blocks")
    return slots.join(passes, ["number", "pass"]).selectExpr(
        "shard", "number", "pass", f"{permuted('place', 'blocks', 'keys')} AS block")


def block_pieces(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every document with the parts of it (``begin``, ``words``) that lie in the blocks of its source.

    A document without words has one row without a block.
    """
    rows = running_total(sizes, ["source"], ["id", *KEY, "size"], {"start": F.col("size"), "row": F.lit(1)})
    named = sources.select(F.col("source").alias("name"), "number", "source_size", "target")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    blocks = F.expr(f"CASE WHEN size > 0 THEN sequence(start div {block}, (start + size - 1) div {block}) END")
    rows = rows.withColumn("block", F.explode_outer(blocks))
    return rows.withColumn("begin", F.expr(f"greatest(start, block * {block}) - start")).withColumn(
        "words", F.expr(f"least(start + size, (block + 1) * {block}) - start - begin"))


_ROW = ["number", "row", "id", *KEY, "size", "source_size", "target"]


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
        block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``."""
    sizes = word_counts(docs, id_column, text, source)
    sources = source_targets(sizes, block)
    times = drawn_blocks(sources, shard).groupBy("number", "block").agg(F.count("*").alias("times"))
    pieces = block_pieces(sizes, sources, block).join(times, ["number", "block"], "left")
    return pieces.groupBy(*_ROW).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken")).select(
        F.col("id").alias(id_column), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
                  block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as documents: for each pass that takes words of a row, the row with those words.

    Words keep the white space before them; a row that is taken whole keeps its whole text.
    """
    sizes = word_counts(docs, id_column, text, source)
    sources = source_targets(sizes, block)
    times = drawn_blocks(sources, shard).groupBy("number", "block").agg(F.collect_set("pass").alias("passes"))
    parts = block_pieces(sizes, sources, block).join(times, ["number", "block"]).withColumn("pass", F.explode("passes"))
    spans = parts.groupBy(*_ROW, "pass").agg(
        F.sort_array(F.collect_list(F.struct("begin", "words"))).alias("spans"), F.sum("words").alias("taken"))
    keyed = once(docs.select(whole_row(docs), *row_key(id_column, text, source)))
    found = spans.select(*KEY, "spans", (F.col("taken") == F.col("size")).alias("whole")).join(keyed, KEY)
    body = f"_row.`{text}`"
    # a text is parted once, not again for each of its spans
    found = staged(found, {"parts": f"CASE WHEN NOT whole THEN regexp_extract_all({body}, r'{SPACE}*{WORD}', 0) END"})
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(
        "parts", (s["begin"] + 1).cast("int"), s["words"].cast("int")))), "")
    new = F.when(F.col("whole"), F.col(body)).otherwise(F.regexp_replace(cut, f"^{SPACE}+", ""))
    return found.withColumn("_text", new).select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
