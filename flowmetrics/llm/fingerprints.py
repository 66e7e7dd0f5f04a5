"""Document fingerprints as invertible Bloom lookup sketches, in Spark SQL functions only.

A text is cut into paragraphs: lines, longer ones also behind about ``UNIT`` characters. The digest of every distinct
paragraph is added to one cell of each of three tables; a cell holds a count, the exclusive or of its digests and the
exclusive or of their checks. Two sketches of equal size subtract cell by cell, so digests of both texts cancel. What
is left is peeled: a cell with count 1 or -1 and a fitting check holds one digest, which is taken out of its three
cells, and so on. If cells remain, the pair is tried again with a sketch of twice the size. Likeness is
``1 - differing digests / digests of both``.

``fingerprint`` shows a sketch of fixed size (four cells a table) behind a hash of the text, so equal texts have equal
fingerprints; it decodes a few differences, larger comparisons use sketches sized by the two texts.

Null texts count as empty; two empty texts have likeness 1. Null keys are a key of their own, the last in order.
Repeated keys keep their rows; the next document of each is the smallest text of the next key. Only key and text are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmetrics.llm.common import parts_for, small
from flowmetrics.session import settle

UNIT = 48
#: A paragraph: up to UNIT characters of a line, then on to the end of a sentence, a line, or UNIT more characters.
PARAGRAPH = rf"(?=[\s\S])[^\n]{{0,{UNIT}}}[^\n.!?]{{0,{UNIT}}}[.!?]*\n*"
SHOWN = 4
SMALL_ROWS = 200_000


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell(digest: Column, table: int, size: Column, seed: int) -> Column:
    return F.lit(table) * size + F.pmod(F.xxhash64(digest, F.lit(table), F.lit(seed)), size)


def fingerprint(text: Column, held: Column) -> Column:
    """The sketch of fixed size as hexadecimal text: per cell count, digests and checks."""

    def shown(i: int) -> Column:
        own = F.filter(held, lambda d: _cell(d, i // SHOWN, F.lit(SHOWN), 0) == i)
        both = F.aggregate(own, F.lit(0).cast("long"), lambda x, d: x.bitwiseXOR(d)), F.aggregate(own, F.lit(0).cast("long"), lambda x, d: x.bitwiseXOR(F.hash(d).cast("long")))
        return F.concat_ws(".", F.hex(F.size(own)), F.hex(both[0]), F.hex(both[1]))

    return F.concat_ws("-", F.hex(F.xxhash64(text)), *[shown(i) for i in range(3 * SHOWN)])


def differing(pairs: DataFrame, by: list[str], left: str, right: str, growth: int = 1, steps: int = 12) -> DataFrame:
    """Per pair ``by``: ``held`` (digests of both arrays), ``recovered`` (differing ones), ``whole`` (nothing is left).

    Each step peels one table, in which a digest has one cell only, and adds the take-outs as rows, so a step is one
    expansion and one hash aggregation; if ``pairs`` is partitioned by columns of ``by`` nothing is shuffled.
    """
    held = F.size(left) + F.size(right)
    signed = F.concat(
        F.transform(left, lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))), F.transform(right, lambda d: F.struct(d.alias("d"), F.lit(-1).alias("n"))),
        F.array(F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).alias("n"))),
    )
    rows = pairs.select(*by, held.alias("held"), (F.greatest(held, F.lit(8)) * growth).cast("long").alias("size"), F.explode(signed).alias("x"))
    size, mark = F.col("size"), F.lit(-1).cast("long")
    spread = F.when(F.col("x.n") == 0, F.array(mark)).otherwise(F.array(*[_cell(F.col("x.d"), t, size, growth) for t in range(3)]))
    cells = rows.select(*by, "held", "size", "x", F.explode(spread).alias("cell"))
    check = F.when(F.col("x.n") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("x.d"))
    cells = cells.select(*by, "held", "size", "cell", F.col("x.n").cast("long").alias("n"), F.col("x.d").alias("d"), check.alias("c"))

    def summed(df: DataFrame) -> DataFrame:
        added = df.groupBy(*by, "held", "size", "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
        return added.where("cell < 0 or n <> 0 or d <> 0 or c <> 0")

    cells = summed(cells)
    for step in range(steps):
        table = step % 3
        pure = (F.col("cell") >= size * table) & (F.col("cell") < size * (table + 1)) & F.col("n").isin(1, -1) & (F.xxhash64("d") == F.col("c"))

        def row(cell: Column, n: Column, d: Column, c: Column) -> Column:
            return F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), d.cast("long").alias("d"), c.cast("long").alias("c"))

        same = row(F.col("cell"), F.col("n"), F.col("d"), F.col("c"))
        taken = [row(_cell(F.col("d"), t, size, growth), -F.col("n"), F.col("d"), F.col("c")) for t in range(3) if t != table]
        found = row(mark, F.lit(1), F.lit(0), F.lit(0))
        cells = cells.select(*by, "held", "size", F.explode(F.when(pure, F.array(*taken, found)).otherwise(F.array(same))).alias("y"))
        cells = summed(cells.select(*by, "held", "size", "y.*"))
    left_over = F.sum(F.when(F.col("cell") >= 0, 1).otherwise(0))
    recovered = F.sum(F.when(F.col("cell") < 0, F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(F.max("held").alias("held"), recovered.alias("recovered"), (left_over == 0).alias("whole"))


def next_keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``owner, next, owner_chars``: every key with the one before it in falling order; the first follows the last.

    ``owner`` and ``next`` are structs of the key, so that a null key joins too. Written once, one row per key.
    """
    spark = docs.sparkSession
    keys = docs.select(F.struct(F.col(f"`{key}`").alias("key")).alias("owner"), F.char_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("chars"))
    keys = settle(keys.groupBy("owner").agg(F.max("chars").alias("owner_chars")))
    falling = F.col("owner.key").desc_nulls_last()
    ranged = keys.repartitionByRange(parts_for(spark, keys.count(), 100_000), falling).withColumn("part", F.spark_partition_id())
    ranged = settle(ranged)
    inside = ranged.withColumn("next", F.lead("owner").over(Window.partitionBy("part").orderBy(falling)))
    heads = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(falling))).where("at = 1").select("part", F.col("owner").alias("head"))
    parts = Window.orderBy("part")
    around = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(around)).alias("follow"))
    linked = inside.join(follow, "part")
    return settle(linked.select("owner", F.coalesce("next", "follow").alias("next"), "owner_chars"))


def compare_with_edit_and_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_units``.

    The edited text has its last third replaced by the beginning of the next document in falling key order.
    """
    links = next_keys(docs, key, text)
    source = docs.select(F.struct(F.col(f"`{key}`").alias("key")).alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def pairs(source: DataFrame, links: DataFrame) -> DataFrame:
        """Rows with ``text``, ``edited`` and their digests and those of the next document, partitioned by ``k``."""
        known = source.join(links.withColumnRenamed("next", "k"), "k", "left")
        known = known.withColumn("copy", F.row_number().over(Window.partitionBy("k").orderBy("text")))
        third = F.floor(F.col("owner_chars") / 3).cast("int")
        following = known.where("copy = 1 and owner is not null").select(F.col("owner").alias("k"), F.substring(F.col("text"), F.lit(1), third).alias("head"), digests(F.col("text")).alias("following"))
        both = known.select("k", "copy", "text").join(following, "k")
        chars = F.char_length("text")
        cut = F.floor(chars / 3).cast("int")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - cut), F.substring(F.col("head"), F.lit(1), cut))
        both = both.withColumn("edited", edited)
        return both.select("k", "copy", "text", "edited", "following", digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"))

    def likeness(rows: DataFrame, growth: int) -> DataFrame:
        each = rows.select("k", "copy", F.explode(F.array(F.struct(F.lit(True).alias("edit"), F.col("own"), F.col("changed").alias("other")), F.struct(F.lit(False).alias("edit"), F.col("own"), F.col("following").alias("other")))).alias("p"))
        each = each.select("k", "copy", "p.edit", "p.own", "p.other")
        found = differing(each, ["k", "copy", "edit"], "own", "other", growth)
        near = F.when(F.col("held") == 0, 1.0).otherwise(1 - F.col("recovered") / F.col("held"))
        of = [F.max(F.when(F.col("edit") == e, near)).alias(n) for e, n in ((True, "near_edited"), (False, "near_next"))]
        return found.groupBy("k", "copy").agg(*of, F.min("whole").alias("whole"))

    rows = pairs(source, links)
    shown = rows.select(
        "k", "copy", F.char_length("text").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("changed")).alias("edited_fingerprint"), F.size("following").alias("next_units"),
    )
    done = settle(shown.join(likeness(rows, 1), ["k", "copy"]))
    result, open_rows, growth = done.where("whole"), done.where("not whole"), 1
    while not open_rows.isEmpty():
        growth *= 2
        owners = open_rows.select(F.col("k").alias("owner")).distinct()
        needed = settle(links.join(owners, "owner", "left_semi"))
        keys = settle(needed.select(F.explode(F.array("owner", "next")).alias("k")).distinct())
        again = likeness(pairs(source.join(small(keys, SMALL_ROWS), "k", "left_semi"), needed), growth)
        retried = settle(open_rows.drop("near_edited", "near_next", "whole").join(again, ["k", "copy"]))
        result, open_rows = result.unionByName(retried.where("whole")), retried.where("not whole")
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_units"]
    return result.select(F.col("k.key").alias(key), *names)
