"""Mixing sources to target weights by systematic sampling - DataFrame expressions only.

Targets: sources share the total size by weight; a target stops at ``max_repeat`` times its source's
size and the excess is reshared by weight (water filling, solved in closed form over the source table).
Copies: within a source every document expects ``target / source_size`` copies; with one random offset
``u`` per source a document is emitted once for every integer that the running sum crosses.

The running sum is distributed: documents are ordered by (size class, hash of id and text).  Counts per
(source, size class, first digits of the hash) are summed on a table of one row a cell, and rows are numbered
only inside such a cell, so a source with a third of all rows is spread over its cells, and so are rows that
share an id or have none.  The number of digits follows the number of rows, so that cells stay small; the
order, and with it the result, is the same for any number.  A cell is still large only where rows are equal
in id and text: these stand side by side in the order, whichever is first, and are dealt to ``SPREAD``
cells of their own.  Order by size class keeps each source's taken words within about one document per
class.  Texts are read once to count them; ``emit`` reads them a second time to move them.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a source
without words has target 0 and nothing is taken; rows that tie in id and text are interchangeable; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespark.llm.common import stage

SEED = "mix-1"
#: Rows of a cell, were all of a class and evenly spread: what the number of digits aims at.
CELL_ROWS = 1 << 20
#: Cells that many equal rows are dealt to.
SPREAD = 1024


def cell_digits(n_rows: int, cell_rows: int = CELL_ROWS) -> int:
    """Hexadecimal digits of the hash that split a size class into cells; 2 at least."""
    digits = 2
    while n_rows > cell_rows << 4 * digits and digits < 6:
        digits += 1
    return digits


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Quarter powers of two: four times the bit length, plus the two bits after the leading one."""
    bits = F.length(F.bin(size))
    return bits * 4 + F.call_function("shiftright", size * 8, bits).bitwiseAND(F.lit(3)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """``sizes(source, source_size, ...)`` with ``weight, target`` added.

    With targets ``min(cap, level * weight)`` sorted by ``cap / weight``, the level is the first
    ``(total - caps before) / (weights from here on)`` that does not exceed its own ``cap / weight``.
    One row a source: the windows without a key see the source table only.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    table = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long"))
    table = table.withColumn("cap", F.col("source_size") * F.lit(max_repeat)).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward, every = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    table = table.withColumn("level", left.cast("double") / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return table.withColumn("target", target).drop("cap", "ratio", "level")


def offset(source: Column, seed: str = SEED) -> Column:
    """One number in [0, 1) a source: the first 32 bits of the md5 of seed and name."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def place(docs: DataFrame) -> Column:
    """The hash that orders rows of a size class: of id and text, so that equal ids are spread."""
    text = F.coalesce(F.md5(docs["text"].cast("string").cast("binary")), F.lit("null"))
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))


def allocate(docs: DataFrame, size: Column, hashed: Column, carried: Column, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs(doc_id, source, ...)`` -> ``row``, ``size, source_size, target, copies``.

    ``size`` and ``hashed`` are the size and the ``place`` of a row; ``carried`` becomes ``row``, a struct of
    whatever of the input is wanted afterwards, so that names clash with nothing and nothing else is moved.  Rows
    move once, by cell; the cell table, which is written first, is joined on the same keys.
    """
    digits = cell_digits(docs.count(), cell_rows)
    rows = docs.select(carried.alias("row"), size.alias("size"), F.col("source").cast("string").alias("source"), hashed.alias("md5"))
    rows = rows.withColumns({
        "src": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")),
        "class": size_class(F.col("size")), "cell": F.substring("md5", 1, digits), "part": F.lit(0),
    })
    cell = ["src", "class", "cell", "part"]

    def counted() -> DataFrame:
        return stage(rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("source").alias("source")))

    cells = counted()
    large = cells.where(F.col("n") > 2 * cell_rows).select("src", "class", "cell")
    if not large.isEmpty():
        rows = _spread(rows, large, cell_rows)
        cells = counted()
    before = W.partitionBy("src").orderBy("class", "cell", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    sizes = cells.groupBy("src").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    at = starts.join(source_targets(sizes, weights, max_repeat).select("src", "source_size", "target"), "src")
    inside = W.partitionBy(*cell).orderBy("md5", "size")
    joined = rows.withColumn("k", F.row_number().over(inside)).join(at, cell)
    rank = (F.col("start") + F.col("k")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.least(F.lit(max_repeat).cast("long"), F.floor(u + rate * rank) - F.floor(u + rate * (rank - 1)))
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _spread(rows: DataFrame, large: DataFrame, cell_rows: int) -> DataFrame:
    """``rows`` with ``part``: what of a large cell comes before its most frequent hashes, these dealt over ``SPREAD``
    parts each, what comes between and after them.  There are as many such hashes as ``cell_rows`` goes into all
    rows, at most, so their table is broadcast."""
    key = ["src", "class", "cell"]
    inside = rows.join(F.broadcast(large), key, "left_semi").groupBy(*key, "md5").count().where(F.col("count") > cell_rows)
    heavy = stage(inside.groupBy(*key).agg(F.array_sort(F.collect_list("md5")).alias("heavy")))
    numbered = stage(rows.withColumn("any", F.monotonically_increasing_id())).join(F.broadcast(heavy), key, "left")
    earlier = F.size(F.filter("heavy", lambda h: h < F.col("md5")))
    own = F.array_contains("heavy", F.col("md5"))
    part = earlier * 2 * SPREAD + F.when(own, SPREAD + F.pmod(F.xxhash64("any"), F.lit(SPREAD))).otherwise(F.lit(0))
    return numbered.withColumn("part", F.coalesce(part.cast("int"), F.lit(0))).drop("any", "heavy")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: what the mix takes of each row; texts are only counted."""
    counted = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), place(docs).alias("place")))
    shares = allocate(counted, F.col("size"), F.col("place"), F.struct("doc_id"), **options)
    return shares.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each repeated as often as it is taken, columns unchanged."""
    rows = allocate(docs, word_count(F.col("text").cast("string")), place(docs), F.struct("*"), **options).where(F.col("copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
