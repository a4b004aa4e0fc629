"""Joins: interval overlap with ordered text, lookups with defaults, cache probes, key-set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions import text as T
from cuespark.operators.prefix import unused


def overlap_pairs(windows: DataFrame, cues: DataFrame, bucket_ms: int = 60_000, levels: int = 3, fan: int = 8) -> DataFrame:
    """Pairs of ``windows(doc_id, window_id, lo, hi)`` and ``cues(doc_id, cue_ord, text, start_ms, end_ms)``
    that overlap, both ends inclusive.

    Both sides are put in time buckets and joined on (document, level, bucket), so a long recording is spread over many
    tasks.  Buckets of a level are ``fan`` times as long as those of the level below; an interval's own level is the first
    where it spans ``fan`` buckets at most (or the last one), so an hour is a few rows and a second is one.  Two
    intervals meet on the higher of their levels: each stands on its own level and, there in a bucket or two, on those
    above.  A pair is kept only in the bucket where its overlap begins, so none comes twice.
    """
    sizes = [bucket_ms * fan**level for level in range(levels)]
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("at.level") + 1)

    def covered(level: int, first: Column, last: Column) -> Column:
        return F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bucket")))

    def placed(rows: DataFrame, lo: str, hi: str) -> DataFrame:
        own = F.lit(levels - 1)
        for level in range(levels - 2, -1, -1):
            own = F.when(F.floor(F.col(hi) / sizes[level]) - F.floor(F.col(lo) / sizes[level]) < fan, level).otherwise(own)
        buckets = [covered(level, F.floor(F.col(lo) / s), F.floor(F.col(hi) / s)) for level, s in enumerate(sizes)]
        none = F.slice(buckets[0], 1, 0)
        on = F.concat(*[F.when(own <= level, b).otherwise(none) for level, b in enumerate(buckets)])
        return rows.where(F.col(lo) <= F.col(hi)).withColumn("own", own).withColumn("at", F.explode(on))

    left = placed(windows.select("doc_id", "window_id", "lo", "hi"), "lo", "hi").withColumnRenamed("own", "own_left")
    right = placed(cues.select("doc_id", "cue_ord", "text", "start_ms", "end_ms"), "start_ms", "end_ms")
    met = left.join(right, ["doc_id", "at"]).where((F.col("start_ms") <= F.col("hi")) & (F.col("end_ms") >= F.col("lo")))
    first = F.floor(F.greatest("start_ms", "lo") / size)
    return met.where((F.greatest("own", "own_left") == F.col("at.level")) & (F.col("at.bucket") == first)).drop("at", "own", "own_left")


def reference_text(batches: DataFrame, cues: DataFrame, padding_ms: int = 5_000, **options: int) -> DataFrame:
    """``batches(doc_id, batch_id, start_ms, end_ms, ...)`` with ``reference_text``: the stripped non-blank
    cue texts within the padded window, in cue order, joined by spaces; empty where there are none."""
    windows = batches.select("doc_id", F.col("batch_id").alias("window_id"), (F.col("start_ms") - padding_ms).alias("lo"), (F.col("end_ms") + padding_ms).alias("hi"))
    pairs = overlap_pairs(windows, cues.where(T.not_blank(F.col("text"))), **options)
    rows = F.array_sort(F.collect_list(F.struct("cue_ord", "start_ms", "end_ms", T.strip(F.col("text")).alias("text"))))
    joined = pairs.groupBy("doc_id", F.col("window_id").alias("batch_id")).agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("reference_text"))
    return batches.join(joined, ["doc_id", "batch_id"], "left").withColumn("reference_text", F.coalesce("reference_text", F.lit("")))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], column: str, default: Column, order: str | None = None) -> DataFrame:
    """``rows`` with ``column`` of ``table``, or ``default`` where the key is missing or its value null.

    A key that ``table`` has several times gives one value: the one of the largest ``order``, or the largest value."""
    found, columns = unused("found", rows), [c for c in rows.columns if c != column]
    value = F.max_by(column, order) if order else F.max(column)
    single = table.groupBy(*keys).agg(value.alias(found))
    return rows.join(single, keys, "left").select(*columns, F.coalesce(found, default).alias(column))


def unless_changed(original: Column, changed: Column) -> Column:
    """``original`` where ``changed`` is null, blank or equal to it after stripping."""
    same = changed.isNull() | ~T.not_blank(changed) | (T.strip(changed) == T.strip(original))
    return F.when(same, original).otherwise(changed)


def key_difference(expected: Column, actual: Column) -> Column:
    """``missing`` and ``extra`` keys of two string arrays, each sorted as strings."""
    return F.struct(F.array_sort(F.array_except(expected, actual)).alias("missing"), F.array_sort(F.array_except(actual, expected)).alias("extra"))


def key_message(expected: Column, actual: Column) -> Column:
    """``Missing keys ['1']; Extra keys ['2']``, null when the sets agree."""
    def part(label: str, keys: Column) -> Column:
        return F.when(F.size(keys) > 0, F.concat(F.lit(f"{label} ['"), F.array_join(keys, "', '"), F.lit("']")))

    difference = key_difference(expected, actual)
    return F.nullif(F.concat_ws("; ", part("Missing keys", difference["missing"]), part("Extra keys", difference["extra"])), F.lit(""))


def same_keys(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def failure_gate(chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``chunks(doc_id, n_lines, failed)`` -> failed and total lines, their rate, and ``ok``, ``warn`` or ``fail``."""
    sums = chunks.groupBy("doc_id").agg(F.sum(F.when(F.col("failed"), F.col("n_lines")).otherwise(0)).alias("failed_lines"), F.sum("n_lines").alias("total_lines"))
    return judged(sums, threshold)


def judged(sums: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``failed_lines, total_lines`` with their rate and the verdict."""
    rate = F.when(F.col("total_lines") > 0, F.col("failed_lines") / F.col("total_lines")).otherwise(F.lit(0.0))
    verdict = F.when((F.col("failed_lines") > 0) & (rate >= threshold), "fail").when(F.col("failed_lines") > 0, "warn").otherwise("ok")
    return sums.withColumn("fail_rate", rate).withColumn("verdict", verdict)


def enforce(gate: DataFrame) -> DataFrame:
    """The gate's rows; evaluating one whose verdict is ``fail`` raises."""
    message = F.concat(F.lit("Translation failed: "), F.col("failed_lines").cast("string"), F.lit("/"), F.col("total_lines").cast("string"), F.lit(" lines failed"))
    return gate.withColumn("verdict", F.when(F.col("verdict") == "fail", F.raise_error(message).cast("string")).otherwise(F.col("verdict")))
