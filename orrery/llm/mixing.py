"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Targets share the total by weight; a source stops at ``max_epochs`` times its size and the excess is shared anew by
weight until no source is above. The fixed point is found directly: with sources ordered by cap / weight, the first
whose cap the common level does not reach fixes the level of all behind it.

A source then gives floor(epochs) whole repetitions of every document and one fractional repetition: documents in a
seeded order, each whole, until the target is met; the last gives only the missing words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes from which a text isn't cut into an array of words.
LONG = 1 << 20
#: Rows whose sizes one task sums up, on average.
BUCKET_ROWS = 10_000


def word_count(text: Column) -> Column:
    """Number of WORD matches; null: 0.

    Words are what single blanks part, once other white space is a blank; texts of LONG characters or more, whose words would
    make a large array, have their runs of white space squeezed and counted instead, which takes three times the time.
    """
    given = F.coalesce(text, F.lit(""))
    blanks = given
    for c in "\t\n\x0b\x0c\r":
        blanks = F.replace(blanks, F.lit(c), F.lit(" "))
    parted = F.size(F.array_remove(F.split(blanks, " "), ""))
    squeezed = F.trim(F.regexp_replace(given, r"[\x20\x09-\x0D]+", " "))
    counted = F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1)
    return F.when(F.octet_length(given) < LONG, parted).otherwise(counted).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """``sources`` (source, weight, source_size) with `target` double.

    The table has a row per source. Sources without weight or size get 0. If all caps together are below the share, all
    sources stop at their caps. All-zero sizes give 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    one = sources.withColumn("__cap", cap.cast("double")).withColumn("__w", F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0.0).cast("double"))
    order = [F.when(F.col("__w") > 0, F.col("__cap") / F.col("__w")).asc_nulls_first(), F.col("source").asc_nulls_last()]
    behind = Window.orderBy(*order)
    every = Window.partitionBy()
    one = (
        one.withColumn("__total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("__spent", F.coalesce(F.sum(F.when(F.col("__w") > 0, F.col("__cap"))).over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__rest_w", F.sum("__w").over(behind.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("__level", F.when(F.col("__w") > 0, (F.col("__total") - F.col("__spent")) / F.col("__rest_w")))
        .withColumn("__free", F.when((F.col("__w") > 0) & (F.col("__cap") / F.col("__w") >= F.col("__level")), F.col("__level")))
    )
    # Levels rise until the first source that stays free; that one's level holds for all behind it.
    first_free = F.first("__free", ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(F.col("__w") == 0, F.lit(0.0)).when(F.col("__first").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__first") * F.col("__w")))
    return one.withColumn("__first", first_free).withColumn("target", target).select(*sources.columns, "target")


def weigh(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Give the sources the repeating ``weights`` by code point of their names, null last."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(n, F.lit(len(weights))) + 1))


def plan_mix(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 0, whole_documents: bool = False) -> DataFrame:
    """``sized`` (doc_id, source, size) with source_size, target and `taken`, the words that the mix takes.

    ``sized`` is read three times and should be materialised. Every task sums a hash range of a source, about
    BUCKET_ROWS rows, whatever the source holds. Repeated doc_ids are ordered by size and then interchangeable. Null
    sources form one source; sizes of 0 take 0. With ``whole_documents`` the last document of the fractional repetition
    is given whole or not at all, whichever is nearer.
    """
    rows = sized.count()
    bits = max(0, (rows // BUCKET_ROWS).bit_length())
    # 60 bits of an MD5, which SQL engines share.
    hashed = sized.withColumn("__h", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long"))
    hashed = hashed.withColumn("__b", F.shiftright(F.col("__h"), 60 - bits))
    hashed = hashed.withColumn("__src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    buckets = hashed.groupBy("__src", "__b").agg(F.sum("size").alias("__n"), F.first("source").alias("source"))
    sources = weigh(buckets.groupBy("__src", "source").agg(F.sum("__n").alias("source_size")), weights)
    sources = water_fill(sources, max_epochs)
    before = Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = buckets.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__src", "__b", "__first")
    first = first.join(sources.select("__src", "source_size", "target"), "__src")
    inside = Window.partitionBy("__src", "__b").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(first, ["__src", "__b"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    more = F.round(F.col("target")).cast("long") - F.col("__whole") * F.col("source_size") - F.col("__first") - F.col("__in")
    part = F.greatest(F.lit(0).cast("long"), F.least(more, F.col("size")))
    if whole_documents:
        part = F.when(F.col("__more") * 2 > F.col("size"), F.col("size")).otherwise(0)
    return (
        placed.withColumn("__whole", whole)
        .withColumn("__more", more)
        .withColumn("taken", (F.col("__whole") * F.col("size") + part).cast("long"))
        .withColumn("repeats", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0)))
        .select(*sized.columns, F.col("source_size").cast("long").alias("source_size"), "target", "taken", "repeats")
    )


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


#: The rows of mix_documents with its defaults, for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5('0:' || doc_id), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
l AS (SELECT *, 3 * n AS cap, sum(n) OVER () AS total,
             coalesce(sum(3 * n) OVER (ORDER BY 3 * n / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY 3 * n / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w WHERE n > 0),
level AS (SELECT arg_min((total - spent) / rest, cap / weight) AS level FROM l WHERE cap / weight >= (total - spent) / rest),
t AS (SELECT w.source, w.n, CASE WHEN w.n = 0 THEN 0 ELSE least(3 * w.n, coalesce(level * weight, 3 * w.n)) END AS target FROM w, level),
o AS (SELECT d.*, t.n, t.target, floor(CASE WHEN t.n > 0 THEN t.target / t.n ELSE 0 END) AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
       (whole * size + greatest(0, least(round(target) - whole * n - before, size)))::BIGINT AS taken, source
FROM o
"""


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """The plan of mixing ``docs`` (doc_id, text, source, anything); one row per document, null and empty texts of size 0."""
    mixed = plan_mix(common.cut(sizes(docs)), weights, max_epochs, seed)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")
