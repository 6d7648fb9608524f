"""Mixing of sources to target weights by hash-threshold histograms, with DataFrame functions only.

Each document has a place on the line of its source: the hash of its id and text. A source's budget is
a number of whole passes over it and a rest; the rest is taken from the documents whose hash lies below
a threshold. The threshold is found without sorting: a histogram sums words by source and by the first
bits of the hash, the bucket in which the budget ends is refined by the next bits, and only its rows
are summed again, until the hash is known to its last bit. Budgets are nested: a larger budget has a
higher threshold, and so takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import is_empty, numbered_columns, place_of, places_of, stage
from gleaner.llm.ordering import numbered

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: The hash has LEVELS times BITS bits.
LEVELS, BITS = 4, 13


def words(text: Column) -> Column:
    """How many runs of other characters than 0x20 and 0x09 to 0x0D a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """52 bits of a hash of id and text."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size), one row for each source: with its target.

    Sources in the order of code points, null last, have the weights 5, 2, 1, 5, ... and share 1.5 times
    all words; a target stops at twice its source's size and what it leaves is shared by weight again.
    """
    ranked = numbered(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", weight.alias("weight")), clear=False)
    total, level, known = ranked.agg(F.sum("source_size")).head()[0] or 0, 0.0, None
    while True:
        full = F.col("source_size") * MOST <= F.lit(level) * F.col("weight")
        n, taken, open_ = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size") * MOST)), F.sum(F.when(~full, F.col("weight")))).head()
        if n == known or not open_:
            break
        known, level = n, (SHARE * total - (taken or 0)) / open_
    full = F.col("source_size") * MOST <= F.lit(level) * F.col("weight")
    return ranked.select("source", "source_size", F.when(full, F.col("source_size").cast("double") * MOST).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: the hash at which its rest is spent, the words left for documents of just that hash and the words these have."""
    open_ = goals.where("source_size > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(open_, rows["source"].eqNullSafe(open_["source"]) & (F.shiftright("h", shift + BITS) == F.col("prefix"))) if level else rows.join(open_, rows["source"].eqNullSafe(open_["source"]))
        histogram = inside.groupBy(rows["source"], F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        ended = histogram.withColumn("upto", upto).where("upto > left and upto - words <= left")
        open_ = stage(ended.select("source", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), F.col("bucket").alias("prefix"), "words", "low", "high"), clear=False)
        if is_empty(open_.where("low < high")):
            break
    return open_.select("source", F.col("low").alias("threshold"), F.col("left").alias("part"), F.col("words").alias("of"))


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and taken; all rows, other columns unchanged.

    Columns of docs with those four names are replaced; any other name may occur.
    size counts words. taken is how many words the mix takes, repeats counted: whole passes over the
    source, one more of documents below the threshold, and of the document at it the part that is left,
    so that a source gets its target but for the fraction of a word. Rows with one hash (repeated rows)
    share that part by size. Texts that are null or blank have size and taken 0. The result depends on
    ids, texts and sources alone, never on order or partitions. Empty in, empty out.
    """
    kept = places_of(docs, "size", "source_size", "target", "taken")
    doc_id, text, source = (F.col(place_of(docs, c)) for c in ("doc_id", "text", "source"))
    rows = numbered_columns(docs, kept).withColumn("size", words(text)).withColumn("h", place(doc_id, text)).withColumn("source", source)
    small = stage(rows.select("source", "size", "h"))
    goals = targets(stage(small.groupBy("source").agg(F.sum("size").alias("source_size")), clear=False))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = stage(goals.withColumn("passes", passes.cast("long")).withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")), clear=False)
    at = _thresholds(small, goals)
    plan = stage(goals.join(at, goals["source"].eqNullSafe(at["source"]), "left").select(goals["source"].alias("of_source"), "source_size", "target", "passes", "threshold", "part", "of"), clear=False)
    out = rows.join(plan, rows["source"].eqNullSafe(plan["of_source"]), "left")
    part = F.expr("cast(part as decimal(19,0)) * cast(size as decimal(18,0)) div cast(of as decimal(19,0))")
    more = F.when(F.col("h") < F.col("threshold"), F.col("size")).when(F.col("h") == F.col("threshold"), part).otherwise(0)
    out = out.withColumn("taken", (F.col("size") * F.col("passes") + more).cast("long")).select(*[f"_in{k}" for k in kept], "size", "source_size", "target", "taken")
    return out.toDF(*[docs.columns[k] for k in kept], "size", "source_size", "target", "taken")
