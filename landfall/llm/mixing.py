"""Mixing sources to target weights by capped water-filling.

Every source has a weight; the words of all sources are shared out by weight, no source beyond max_epochs
times its own size, what is above that going to the others by weight until none is above. Whole epochs of
a source are taken as they are, the rest of its target from its documents in a seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .quality import words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hex digits of the seeded hash that name a bucket of a source's documents.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(words_of(text))).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds weight, cap and target to one row (source, source_size) a source.

    Sorted by cap for each unit of weight, the capped sources are a prefix: source j is capped if its cap
    is not above what its weight gets of the words that the ones before leave. The window has one row a
    source.
    """
    places = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(places) - 1) % len(weights)) + 1).cast("bigint"))
    capped = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = capped.withColumns({"level": level, "place": F.row_number().over(order)})
    full = levels.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    water = full.withColumn("water", F.min_by("level", F.when(~F.col("full"), F.col("place"))).over(everything))
    return water.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water"))).select(
        "source", "source_size", "weight", "cap", "target"
    )


def _boundaries(rows: DataFrame, extras: DataFrame) -> DataFrame:
    """_s, _bound, _k, _m for each source: the last (tag, size) of which rows are taken, how many of them, and of how many.

    rows have _source, _tag and size, extras one row (_s, extra) a source. Rows are taken in order of tag
    and size while the middle of their words lies within extra. Sums over buckets of the tag find the
    bucket with the boundary; there equal rows are counted before any are put in order. A source has no
    row here if extra is at least its size, or negative.
    """
    bucketed = rows.withColumn("_bucket", F.substring("_tag", 1, BUCKET_DIGITS))
    buckets = bucketed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    edges = starts.join(extras, F.col("_source").eqNullSafe(F.col("_s"))).filter((F.col("_start") <= F.col("extra")) & (F.col("_start") + F.col("_n") > F.col("extra")))
    edge = edges.select("_s", F.col("_bucket").alias("_b"), "_start", "extra")
    inside = bucketed.join(edge, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).groupBy("_s", "_b", "_start", "extra", "_tag", "size").agg(F.count("*").alias("_m"))
    within = Window.partitionBy("_s", "_b").orderBy("_tag", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("extra") * 2 - F.col("_before") * 2 - F.col("size")  # what the first of the equal rows leaves, twice
    fit = F.when(room < 0, 0).when(F.col("size") > 0, F.least(F.col("_m"), F.floor(room / (F.col("size") * 2)) + 1)).otherwise(F.col("_m")).cast("bigint")
    placed = inside.withColumn("_before", F.col("_start") + F.coalesce(F.sum(F.col("size") * F.col("_m")).over(within), F.lit(0))).withColumn("_k", fit)
    last = F.max(F.when(F.col("_k") > 0, F.struct("_tag", "size", "_k", "_m")))
    none = F.struct(F.min("_b").alias("_tag"), F.lit(-1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("_k"), F.lit(0).cast("bigint").alias("_m"))
    found = placed.groupBy("_s").agg(F.coalesce(last, none).alias("_last"))
    return found.select("_s", F.struct("_last._tag", "_last.size").alias("_bound"), "_last._k", "_last._m")


def water_filling(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= size * copies).

    A document's extra copy is taken while the middle of its words lies within what whole epochs leave of
    the target, in order of a seeded hash of its key, so a source misses its target by less than one
    document. A null text has size 0; a null source is a source of its own, last in order. Of rows with
    equal keys (null ones too) and sizes as many are taken as fit; which ones is left open, as are rows
    that differ in nothing. An empty table gives no rows. Columns of docs with the name of an added one
    are replaced, unless they are key, text or source.

    What is taken of a source is a prefix of its seeded order, so one boundary a source decides; the
    documents themselves meet nothing but the table of boundaries, one row a source. Only where a boundary
    falls between rows of one key and size are these rows written apart and put in an order of their own.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    base = docs.drop(*[c for c in docs.columns if c in added and c not in (key, text, source)])
    tag = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))
    sized = base.withColumns({"size": n_words(F.col(f"`{text}`")), "_tag": tag, "_source": F.col(f"`{source}`")})
    narrow = stored(sized.select("_source", "_tag", "size"), "sizes")
    sizes = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = stored(targets(sizes, weights, max_epochs).withColumn("_whole", whole).withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size")), "targets")
    bound = _boundaries(narrow, plan.select(F.col("source").alias("_s"), F.col("_extra").alias("extra")))
    # without a boundary the rest of the target is nothing or all of the source
    known = plan.join(bound, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_from"), "source_size", "target", "_whole", "_extra", "_bound", "_k", "_m")
    known = stored(known, "boundaries")
    met = sized.join(known, F.col("_source").eqNullSafe(F.col("_from")))
    here = F.struct("_tag", "size")
    more = F.when(F.col("_bound").isNotNull(), here <= F.col("_bound")).otherwise(F.col("_extra") >= F.col("source_size")) & (F.col("_extra") > 0)
    tied = F.coalesce((F.col("_k") < F.col("_m")) & (here == F.col("_bound")), F.lit(False))
    names = [F.col(f"`{c}`") for c in base.columns]

    def taken(df: DataFrame, one_more: Column) -> DataFrame:
        copies = df.withColumn("copies", F.col("_whole") + F.when(one_more, 1).otherwise(0))
        return copies.withColumn("taken", F.col("size") * F.col("copies")).select(*names, *added)

    if known.filter("_k < _m").isEmpty():
        return taken(met, more)
    ties = stored(met.filter(tied).withColumn("_row", F.monotonically_increasing_id()), "ties")
    each = ties.withColumn("_tag", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_row").cast("string"))))
    quota = known.filter("_k < _m").select(F.col("_from").alias("_s"), F.col("_k").cast("double").alias("extra"))
    first = _boundaries(each.select("_source", "_tag", F.lit(1).cast("bigint").alias("size")), quota).select("_s", F.col("_bound._tag").alias("_until"))
    chosen = each.drop("_bound").join(stored(first, "boundaries"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    return taken(met.filter(~tied), more).unionByName(taken(chosen, F.coalesce(F.col("_tag") <= F.col("_until"), F.lit(False))))
