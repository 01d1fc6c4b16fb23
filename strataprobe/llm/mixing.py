"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words (weights shared out by water filling
under a cap of ``max_repeat`` copies).  target / source size = whole copies that
every document certainly gets, plus a remainder below one copy.  The remainder
is a sample of fixed size (in words) of unequal probabilities: every document
has inclusion odds, by default rising with the length of its text
(``length_odds``), else those of ``appeal_col``.  A factor common to a source
scales them so that the expected words of the sample meet the source's
remainder.  Documents rank by the odds of a uniform hash divided by their
inclusion odds, and are taken in rank order until the remaining words are used
up.  The hash depends on id and text only, so reruns agree.

One departure from pure order sampling: the cut would leave a source short by
part of a document, so the one document that best closes that gap is added,
whatever its rank.  That favours no document by more than one in all that its
source has taken.

Rows equal in id and text share their rank.  Where the cut falls among them, as
many are taken as the words allow, counted by input split.

Everything per source is pre-aggregated.  The rank axis is cut into fixed
buckets, and only the one bucket per source in which the cut falls is ordered,
by distinct ranks, so a source with a third of all rows, or as many copies of
one row, is never in one task.  Sources themselves (one row each) are put in
order in one task.  docs is read twice: for the ranks, and for the rows.

Defined results: null text has no words; null source is a source of its own and
last in order; sources without words have target 0; null ids are drawn by text;
odds that are null or no number are 1, and all are held within 1e-9 and 1e9; an
empty table gives an empty table; columns of the input named size, source_size,
target, copies or taken are replaced, all others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col
from .rows import packed, unpacked
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
_SPAN = float(1 << 52)
#: Bytes at which a text's odds are half of those of a very long one.
HALF_BYTES = 512
#: Odds are held within these bounds.
_LEAST, _MOST = 1e-9, 1e9
#: Steps to a doubling of odds in the histogram that sets their common factor.
_STEPS = 16
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_odds(text: Column, half_bytes: int = HALF_BYTES) -> Column:
    """Odds that rise with the length of a text: fragments are drawn less often than whole texts."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("double")
    return size / (size + F.lit(float(half_bytes)))


def _uniform(ident: Column, text: Column, seed: str) -> Column:
    """A double in (0, 1) from the MD5 of id and text."""
    ident = F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit("/"), F.md5(F.coalesce(text, F.lit(""))), F.lit(f"/{seed}"))
    return (F.conv(F.substring(F.md5(ident), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(_SPAN)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """sizes(source, source_size) with weight and target.

    Targets are weight * level, cut at max_repeat * source_size, where level makes
    them add up to share of all words: sources are put in the order in which they
    reach their cap, and the level is read off at the first one that does not.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(pattern, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumn("_free", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", F.col("_free") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    open_level = F.min(F.when(F.col("_level") * F.col("weight") < F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level")))).over(every)
    target = F.coalesce(F.least(F.col("_cap"), open_level["_level"] * F.col("weight")), F.col("_cap"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _factor(rows: DataFrame) -> DataFrame:
    """Of each source (plan_source, rest, a row for each document's size and odds) the factor by which the odds give rest words on average.

    Odds are counted in steps, so few numbers a source are solved for, by bisection.
    """
    step = F.floor(F.log2("odds") * _STEPS)
    parts = rows.groupBy("plan_source", "rest", step.alias("step")).agg(F.sum("size").cast("double").alias("words"), (F.sum(F.col("size") * F.col("odds")) / F.sum("size")).alias("odds"))
    parts = parts.groupBy("plan_source", "rest").agg(F.collect_list(F.struct("words", "odds")).alias("parts"))

    def words(power: Column) -> Column:
        at = F.pow(F.lit(2.0), power)
        return F.aggregate("parts", F.lit(0.0), lambda sum_, x: sum_ + x["words"] * at * x["odds"] / (F.lit(1.0) + at * x["odds"]))

    def halve(ends: Column, _: Column) -> Column:
        middle = (ends["low"] + ends["high"]) / 2
        few = words(middle) < F.col("rest")
        return F.struct(F.when(few, middle).otherwise(ends["low"]).alias("low"), F.when(few, ends["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-100.0).alias("low"), F.lit(100.0).alias("high")), halve)
    return parts.select(F.col("plan_source").alias("factor_source"), F.pow(F.lit(2.0), found["low"]).alias("factor"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _place(prefix: str = "") -> Column:
    """What rows are ordered by within a source."""
    return F.struct(F.col(f"{prefix}rank").alias("rank"), F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}size").alias("size"))


def _mixed(docs: DataFrame, weights: Sequence[float], max_repeat: int, share: float, id_col: str, text_col: str, source_col: str, appeal_col: str | None, buckets: int, seed: str, keep_columns: bool) -> DataFrame:
    """Rows of docs, with their columns as the struct row if kept, and all of ADDED."""
    scratch = Scratch(docs.sparkSession)
    ident, text = col(id_col), col(text_col)
    odds = F.nanvl(col(appeal_col).cast("double"), F.lit(1.0)) if appeal_col else length_odds(text)
    odds = F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), F.coalesce(odds, F.lit(1.0))))
    u = _uniform(ident, text, seed)
    helpers = [ident.alias("id"), col(source_col).alias("source"), word_count(text).alias("size"), odds.alias("odds"), (u / (F.lit(1.0) - u) / odds).alias("draw")]
    slim = scratch.keep(docs.select(*helpers), "sized")

    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, max_repeat, share)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio + F.lit(1e-9)).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = scratch.keep(plan.withColumn("drawn", ratio - F.col("whole") > 0).withColumnRenamed("source", "plan_source").drop("weight"), "targets")
    factors = _factor(slim.where("size > 0").join(plan.where("drawn"), _same("source", "plan_source")))
    plan = scratch.keep(plan.join(factors, _same("plan_source", "factor_source"), "left").drop("factor_source"), "factors")

    def ranked(rows: DataFrame) -> DataFrame:
        """rows with their source's plan and a rank; without one if they are not drawn."""
        out = rows.join(plan, _same("source", "plan_source"))
        return out.withColumn("rank", F.when(F.col("drawn") & (F.col("size") > 0), F.col("draw") / F.col("factor")))

    at = ranked(slim).where("rank IS NOT NULL").withColumn("bucket", F.floor(F.lit(float(buckets)) * F.col("rank") / (F.lit(1.0) + F.col("rank"))).cast("int"))
    upto = Window.partitionBy("plan_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    by_bucket = at.groupBy("plan_source", "rest", "bucket").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("rest"))
    cuts = by_bucket.groupBy("plan_source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    cuts = scratch.keep(cuts.select(F.col("plan_source").alias("cut_source"), F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("before")), "cuts")

    # of the rows in the bucket of the cut, equal ones counted: the first that do not all fit
    inside = at.join(cuts, _same("plan_source", "cut_source")).where("bucket = cut_bucket").groupBy("plan_source", "rest", "before", "rank", "id", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("plan_source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(order) + F.col("before")).where(F.col("upto") > F.col("rest"))
    edges = inside.groupBy("plan_source").agg(F.min(F.struct("rank", "id", "size", "n", "rest", (F.col("upto") - F.col("n") * F.col("size")).alias("used"))).alias("e")).select(F.col("plan_source").alias("edge_source"), "e.*")
    edges = edges.withColumn("take", F.floor((F.col("rest") - F.col("used")) / F.col("size")).cast("long")).withColumn("gap", F.col("rest") - F.col("used") - F.col("take") * F.col("size"))
    edges = scratch.keep(edges.select("edge_source", *[F.col(c).alias(f"edge_{c}") for c in ("rank", "id", "size", "take")], "gap"), "edges")

    # the row that best closes the gap, among those that are not taken
    left = at.join(edges, _same("plan_source", "edge_source")).where(_place() >= _place("edge_"))
    left = left.groupBy("plan_source", "gap", "rank", "id", "size", "edge_take", (_place() == _place("edge_")).alias("edge")).agg(F.count("*").alias("n")).where("NOT edge OR n > edge_take")
    miss = F.abs(F.col("gap") - F.col("size"))
    fills = left.where(miss < F.col("gap")).groupBy("plan_source").agg(F.min(F.struct(miss.alias("miss"), "rank", "id", "size")).alias("f")).select(F.col("plan_source").alias("part_source"), "f.rank", "f.id", "f.size", F.lit(1).cast("long").alias("take"))
    partial = fills.unionByName(edges.select(F.col("edge_source").alias("part_source"), *[F.col(f"edge_{c}").alias(c) for c in ("rank", "id", "size", "take")]))
    partial = partial.groupBy("part_source", "rank", "id", "size").agg(F.sum("take").alias("take"))
    partial = partial.select("part_source", *[F.col(c).alias(f"part_{c}") for c in ("rank", "id", "size", "take")])
    alike = _same("plan_source", "part_source") & (F.col("rank") == F.col("part_rank")) & _same("id", "part_id") & (F.col("size") == F.col("part_size"))
    counted = at.join(partial, alike).groupBy(*partial.columns).agg(F.count("*").alias("part_n"))
    partial = scratch.keep(counted, "partial")

    held = docs.select(packed(docs).alias("row"), *helpers) if keep_columns else slim
    marked = ranked(held).join(edges.select("edge_source", "edge_rank", "edge_id", "edge_size"), _same("plan_source", "edge_source"), "left").join(partial, alike, "left")
    before = F.col("edge_source").isNull() | (_place() < _place("edge_"))
    extra = F.when(F.col("rank").isNull(), F.lit(0)).when(F.col("part_n").isNotNull(), (F.col("part_take") >= F.col("part_n")).cast("int")).otherwise(before.cast("int"))
    tied = F.col("part_n").isNotNull() & (F.col("part_take") > 0) & (F.col("part_take") < F.col("part_n"))
    if partial.where("part_take > 0 AND part_take < part_n").isEmpty():
        chosen = marked.withColumn("extra", extra)
    else:
        chosen = marked.where(~tied).withColumn("extra", extra).unionByName(_first_of(marked.where(tied), scratch))
    whole = F.when(F.col("size") > 0, F.col("whole")).otherwise(F.least(F.col("whole"), F.lit(1)))
    return chosen.withColumn("copies", (whole + F.col("extra")).cast("long")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def _first_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Equal rows with extra, 1 for the first part_take of each group of them: numbered by input split, whose counts give the offsets."""
    rows = scratch.keep(rows.withColumn("split", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "tied")
    group = ["plan_source", "part_rank"]
    counts = rows.groupBy(*group, "split").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("plan_source").alias("o_source"), F.col("part_rank").alias("o_rank"), F.col("split").alias("o_split"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*group, "split").orderBy("nth"))
    numbered = rows.withColumn("place", within).join(offsets, _same("plan_source", "o_source") & (F.col("part_rank") == F.col("o_rank")) & (F.col("split") == F.col("o_split")))
    out = numbered.withColumn("extra", (F.col("place") + F.col("offset") <= F.col("part_take")).cast("int"))
    return out.drop("split", "nth", "place", "o_source", "o_rank", "o_split", "offset")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    max_repeat: int = 3,
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    appeal_col: str | None = None,
    buckets: int = 4096,
    seed: str = "mix",
    keep_columns: bool = True,
) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    appeal_col: positive odds of a document against its source's others.
    keep_columns=False: of docs' columns only id and source.
    """
    chosen = _mixed(docs, weights, max_repeat, share, id_col, text_col, source_col, appeal_col, buckets, seed, keep_columns)
    kept = unpacked(docs, but=ADDED) if keep_columns else [F.col("id").alias(id_col), F.col("source").alias(source_col)]
    return chosen.select(*kept, *ADDED)


def mixed_rows(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    max_repeat: int = 3,
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    appeal_col: str | None = None,
    buckets: int = 4096,
    seed: str = "mix",
) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' own columns and no others."""
    chosen = _mixed(docs, weights, max_repeat, share, id_col, text_col, source_col, appeal_col, buckets, seed, True)
    return chosen.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*unpacked(docs))
