"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the mix by weight; no source is repeated more than ``most`` times, and
what such a source cannot take goes to the others by weight (water filling, solved in closed form
over one row for each source).

Inside a source documents are taken with unequal probabilities: the expected number of copies of a
document grows with the binary digits of its number of words, so a document of 1,000 words (10
digits) is expected twice as often as one of 20 (5 digits), up to ``most`` copies. The factor that
makes the expected words of a source its target is solved in closed form over one row for each
source and number of digits. The whole part of an expectation is copied for certain; one copy more
goes to a Pareto sample whose inclusion probability is the rest: documents are ranked by the odds of
a uniform number divided by the odds of their inclusion, and the ranking is cut where the words
still missing are reached, so a sample has a fixed size in words.

The cut needs running sums over a source, of which one may hold most rows. Ranks are therefore
dealt into slices, more of them the larger the source; sums run over slices first, then only over
the documents of the one slice that holds the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, unit_from_md5, unstage


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, weight, target: one row for each source, in code-point order, null last."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy()
    place = F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    ceiling = F.lit(most) * F.col("source_size")
    # Sources reach their ceilings in the order of ceiling / weight; ties are alike for the result.
    filled = totals.withColumn("weight", weight).withColumn("ceiling", ceiling).withColumn("fills_at", F.col("ceiling") / F.col("weight"))
    before = everyone.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(everyone) - F.coalesce(F.sum("ceiling").over(before), F.lit(0))
    left_weight = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = filled.withColumn("level", left_words / left_weight)
    # Levels rise up to the first source whose ceiling lies above them, and fall from there on.
    level = F.max("level").over(everyone)
    target = F.when(F.col("fills_at") <= level, F.col("ceiling").cast("double")).otherwise(F.col("weight") * level)
    return levels.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _drawn(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> list[Column]:
    """id, source, size, digits and draw of a row."""
    draw = unit_from_md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.length(F.bin(size)).alias("digits"), draw.alias("draw")]


def expected_copies(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, slice_rows: int = 4096) -> DataFrame:
    """For each source and number of digits: plan_source, plan_digits, source_size, target, whole, chance, missing, slices.

    A document is expected least(most, factor * digits) times: whole copies, and one more with
    chance. missing is what a source's sample has to hold in words.
    """
    classes = sized.groupBy("source", "digits").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(classes.withColumnRenamed("words", "size"), weights, most).select(F.col("source").alias("plan_source"), "source_size", "target")
    planned = classes.join(targets, F.col("source").eqNullSafe(F.col("plan_source"))).drop("source")
    # The longest documents reach most first. If those above a class have, the factor follows from the
    # rest; an assumption that is wrong gives too small a factor, so the greatest is the right one.
    own = Window.partitionBy("plan_source")
    longer = own.orderBy(F.col("digits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = own.orderBy(F.col("digits").desc()).rowsBetween(0, Window.unboundedFollowing)
    weighed = F.sum(F.col("digits") * F.col("words")).over(rest)
    factor = F.when(weighed > 0, (F.col("target") - most * F.coalesce(F.sum("words").over(longer), F.lit(0))) / weighed)
    planned = planned.withColumn("factor", factor).withColumn("factor", F.coalesce(F.max("factor").over(own), F.lit(0.0)))
    expected = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("factor") * F.col("digits")))
    planned = planned.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    missing = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own)
    slices = F.ceil(F.sum("rows").over(own) / slice_rows)
    return planned.select("plan_source", F.col("digits").alias("plan_digits"), "source_size", "target", "whole", (F.col("expected") - F.col("whole")).alias("chance"), missing.alias("missing"), slices.alias("slices"))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their plan, the place in the source's ranking (key) and its slice."""
    # At most 64 rows for each source; more than this bound are joined by a shuffle.
    side = F.broadcast(plan) if plan.count() <= 100_000 else plan
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("digits") == F.col("plan_digits")), "left")
    odds = F.col("draw") / (1 - F.col("draw"))
    rank = F.when(F.col("chance") > 0, F.try_divide(odds * (1 - F.col("chance")), F.col("chance")))
    key = F.struct(rank.alias("rank"), (-F.col("size")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    # A rank of 1 lies in the middle; of all ranks near it no slice gets more than its share.
    return joined.withColumn("key", F.when(F.col("chance") > 0, key)).withColumn("slice", F.floor(rank / (1 + rank) * F.col("slices")))


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """expected_copies, and where the ranking of each source is cut: cut_slice, last."""
    plan = staged(expected_copies(sized, weights, most), "mix-expected")
    ranked = _ranked(sized, plan).filter("key IS NOT NULL AND missing > 0")
    sums = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    running = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words"))
    wanted = running.filter("before < missing AND missing <= before + words")
    cuts = wanted.select(F.col("source").alias("cut_source"), F.col("slice").alias("cut_slice"), F.col("before").alias("cut_before"))
    in_cut = ranked.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("slice") == F.col("cut_slice")))
    reached = F.col("cut_before") + F.sum("size").over(Window.partitionBy("cut_source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    # The document that crosses the target is taken if that comes nearer to it than leaving it.
    over, under = reached - F.col("missing"), F.col("missing") - (reached - F.col("size"))
    taken = in_cut.select("cut_source", "cut_slice", "key", ((under > 0) & ((over <= 0) | (over < under))).alias("taken"))
    ends = taken.groupBy("cut_source").agg(F.first("cut_slice").alias("cut_slice"), F.max(F.when(F.col("taken"), F.col("key"))).alias("last"))
    out = staged(plan.join(ends, F.col("plan_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "mix-plan")
    unstage(plan)
    return out


def _copied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan of their source and the number of copies."""
    inside = F.col("cut_slice").isNull() | (F.col("slice") < F.col("cut_slice")) | ((F.col("slice") == F.col("cut_slice")) & F.coalesce(F.col("key") <= F.col("last"), F.lit(False)))
    extra = F.coalesce(F.col("key").isNotNull() & (F.col("missing") > 0) & inside, F.lit(False))
    return _ranked(rows, plan).withColumn("copies", F.col("whole") + extra.cast("long"))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """id, size, source, source_size, target, expected, copies, taken: one row for each document.

    size counts words; expected is the mean number of copies, of which the whole part is certain.
    Null or empty texts have no words and count as texts of one digit. Null is a source of its own,
    after all others. Draws depend on the id and seed alone, so reruns agree; of one source, rows
    with one id and number of digits rank by size, and rows that have id and size in common are taken
    together. An empty table gives an empty result. Columns other than the three named are not
    looked at.
    """
    sized = staged(docs.select(_drawn(docs, id_col, source_col, text_col, seed)), "mix-sizes")
    mixed = _copied(sized, _plan(sized, weights, most))
    return mixed.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", (F.col("whole") + F.col("chance")).alias("expected"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """The documents of the mix with all their columns, each as often as pareto_mix copies it.

    Rows travel as one struct beside the plan of their source, so texts are not shuffled.
    """
    drawn = _drawn(docs, id_col, source_col, text_col, seed)
    sized = staged(docs.select(drawn), "mix-sizes")
    plan = _plan(sized, weights, most)
    unstage(sized)
    copied = _copied(docs.select(F.struct("*").alias("row"), *drawn), plan)
    return copied.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
