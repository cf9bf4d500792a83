"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame expressions. Sums per (source, hash bin) are pre-aggregated on the map side; only the rows of the one
bin of a source in which its share ends are ordered, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import before_parts, n_words, sorted_files, written

BINS = 4096
SPACE = 1 << 48


def placed(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df with place, from 0 in that order, and for each of sums the sum of a column over the rows before. No task sees more
    than a file of sorted rows."""
    files = sorted_files(df, *order)
    parts, _ = before_parts(files, place=F.lit(1), **{n: F.col(f"r.{c}") for n, c in sums.items()})
    rows = files.join(F.broadcast(parts), "part")
    earlier = Window.partitionBy("part").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    more = [(F.col(n) + F.coalesce(F.sum(f"r.{c}").over(earlier), F.lit(0))).alias(n) for n, c in sums.items()]
    return rows.select("r", (F.col("place") + F.col("index")).alias("place"), *more).select("r.*", "place", *sums)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Adds target to one row per source (source, source_size).

    Sources by code point, null last, weigh `weights` in turn. Shares of all sizes by weight; a share stops at cap
    times its source's size, and what is over goes to the rest by weight. That is one water level: with sources ordered
    by cap * size / weight, the first source that the level does not fill fixes it. Sources without words have the target 0;
    an empty table gives an empty one.
    """
    one = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    df = placed(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source")])
    df = df.select("source", "source_size", one.alias("weight"), (F.col("source_size") * cap).alias("most"))
    total, heft = df.agg(F.sum("source_size"), F.sum("weight")).first()
    df = placed(df, [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")], full_before="most", weight_before="weight")
    df = df.withColumn("level", (F.lit(total or 0) - F.col("full_before")) / (F.lit(heft or 0) - F.col("weight_before")))
    place, level = df.where(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min(F.struct("place", "level"))).first()[0] or (-1, 0.0)
    share = F.least(F.lit(float(level)) * F.col("weight"), F.col("most").cast("double"))
    return df.select("source", "source_size", F.when(F.col("place") < place, F.col("most").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20, bins: int = BINS) -> DataFrame:
    """All rows of docs with size, source_size, target and taken (words that the mix takes, repeats counted).

    Every document is taken floor(target / source_size) times; what is left goes, in the order of a seeded hash, to one
    more repetition of some documents, the last of which gives only its first words. So a source's taken words are its
    target, rounded, and no document gives more than cap times its size. Rows that are alike get equal hashes; which of
    them gives more does not matter. Null texts are empty (size 0, taken 0), null sources are one source, the last. An
    empty table gives an empty one. Columns of docs named like the new ones are replaced; all others pass through, whatever
    their names.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce("text", F.lit(""))), F.lit(SPACE))
    # from here on a row of docs is the struct r, so that no name of it can clash
    sized = docs.select(F.struct("*").alias("r"), F.col("doc_id").alias("id"), F.col("source").alias("own"), n_words("text").alias("size"), hashed.alias("u"))
    sized = sized.withColumn("bin", F.floor(F.col("u") / F.lit(SPACE // bins)).cast("int"))
    per_bin = written(sized.groupBy(F.col("own").alias("source"), "bin").agg(F.sum("size").alias("n")), "mix-bins")
    plan = targets(per_bin.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap)
    takes = F.least(F.round("target"), F.col("source_size") * cap).cast("long")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(takes / F.col("source_size"))).otherwise(0).cast("long"))
    plan = written(plan.withColumn("rest", takes - F.col("whole") * F.col("source_size")), "mix-shares")
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bin.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    p, b = plan.alias("p"), before.alias("b")
    ends = p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")), "left").where(F.col("b.before") < F.col("p.rest"))
    ends = ends.groupBy(F.col("p.source").alias("s")).agg(F.max(F.struct(F.col("b.bin").alias("bin"), F.col("b.before").alias("before"))).alias("e"))
    plan = plan.join(ends, plan["source"].eqNullSafe(ends["s"]), "left").select(
        plan["source"].alias("of"), "source_size", "target", "whole", F.coalesce("e.bin", F.lit(-1)).alias("end"), (F.col("rest") - F.coalesce("e.before", F.lit(0))).alias("last")
    )
    plan = written(plan, "mix-plan")
    rows = sized.join(plan, sized["own"].eqNullSafe(plan["of"]), "left")
    inside = rows.where(F.col("bin") != F.col("end")).withColumn("more", F.when(F.col("bin") < F.col("end"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("of").orderBy("u", "id", "size")
    used = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.where(F.col("bin") == F.col("end")).withColumn("more", F.least(F.col("size"), F.greatest(F.lit(0), F.col("last") - used)))
    out = inside.unionByName(edge)
    return out.select("r.*", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).alias("taken"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself, with these columns: a row for each whole repetition, and one with the first words for a part of a
    repetition. Rows of which nothing is taken (null, empty and wordless texts among them) are left out; an empty table gives
    an empty one."""
    rows = mixed.select(F.struct(*(mixed[c] for c in columns)).alias("r"), "text", "size", "taken")
    n, part = F.expr("taken div greatest(size, 1)"), F.expr("taken % greatest(size, 1)")
    whole = rows.where(n > 0).select("r", F.explode(F.sequence(F.lit(1), n)).alias("i")).select("r.*")
    cut = rows.where(part > 0).select("r", first_words(F.col("text"), part).alias("cut"))
    kinds = dict(mixed.dtypes)
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast(kinds.get("n_chars", "long"))}
    return whole.unionByName(cut.select(*(new.get(c, F.col("r").getField(c)).alias(c) for c in columns)))


def first_words(text: Column, n: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
