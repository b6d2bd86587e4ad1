"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and repeated up to ``MAX_REPEATS`` times in that order. A
document's virtual finish time is its source's words up to and including it, divided by the source's target; all
documents are ordered by it, and the mix ends where the total budget is spent.

Running totals are summed by slices: a slice of the shuffled order holds about ``SLICE_ROWS`` documents however large its
source is, and only slice totals are accumulated across slices, in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paypulse.llm.shared import SPACE, cut

#: No source's target, and no document, is taken more often than this.
MAX_REPEATS = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
SLICE_ROWS = 100
#: Slices of virtual time for each doubling of the time that has passed since 1.
TIME_SLICES = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_rank, source_rows, source_size, target) of ``sizes`` (source, size).

    Targets share the sum of all sizes by weight; a target stops at ``MAX_REPEATS`` times its source's size, and the
    excess is shared by weight among the others. In the order of cap divided by weight, the level (share per unit of
    weight) rises while sources are capped and falls after, so the final level is the largest.
    """
    cycle = F.array(*(F.lit(w) for w in weights))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("source_rank", F.row_number().over(by_name))
    sources = sources.withColumn("weight", cycle[(F.col("source_rank") - 1) % len(weights)].cast("long"))
    sources = sources.withColumn("cap", F.col("source_size") * MAX_REPEATS)
    upwards = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "source_rank")
    everything = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lower = F.coalesce(F.sum("cap").over(upwards.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavier = F.sum("weight").over(upwards.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    sources = sources.withColumn("share", (total - lower).cast("double") / heavier.cast("double"))
    level = F.max("share").over(everything)
    target = F.least(F.col("cap").cast("double"), level * F.col("weight").cast("double"))
    return sources.select("source", "source_rank", "source_rows", "source_size", target.alias("target"))


def _words_before(sized: DataFrame) -> DataFrame:
    """``sized`` with ``before``: the words of its source's documents earlier in the shuffled order."""
    n = F.greatest(F.lit(1), F.floor(F.col("source_rows") / SLICE_ROWS))
    position = F.shiftright(F.col("shuffled"), 22)  # 30 of its 52 bits
    sliced = sized.withColumn("slices", n).withColumn("slice", F.shiftright(position * F.col("slices"), 30))
    totals = sliced.groupBy("source_rank", "slices", "slice").agg(F.sum("size").alias("words"))
    totals = totals.withColumn("coarse", F.floor(F.col("slice") / F.ceil(F.sqrt("slices"))))
    coarse = totals.groupBy("source_rank", "coarse").agg(F.sum("words").alias("words"))
    so_far = (Window.unboundedPreceding, -1)
    by_coarse = Window.partitionBy("source_rank").orderBy("coarse").rowsBetween(*so_far)
    coarse = coarse.select("source_rank", "coarse", F.coalesce(F.sum("words").over(by_coarse), F.lit(0)).alias("base"))
    by_slice = Window.partitionBy("source_rank", "coarse").orderBy("slice").rowsBetween(*so_far)
    totals = totals.withColumn("inner", F.coalesce(F.sum("words").over(by_slice), F.lit(0)))
    starts = totals.join(coarse, ["source_rank", "coarse"]).select(
        "source_rank", "slice", (F.col("base") + F.col("inner")).alias("slice_start")
    )
    inside = Window.partitionBy("source_rank", "slice").orderBy("shuffled", "doc_id", "size").rowsBetween(*so_far)
    joined = sliced.join(starts, ["source_rank", "slice"])
    return joined.withColumn("before", F.col("slice_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


#: The order of the mix: virtual finish time, then fixed ties.
_ORDER = ("finish", "source_rank", "repeat", "shuffled", "doc_id", "size")


def _cut_off(turns: DataFrame, budget: int) -> tuple | None:
    """The first of ``turns`` in the order of the mix at which the running total exceeds ``budget``; None: there is none.

    Totals of slices of time find the slice it lies in; only that slice is ordered in one task. Slices are narrow next to
    the time since 1, and the mix ends about one document of each source after 1.
    """
    sliced = turns.withColumn("time_slice", F.floor(F.log2(F.col("finish") - 1) * TIME_SLICES))
    totals = sliced.groupBy("time_slice").agg(F.sum("size").alias("words"))
    running = totals.withColumn("total", F.sum("words").over(Window.orderBy("time_slice")))
    first = running.where(F.col("total") > budget).orderBy("time_slice").first()
    if first is None:
        return None
    left = budget - (first["total"] - first["words"])
    inside = sliced.where(F.col("time_slice") == first["time_slice"])
    total = F.sum("size").over(Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0))
    return tuple(inside.withColumn("total", total).where(F.col("total") > left).orderBy(*_ORDER).select(*_ORDER).first())


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, copies, first_finish.

    size: its words, ``[^\\x20\\x09-\\x0D]+`` (null text: 0). A null source is a source of its own, the last one. taken is
    size times copies; documents without words are never taken. The order depends on ids and sizes alone, so reruns
    agree; rows that repeat an id and size may stand for each other. An empty table gives an empty result. Other columns
    are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    digits = F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 1, 13)
    sizes = cut(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size.alias("size"),
        F.conv(digits, 16, 10).cast("long").alias("shuffled"),
    ))
    targets = cut(source_targets(sizes, weights)).withColumnRenamed("source", "name")
    sized = sizes.join(targets, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = cut(_words_before(sized).drop("slices", "slice", "slice_start"))
    repeats = F.array(*(F.lit(k) for k in range(MAX_REPEATS)))

    def finish(repeat: Column) -> Column:
        words = repeat * F.col("source_size") + F.col("before") + F.col("size")
        return F.when(F.col("size") == 0, 0.0).otherwise(words.cast("double") / F.col("target"))

    turns = placed.where("size > 0").withColumn("repeat", F.explode(repeats)).withColumn("finish", finish(F.col("repeat")))
    budget = sizes.agg(F.sum("size")).first()[0] or 0
    in_time = turns.where("finish <= 1").agg(F.sum("size")).first()[0] or 0
    end = _cut_off(turns.where("finish > 1"), budget - in_time)

    def taken(repeat: Column) -> Column:
        if end is None:
            return F.col("size") > 0
        own = F.struct(
            finish(repeat), F.col("source_rank").cast("int"), repeat, F.col("shuffled"), F.col("doc_id"), F.col("size")
        )
        cut_off = F.struct(
            F.lit(end[0]), F.lit(end[1]).cast("int"), F.lit(end[2]), F.lit(end[3]).cast("long"),
            F.lit(end[4]).cast(dict(placed.dtypes)["doc_id"]), F.lit(end[5]).cast("long"),
        )
        return (F.col("size") > 0) & (own < cut_off)

    copies = sum((taken(F.lit(k)).cast("int") for k in range(MAX_REPEATS)), F.lit(0))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
        copies.alias("copies"), finish(F.lit(0)).alias("first_finish"), F.col("source_rank"),
    )


def _numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[Column, ...], name: str) -> DataFrame:
    """``rows``, cut, with a number from 1 among those with equal ``keys``. A key's rows are numbered where they are, from what
    the tasks before hold of it, so that none has to fit into one task."""
    rows = cut(rows.withColumn("__task", F.spark_partition_id()))
    held = rows.groupBy(*keys, "__task").agg(F.count("*").alias("__held"))
    earlier = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__earlier", F.coalesce(F.sum("__held").over(earlier), F.lit(0))).drop("__held")
    held = held.withColumnsRenamed({k: f"__h_{k}" for k in (*keys, "__task")}).alias("h")
    same = F.col("__task") == F.col("h.__h___task")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"h.__h_{k}"))
    own = F.row_number().over(Window.partitionBy(*keys, "__task").orderBy(*order))
    return rows.withColumn("__own", own).join(held, same).withColumn(name, F.col("__own") + F.col("__earlier")).drop(
        "__task", "__own", "__earlier", *(f"__h_{k}" for k in (*keys, "__task"))
    )


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, in its order, with their columns.

    Rows that repeat an id, source and size are told apart by a number, so that together they are taken as often as
    ``mix_sources`` says, and its budget holds.
    """
    keys = ("__doc_id", "__source", "__size")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    mixed = cut(mix_sources(docs, weights).select(
        *(F.col(k.removeprefix("__")).alias(k) for k in keys), F.col("copies").alias("__copies"),
        F.col("first_finish").alias("__finish"), (F.col("source_size") / F.col("target")).alias("__round"),
    ))
    repeated = cut(mixed.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1 and __size > 0").drop("__n"))
    documents = docs.withColumn("__size_of", size)
    renamed = {k: f"__m_{k}" for k in keys}

    def same(to: str, extra: Column | None = None) -> Column:
        pairs = zip(("doc_id", "source", "__size_of"), keys, strict=True)
        found = [F.col(f"d.{a}").eqNullSafe(F.col(f"{to}{b}")) for a, b in pairs]
        return found[0] & found[1] & found[2] if extra is None else found[0] & found[1] & found[2] & extra

    taken = mixed.where("__copies > 0")
    several = not repeated.isEmpty()
    if several:
        again = repeated.withColumnsRenamed(renamed).alias("r")
        of_row = [F.col(f"m.{k}").eqNullSafe(F.col(f"r.__m_{k}")) for k in keys]
        is_repeated = of_row[0] & of_row[1] & of_row[2]
        taken = taken.alias("m").join(again, is_repeated, "left_anti")
    out = documents.alias("d").join(taken.alias("t"), same("t."))
    if several:
        order = (F.col("__finish"), F.col("__copies"))
        own = mixed.alias("m").join(again, is_repeated, "left_semi")
        own = _numbered(own, keys, order, "__number").where("__copies > 0")
        rows = documents.alias("d").join(repeated.alias("t"), same("t."), "left_semi")
        rows = _numbered(rows, ("doc_id", "source", "__size_of"), (F.xxhash64("text"),), "__row")
        out = out.unionByName(rows.alias("d").join(own.alias("t"), same("t.", F.col("d.__row") == F.col("t.__number"))).drop("__row", "__number"))
    out = out.withColumn("__repeat", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    time = F.col("__finish") + F.col("__repeat") * F.col("__round")
    return out.orderBy(time, "__doc_id").select(*docs.columns)
