"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

A document of source s and size x gets the rate r in [0, top] that is closest to 1 in relative entropy
while the source's tokens, sum of r * x, meet the target. The optimum is an exponential tilt, stopped at
the bound: r = min(top, exp(l_s * x / unit_s)), where l_s solves a convex dual in one unknown per source. A
shuffle of counts makes a histogram of sizes of each source; Newton steps inside a bracket that a step must
not leave run on it, for all sources in parallel.

Rates become copies in order of falling size. All documents of a source and size share a whole number of
copies, as near to their rates as that goes, and what is over or missing, in tokens, is carried on to the
next smaller size; so a source misses its target by half of its least size or so, unless the bound stops it
before. The copies of a size are dealt evenly to its documents, in an order of hashes; a size that more than
``CELL`` documents share is dealt in salted parts, so no source or size has to fit one task.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is one source,
last in order; repeated rows are documents of their own (equal ids and sizes may swap copies); an empty
table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import Shelf

#: Documents in a cell at most, about.
CELL = 10_000
#: Sizes of a source that are rounded in one go (an array is copied for each).
STRETCH = 512
#: Rows of a small table (about 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), top: float = 3.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size): the sum of all sizes by weight, no source
    over ``top`` times its own. One row per source; the windows run over sources alone."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(top))
    # shares stop in order of limit / weight: the level is what is left for each unit of weight
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    weighed = weighed.withColumns({
        "level": (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    # the first source that its level does not fill sets the level for all that follow
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", F.col("level").alias("level")))).over(whole)
    share = F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", level["level"] * F.col("weight")))
    return weighed.select("source", "source_size", share.alias("target"))


def solve(cells: DataFrame, goals: DataFrame, top: float = 3.0, steps: int = 400, close: float = 1e-9) -> DataFrame:
    """(source, source_size, target, unit, sizes, tilt) with tilts that meet the targets; sizes is the
    histogram (size, n) by falling size. cells: (source, size, n) with size > 0.

    Sources whose target is their limit (or 0) have an infinite tilt of that sign. The bracket doubles
    until it holds the target and is halved where a Newton step does not halve the distance; a source that
    is not within ``close`` of its target after ``steps`` is an error."""
    histogram = F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes")  # as many as distinct sizes
    unit = F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))
    own = cells.groupBy(F.col("source").alias("of")).agg(unit.cast("double").alias("unit"), histogram)
    known = goals.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("target", F.col("target").cast("double"))
    inf = float("inf")

    def sums(tilt: Column) -> Column:
        """Tokens at a tilt, and their slope."""

        def add(acc: Column, c: Column) -> Column:
            x = c["size"] / F.col("unit")
            free = F.exp(tilt * x)
            weight = c["n"] * c["size"]
            return F.struct((acc["got"] + weight * F.least(F.lit(top), free)).alias("got"), (acc["slope"] + F.when(free < top, weight * x * free).otherwise(F.lit(0.0))).alias("slope"))

        return F.aggregate("sizes", F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope")), add)

    def step(s: Column, _: Column) -> Column:
        # an array of one, so that sums are made once
        return F.when(s["done"], s).otherwise(F.transform(F.array(sums(s["tilt"])), lambda now: moved(s, now))[0])

    def moved(s: Column, now: Column) -> Column:
        tilt, off = s["tilt"], now["got"] - F.col("target")
        low, high = F.when(off < 0, tilt).otherwise(s["low"]), F.when(off > 0, tilt).otherwise(s["high"])
        by = F.abs(off) / F.col("target")
        newton = tilt - F.when(now["slope"] > 0, off / now["slope"])
        wide = F.greatest(F.lit(8.0), F.abs(tilt))
        open_ = (low == -inf) | (high == inf)
        inside = (now["slope"] > 0) & (newton > low) & (newton < high) & (F.abs(newton - tilt) <= wide) & (open_ | (by <= s["off"] / 2))
        middle = F.when(low == -inf, tilt - wide / 2 - F.abs(tilt) / 2).when(high == inf, tilt + wide / 2 + F.abs(tilt) / 2).otherwise((low + high) / 2)
        done = by <= close
        return F.struct(F.when(done, tilt).when(inside, newton).otherwise(middle).alias("tilt"), low.alias("low"), high.alias("high"), by.alias("off"), done.alias("done"))

    fixed = F.when(F.col("target") >= F.col("source_size") * F.lit(top) * (1 - 1e-12), F.lit(inf)).when(F.col("target") <= 0, F.lit(-inf))
    begin = F.struct(F.coalesce(fixed, F.lit(0.0)).alias("tilt"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"), F.lit(inf).alias("off"), fixed.isNotNull().alias("done"))
    known = known.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step))
    far = F.raise_error(F.concat(F.lit("mixing: a source is off its target by "), F.col("state.off").cast("string"), F.lit(" of it")))
    return known.select("source", "source_size", "target", "unit", "sizes", F.when(F.col("state.done"), F.col("state.tilt")).otherwise(far.cast("double")).alias("tilt"))


def rounded(solved: DataFrame, top: int) -> DataFrame:
    """(source, source_size, target, size, n, rate, copies): how many copies the documents of a size get in
    all. What a size is over or under its rates is carried, in tokens, to the next smaller one."""
    none = F.array().cast("array<struct<size:bigint,n:bigint,rate:double,copies:bigint>>")
    rate = lambda c: F.when(F.col("tilt") == float("inf"), F.lit(float(top))).when(F.col("tilt") == float("-inf"), F.lit(0.0)).otherwise(F.least(F.lit(float(top)), F.exp(F.col("tilt") * c["size"] / F.col("unit"))))

    def one(acc: Column, c: Column) -> Column:
        wanted = acc["carry"] + c["n"] * c["size"] * rate(c)
        copies = F.least(F.greatest(F.floor(wanted / c["size"] + 0.5), F.lit(0)), c["n"] * top).cast("bigint")
        entry = F.struct(c["size"].cast("bigint").alias("size"), c["n"].cast("bigint").alias("n"), rate(c).alias("rate"), copies.alias("copies"))
        return F.struct((wanted - copies * c["size"]).cast("double").alias("carry"), F.concat(acc["out"], F.array(entry)).alias("out"))

    def stretch(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice("sizes", k * STRETCH + 1, F.lit(STRETCH)), F.struct(acc["carry"].alias("carry"), none.alias("out")), one)
        return F.transform(F.array(part), lambda p: F.struct(p["carry"].alias("carry"), F.concat(acc["out"], F.array(p["out"])).alias("out")))[0]

    begin = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<array<struct<size:bigint,n:bigint,rate:double,copies:bigint>>>").alias("out"))
    each = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / STRETCH).cast("int")), begin, stretch)["out"]
    out = solved.select("source", "source_size", "target", F.explode(F.flatten(each)).alias("e"))
    return out.select("source", "source_size", "target", "e.size", "e.n", "e.rate", "e.copies")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (1.0, 2.0, 3.0), top: int = 3, cell: int = CELL) -> DataFrame:
    """The columns of docs, then size, source_size, target, rate, copies (0 to ``top``) and taken."""
    p = "_mix_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = "_" + p
    shelf = Shelf(docs.sparkSession)
    rows = docs.withColumns({f"{p}source": F.col(f"`{source}`"), f"{p}size": word_count(F.col(f"`{text}`")), f"{p}dice": F.xxhash64(F.col(f"`{key}`"))})
    cells = shelf.put("cells", rows.groupBy(F.col(f"{p}source").alias("source"), F.col(f"{p}size").alias("size")).agg(F.count(F.lit(1)).alias("n")))
    n_cells, largest = cells.agg(F.count(F.lit(1)), F.max("n")).first()
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, float(top))
    plan = rounded(solve(cells.filter("size > 0"), goals, float(top)), top)
    empty = cells.filter("size = 0").join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("source", "source_size", "target", "size", "n", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    # a size that more than `cell` documents share is dealt to salts
    plan = shelf.put("plan", plan.union(empty).withColumn("salts", F.ceil(F.col("n") / F.lit(float(cell))).cast("int")))
    shelf.drop("cells")
    before = F.array(F.lit(0).cast("long"))
    if (largest or 0) > cell:
        large = plan.filter("salts > 1 AND copies > 0").select(F.col("source").alias("s"), F.col("size").alias("x"), "salts")
        counted = (
            rows.join(_small(large, n_cells), F.col(f"{p}source").eqNullSafe(F.col("s")) & (F.col(f"{p}size") == F.col("x")))
            .groupBy("s", "x", "salts", _salt(F.col(f"{p}dice"), F.col("salts")).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("s", "x", "salts").agg(F.map_from_entries(F.collect_list(F.struct("salt", "n"))).alias("parts"))
        )
        # documents in the salts before each
        running = F.aggregate(
            F.sequence(F.lit(0), F.col("salts") - 2), F.array(F.lit(0).cast("long")),
            lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.coalesce(F.col("parts")[k], F.lit(0).cast("long")))),
        )
        plan = plan.join(counted.select("s", "x", running.alias("running")), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("x")), "left").drop("s", "x")
        plan = shelf.put("dealt", plan)
        before = F.coalesce(F.col("running"), before)
    plan = plan.select(
        F.col("source").alias(f"{p}s"), F.col("size").alias(f"{p}x"), F.col("source_size").alias(f"{p}all"), F.col("target").alias(f"{p}target"), F.col("rate").alias(f"{p}rate"),
        F.col("n").alias(f"{p}n"), F.col("copies").alias(f"{p}copies"), F.col("salts").alias(f"{p}salts"), before.alias(f"{p}before"),
    )
    out = rows.join(_small(plan, n_cells), F.col(f"{p}source").eqNullSafe(F.col(f"{p}s")) & (F.col(f"{p}size") == F.col(f"{p}x")))
    out = out.withColumn(f"{p}salt", _salt(F.col(f"{p}dice"), F.col(f"{p}salts")))
    out = out.withColumn(f"{p}place", F.row_number().over(Window.partitionBy(f"{p}source", f"{p}size", f"{p}salt").orderBy(f"{p}dice")))
    place = F.coalesce(F.get(F.col(f"{p}before"), F.col(f"{p}salt")), F.lit(0)) + F.col(f"{p}place")
    given = lambda k: F.expr(f"({k}) * {p}copies DIV {p}n")
    out = out.withColumn(f"{p}at", place)
    new = {
        "size": F.col(f"{p}size"), "source_size": F.col(f"{p}all").cast("long"), "target": F.col(f"{p}target"), "rate": F.col(f"{p}rate"),
        "copies": (given(f"{p}at") - given(f"{p}at - 1")).cast("long"),
    }
    new["taken"] = new["copies"] * new["size"]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def _salt(dice: Column, salts: Column) -> Column:
    return F.when(salts > 1, F.pmod(F.xxhash64(dice), salts)).otherwise(F.lit(0)).cast("int")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the rows, counted before, are few; else Spark shuffles both sides."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table
