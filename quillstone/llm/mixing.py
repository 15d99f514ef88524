"""Mixing sources to target weights by a low-discrepancy schedule.

The mix takes as many words as there are. Each source has a weight; targets are shares of all words by weight, stop at
CAP times the source's size, and what is over goes to the other sources by weight until none is above. A source's
documents are shuffled (by a hash of the id), laid end to end, and cut into blocks of equal size. Slot i of the schedule
is a golden-ratio point: i times the golden ratio modulo 1, in 62-bit integers, so there are more points than slots ever. The point falls into a source's interval
of the cumulative weights. The slots of a source are ranked; slot number r takes block r modulo the number of blocks,
until the source has the slots that its target asks for; slots that found no point among those made follow at the end. A document has taken the words of it that lie in taken blocks.

Nothing hangs on one source being small: positions and ranks are running sums in two levels (buckets of a hash, chunks of
slots), so no task holds a whole source. Only tables with a row per source, bucket or chunk are summed in one order: the targets of
all sources are made in one task, which a few million of them fit. Documents of size 0 take part in no join.

Defined cases: null text has size 0, and size 0 takes nothing; a null source is a source of its own, the last; repeated
rows are separate documents; an empty table gives an empty one; only the id, source and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Workspace, spread

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a block; sources of under LEAST_BLOCKS blocks have smaller blocks.
BLOCK, LEAST_BLOCKS = 1024, 256
#: Points are integers below WHOLE; GOLDEN is WHOLE divided by the golden ratio, as an odd integer.
WHOLE = 1 << 62
GOLDEN = 2850178704830799621
BUCKETS, CHUNK, CELLS = 4096, 1 << 16, 4096
#: Slots beyond those needed, so that sources whose points come late still fill.
SPARE = 0.05
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, size (words) and place (hash that shuffles)."""
    return spread(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))).select(
        "id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("place"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row per source: sid, source, source_size, weight, target, block (words), blocks and slots."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
    by_room = Window.orderBy(CAP * F.col("source_size") / F.col("weight"), "sid")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("full", CAP * F.col("source_size") < F.col("level") * F.col("weight"))
    share = F.min(F.when(~F.col("full"), F.struct(CAP * F.col("source_size") / F.col("weight"), "sid", "level"))).over(everything)["level"]
    rows = rows.withColumn("target", F.least((CAP * F.col("source_size")).cast("double"), share * F.col("weight")))
    rows = rows.withColumn("block", F.least(F.lit(BLOCK).cast("long"), F.greatest(F.lit(1).cast("long"), F.expr(f"source_size div {LEAST_BLOCKS}"))))
    rows = rows.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - passes * F.col("source_size")
    rows = rows.withColumn("slots", F.least(CAP * F.col("blocks"), passes * F.col("blocks") + F.least(F.col("blocks"), F.round(rest / F.col("block")).cast("long"))))
    return rows.select("sid", "source", "source_size", "weight", "target", "block", "blocks", "slots")


def point(i: Column) -> Column:
    """i * GOLDEN modulo WHOLE; a product of 18 digits and 19 fits a decimal."""
    return (i.cast("decimal(18,0)") * F.lit(GOLDEN).cast("decimal(19,0)") % F.lit(WHOLE).cast("decimal(19,0)")).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """sid and rank of the slots that count, in a table of as many rows as the mix has blocks."""
    spark = sources.sparkSession
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sources.where("slots > 0").withColumn("high", F.sum("slots").over(upto)).withColumn("all", F.sum("slots").over(every))

    def edge(slots: str) -> Column:
        return F.expr(f"(cast({slots} AS decimal(18,0)) * cast({WHOLE} AS decimal(19,0))) div cast(all AS decimal(18,0))")

    bounds = weighed.select("sid", "slots", edge("high - slots").alias("low"), edge("high").alias("high"))
    width = WHOLE // CELLS
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"greatest(low, high - 1) div {width}"))))
    count = sources.agg(F.sum("slots")).first()[0] or 0
    slots = spark.range(int(count * (1 + SPARE)) + 64 if count else 0).withColumn("u", point(F.col("id"))).withColumn("cell", F.expr(f"u div {width}"))
    placed = slots.join(cells, "cell").where("u >= low AND u < high").select("sid", "slots", "id", F.expr(f"id div {CHUNK}").alias("chunk"))
    within = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")) - 1
    earlier = placed.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    earlier = earlier.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    ranked = placed.withColumn("within", within).join(earlier, ["sid", "chunk"]).select("sid", "slots", (F.col("before") + F.col("within")).alias("rank")).where("rank < slots")
    found = placed.groupBy(F.col("sid").alias("of")).agg(F.count("*").alias("found"))
    late = sources.where("slots > 0").join(found, F.col("sid") == F.col("of"), "left").withColumn("found", F.coalesce("found", F.lit(0)))
    late = late.where("found < slots").select("sid", F.explode(F.expr("sequence(found, slots - 1)")).alias("rank"))
    return ranked.select("sid", "rank").unionByName(late)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """id_col, size, source_size, target and taken of each document. The texts are read once; the rest works on sizes."""
    space = Workspace(docs.sparkSession, "mixing")
    sized = space.keep(sizes(docs, id_col, source_col, text_col), "sizes")
    sources = space.keep(targets(sized, weights), "sources")
    bucketed = sized.withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    by_bucket = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = by_bucket.select(F.col("source").alias("of"), F.col("bucket").alias("in"), (running - F.col("n")).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = bucketed.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("place", "id", "size")))
    laid = laid.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    laid = laid.select("id", "source", "bucket", "nth", "size", (F.col("start") + F.col("upto") - F.col("size")).alias("low"), (F.col("start") + F.col("upto")).alias("high"))
    laid = laid.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    full = laid.where("size > 0")
    pieces = full.withColumn("number", F.explode(F.sequence(F.expr("low div block"), F.expr("(high - 1) div block"))))
    overlap = F.least("high", (F.col("number") + 1) * F.col("block")) - F.greatest("low", F.col("number") * F.col("block"))
    pieces = pieces.select("sid", "bucket", "nth", "id", "size", "source_size", "target", "number", overlap.alias("overlap"))
    taken = schedule(sources).join(sources.select("sid", "blocks"), "sid").groupBy("sid", (F.col("rank") % F.col("blocks")).alias("number")).agg(F.count("*").alias("times"))
    joined = pieces.join(taken, ["sid", "number"], "left")
    out = joined.groupBy("sid", "bucket", "nth", "id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("overlap") * F.col("times")), F.lit(0)).alias("taken"))
    empty = laid.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    out = out.select("id", "size", "source_size", "target", "taken").unionByName(empty)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")
