"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

A block is ``BLOCK`` words of a source's documents in a hashed order, read twice over (``most`` times); its last one ends with
its target, so what is taken of each source is its target, rounded. Slot ``n`` of the schedule has the point frac((n + 1/2) *
golden ratio); the sources' numbers of blocks, laid end to end, say whose slot that is, and the slot's rank among its source's
slots is the block it takes. Every prefix of the schedule holds the sources in proportion, to a few blocks. Slots are made
until each source has one for each of its blocks: two points of an interval are at most 2.62 over its length apart, so 2.62
times as many slots as blocks do. A document's position is the slot of the first block that takes words of it.

A source's running offset is a sum within hash strata plus the sum of the strata before, and a slot's
rank is a count within a chunk of slots plus the counts of the chunks before, so no source, however
large, is sorted in one task. Blocks and slots grow with the words that are taken.

Defined results: null and empty texts have size 0 and nothing taken; a null source is a source of its
own and comes last; repeated rows are rows of their own; ties in the hashed order go by id, then by
text; an empty table gives an empty result; extra columns are not read, or passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
#: Words of a block.
BLOCK = 2048
STRATA, CHUNK, CELLS = 1024, 1 << 16, 4096
#: Sources up to which their table is broadcast.
MOST_BROADCAST = 50_000
_GOLDEN = 0.6180339887498949
#: The golden ratio times 2^16, less its whole part, so that points of late slots keep their digits.
_GOLDEN_HIGH = 0.4754867131087718


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(s, source, source_size, target) of each source; ``sizes`` has source and size.

    Where a source's share would pass ``most`` times its size it stops there. Sorted by the level of
    resharing at which each stops, the stopped ones come first, so one running sum finds the level.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("s") - 1) % len(weights) + 1).cast("int"))
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, before = W.orderBy(F.col("source").isNull(), "source"), W.orderBy("stop", "s").rowsBetween(W.unboundedPreceding, -1)
    rows = total.withColumn("s", F.row_number().over(by_name)).withColumn("w", weight).withColumn("cap", most * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("w"))
    rows = rows.withColumns({"all": share * F.sum("source_size").over(W.partitionBy()), "w_all": F.sum("w").over(W.partitionBy()), "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "ws": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    rows = rows.withColumn("level", (F.col("all") - F.col("caps")) / (F.col("w_all") - F.col("ws")))
    rows = rows.withColumn("at", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "s", "level"))).over(W.partitionBy()))
    return rows.select("s", "source", "source_size", F.least("cap", F.coalesce(F.col("at.level") * F.col("w"), F.col("cap"))).alias("target"))


def _point(n: Column) -> Column:
    """frac((n + 1/2) * golden ratio), from the upper and the lower 16 bits' parts."""
    x = F.shiftright(n, 16) * _GOLDEN_HIGH + (n.bitwiseAND(0xFFFF) + 0.5) * _GOLDEN
    return x - F.floor(x)


def schedule(sources: DataFrame) -> DataFrame:
    """(s, block, position): a slot for each block; ``sources`` has s and blocks."""
    upto = W.orderBy("s")
    total = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    n = int(2.62 * total) + 8
    line = sources.where("blocks > 0").withColumn("high", F.sum("blocks").over(upto) / max(total, 1))
    line = line.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0))).withColumn("high", F.when(F.lead("s").over(upto).isNull(), 1.0).otherwise(F.col("high")))
    cell = F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))))
    line = line.select("s", "blocks", "low", "high", cell.alias("cell"))
    slots = sources.sparkSession.range(n).withColumn("u", _point(F.col("id"))).withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = slots.join(line, "cell").where("low <= u and u < high").select("s", "blocks", "id", F.floor(F.col("id") / CHUNK).alias("chunk"))
    earlier = W.partitionBy("s").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("s", "chunk").count().withColumn("earlier", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    ranked = dealt.withColumn("r", F.row_number().over(W.partitionBy("s", "chunk").orderBy("id")))
    ranked = ranked.join(counts.drop("count"), ["s", "chunk"]).withColumn("block", F.col("r") - 1 + F.col("earlier"))
    ranked = ranked.where("block < blocks").select("s", "block", F.col("id").alias("position"))
    # an interval below the points' digits may lack some: they come last
    lack = sources.where("blocks > 0").join(counts.groupBy("s").agg(F.sum("count").alias("got")), "s", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    lack = lack.where("got < blocks").select("s", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("block"))
    return ranked.unionByName(lack.select("s", "block", (F.lit(n) + F.col("block")).alias("position")))


def _placed(rows: DataFrame, sources: DataFrame, small: bool, seed: int, last: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (id, source, size, tie, ...) with s, source_size, target, stratum, nth and the offset within the stratum; ``last`` orders rows equal in the others."""
    key = F.xxhash64(F.lit(seed), "id", "tie")
    rows = rows.withColumn("key", key).withColumn("stratum", F.pmod("key", F.lit(STRATA)))
    rows = rows.join((F.broadcast(sources) if small else sources).withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    order = W.partitionBy("s", "stratum").orderBy("key", "id", "tie", *last)
    return rows.withColumn("nth", F.row_number().over(order)).withColumn("within", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))


def _taken(placed: DataFrame, sources: DataFrame, most: int, block_words: int, more: tuple[str, ...] = ()) -> DataFrame:
    """``placed`` without within, and with taken and position; ``more`` names columns that are kept beside."""
    words = sources.select("s", F.floor(F.col("target") + 0.5).alias("words")).withColumn("blocks", F.ceil(F.col("words") / block_words))
    dealt = schedule(words)
    earlier = W.partitionBy("s").orderBy("stratum").rowsBetween(W.unboundedPreceding, -1)
    strata = placed.groupBy("s", "stratum").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = placed.join(strata.join(words.drop("blocks"), "s"), ["s", "stratum"]).withColumn("start", F.col("base") + F.col("within"))
    reads = F.explode_outer(F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: e * F.col("source_size") + F.col("start"))))
    own = own.withColumn("from", reads).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
    first, last = F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words)
    # what lies beyond the target has no slot; the negative numbers only spread it
    own = own.withColumn("block", F.explode(F.when(F.col("from") < F.col("to"), F.sequence(first, last)).otherwise(F.array(-1 - F.col("nth").cast("long")))))
    got = own.join(dealt, ["s", "block"], "left")
    overlap = F.least(F.col("to"), (F.col("block") + 1) * block_words) - F.greatest(F.col("from"), F.col("block") * block_words)
    keys = ["s", "stratum", "nth", "id", "size", "source_size", "target", *more]
    return got.groupBy(*keys).agg(F.sum(F.when(F.col("position").isNotNull(), overlap).otherwise(0)).cast("long").alias("taken"), F.min("position").alias("position"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, slots: int | None = None, seed: int = 17) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, position (null where nothing is taken).
    ``slots`` asks for about so many blocks in all instead of blocks of ``block`` words."""
    rows = common.cut(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie")))
    sources, small, block = _sources(rows, weights, share, most, block, slots)
    placed = _placed(rows, sources, small, seed).drop("key", "tie", "source")
    out = _taken(placed, sources, most, block)
    return out.select(F.col("id").alias(id), "size", "source_size", "target", "taken", "position")


def _sources(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int, slots: int | None) -> tuple[DataFrame, bool, int]:
    sources = common.cut(targets(rows, weights, share, most))
    got = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t"), F.count("*").alias("n")).first()
    return sources, got["n"] <= MOST_BROADCAST, block if slots is None else max(1, -(-int(got["t"]) // slots))


def mix_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, slots: int | None = None, seed: int = 17, position: bool = False) -> DataFrame:
    """The documents of the mix with all their columns and size, source_size, target, taken (and position); a document
    of which no word is taken is not part of it. Columns of ``docs`` with those names give way.

    The mix is made of numbers alone; texts are dealt once, by a key of the whole row, to meet what is taken of them. Rows
    equal in all columns share a key: how many of them give how many words is a short list, which they go through in turn, and all stand at the first one's position."""
    new = ("size", "source_size", "target", "taken", *(["position"] if position else []))
    kept = [c for c in docs.columns if c not in new]
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    whole = F.unhex(F.md5(F.to_json(F.struct(*(docs[c] for c in kept)), {"ignoreNullFields": "false"})))
    rows = common.cut(docs.select(docs[id].alias("id"), docs[source].alias("source"), n_words(text).alias("size"), F.xxhash64(docs[text]).alias("tie"), whole.alias("row")))
    sources, small, block = _sources(rows, weights, share, most, block, slots)
    placed = _placed(rows, sources, small, seed, ("row",)).drop("key", "tie", "source")
    taken = _taken(placed, sources, most, block, ("row",)).where("taken > 0")
    # equal rows follow each other, so there are few different numbers of words taken of them
    times = taken.groupBy("row", "size", "source_size", "target", "taken").agg(F.count("*").alias("n"), F.min("position").alias("position"))
    lists = times.groupBy("row", "size", "source_size", "target").agg(F.reverse(F.array_sort(F.collect_list(F.struct("taken", "n")))).alias("steps"), F.min("position").alias("position"))
    lists = lists.select(F.col("row").alias(mark + "key"), *(F.col(c).alias(mark + c) for c in ("size", "source_size", "target", "steps", "position")))
    one = W.partitionBy(mark + "key").orderBy(mark + "key")
    own = docs.select(*(docs[c] for c in kept), whole.alias(mark + "key")).join(lists, mark + "key").withColumn(mark + "nth", F.row_number().over(one))
    step = F.aggregate(mark + "steps", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("taken")), lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.when((F.col(mark + "nth") > a["upto"]) & (F.col(mark + "nth") <= a["upto"] + x["n"]), x["taken"]).otherwise(a["taken"]).alias("taken")))
    out = own.withColumn(mark + "taken", step["taken"]).where(F.col(mark + "taken") > 0)
    return out.select(*kept, *(F.col(mark + c).alias(c) for c in new))
