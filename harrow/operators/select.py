"""Choosing candidates: ranked, in bands, at random; and mixing, chunking and splitting of datasets.

Random orders are by a hash of a seed and the id: the same on every engine and every run, not the
permutation of any other generator. Global ranks are by :func:`ranked`, which sorts by range and adds the
counts of the partitions before, so no single task sorts everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.sources.tables import cut


#: Rows that one task may gather for a top n.
MOST_HEAP = 10_000


def hash_order(seed: int, id: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id).cast("string")))


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds a rank from 1 in a total ``order`` (ties broken by it): a range partitioning, ranks within each
    partition and the sizes of the partitions before, of which there is one row each. The partitioned rows
    are written first, as bounds that are sampled twice could differ."""
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    local = cut(own.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy("__i"))))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    sizes = local.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return local.join(F.broadcast(sizes), "__p").withColumn(name, (F.col("__r") + F.col("__b")).cast("long")).drop("__p", "__i", "__r", "__b")


def top(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` in ``order``. Few are the first of each partition's own first n; many, such as a share of the rows, would
    meet in one task so, and are cut at their rank."""
    if n <= MOST_HEAP:
        return df.orderBy(*order).limit(n)
    return ranked(df, order, "__rank").where(F.col("__rank") <= n).drop("__rank")


def top_scores(scores: DataFrame, n: int, descending: bool = True, id: str = "group_id", score: str = "score", line: str | None = None) -> DataFrame:
    """Ids of the first ``n`` rows by score, ties by line (else id); an id that comes twice is listed once."""
    key = F.desc(score) if descending else F.asc(score)
    return top(scores, n, [key, line or id]).select(id).distinct()


def top_lines(scores: DataFrame, lines: DataFrame, n: int, id: str = "group_id", score: str = "score", line: str = "line") -> DataFrame:
    """The first ``n`` rows by score, ties by id, with their place from 1 and what stands in the line of that number (null where
    there is none). Only the chosen ids meet the lines."""
    chosen = ranked(top(scores.select(id, score), n, [F.desc(score), F.asc(id)]), [F.desc(score), F.asc(id)], "place")
    return chosen.join(lines.withColumnRenamed(line, "__line"), F.col(id) == F.col("__line"), "left").drop("__line")


def rank_list(scores: DataFrame, n: int, id: str = "group_id", score: str = "score") -> DataFrame:
    """All rows with rank and whether they are among the first ``n``."""
    return ranked(scores, [F.desc(score), F.asc(id)]).withColumn("selected", F.col("rank") <= n)


def top_half(scores: DataFrame, eligible: str = "eligible", id: str = "group_id", score: str = "score") -> DataFrame:
    """Exactly half of the pool, from eligible rows only and without refill; an odd pool, or too few eligible
    rows, is an error."""
    size = scores.agg(F.count("*").alias("n"), F.count_if(eligible).alias("e")).first()
    if size["n"] % 2 or size["e"] < size["n"] // 2:
        raise ValueError(f"half of {size['n']} rows cannot be chosen from {size['e']} eligible ones")
    return top(scores.where(eligible), size["n"] // 2, [F.desc(score), F.asc(id)])


def join_accuracy(scores: DataFrame, accuracy: DataFrame, id: str = "group_id") -> DataFrame:
    return scores.join(accuracy.select(id, "accuracy"), id)


def uncertainty_weighted(scores: DataFrame, accuracy: DataFrame, id: str = "group_id") -> DataFrame:
    """Score times 4 a (1 - a)."""
    a = F.col("accuracy")
    return join_accuracy(scores, accuracy, id).withColumn("score", F.col("score") * 4 * a * (1 - a))


def closest_to_half(accuracy: DataFrame, n: int, id: str = "group_id") -> DataFrame:
    return top(accuracy, n, [F.abs(F.col("accuracy") - 0.5), F.asc(id)])


def accuracy_band(accuracy: DataFrame, low: float, high: float, n: int, seed: int, most_id: int | None = None, id: str = "group_id") -> DataFrame:
    """``n`` hashed picks of ids under ``most_id`` with an accuracy in [low, high]."""
    rows = accuracy.where(F.col("accuracy").between(low, high))
    return top(rows if most_id is None else rows.where(F.col(id) < most_id), n, [hash_order(seed, id), F.asc(id)])


def random_pick(df: DataFrame, n: int, seed: int, id: str, strict: bool = False) -> DataFrame:
    if strict and df.limit(n).count() < n:
        raise ValueError(f"there are fewer than {n} rows")
    return top(df, n, [hash_order(seed, id), F.asc(id)])


def cut_report(ranks: DataFrame, n: int, last: int = 10) -> DataFrame:
    """The last rows above the cut."""
    return ranks.where((F.col("rank") <= n) & (F.col("rank") > n - last))


def manifest(ranks: DataFrame, reason: Column | None = None) -> DataFrame:
    """One row: counts, share, cutoff and extremes of a rank list, and a map of counts by ``reason``, if that is given."""
    s, on = F.col("score"), F.col("selected")
    one = ranks.agg(F.count("*").alias("pool"), F.count_if(on).alias("chosen"), F.avg(on.cast("double")).alias("share"), F.min(F.when(on, s)).alias("cutoff"), F.min(s).alias("least"), F.max(s).alias("most"))
    if reason is None:
        return one
    each = ranks.groupBy(F.coalesce(reason.cast("string"), F.lit("none")).alias("r")).agg(F.count("*").alias("n"))
    return one.crossJoin(F.broadcast(each.agg(F.map_from_entries(F.collect_list(F.struct("r", "n"))).alias("reasons"))))


def rows_of(ids: DataFrame, rows: DataFrame, id: str, line: str) -> DataFrame:
    """The rows whose id is selected, in the order of their lines; an id selected twice gives no row twice."""
    return rows.join(ids.select(id), id, "left_semi").orderBy(line)


def by_sample(df: DataFrame, group: str = "group_id", sample: str = "sample_id") -> DataFrame:
    """Ordered by group and sample; a row that lacks either fails the query."""
    whole = F.col(group).isNotNull() & F.col(sample).isNotNull()
    return df.where(F.assert_true(whole, F.lit(f"a row lacks {group} or {sample}")).isNull()).orderBy(group, sample)


def mix(parts: list[DataFrame], seed: int, id: str, index: str = "index") -> DataFrame:
    """All parts in one hashed order, indexed from 0."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return ranked(rows, [hash_order(seed, id), F.asc(id)], index).withColumn(index, F.col(index) - 1)


def line_range(df: DataFrame, skip: int, n: int, line: str) -> DataFrame:
    """Lines skip + 1 to skip + n."""
    return df.where(F.col(line).between(skip + 1, skip + n))


def chunks(df: DataFrame, size: int, seed: int, id: str) -> DataFrame:
    """Adds chunk: floor(total / size) chunks in a hashed order, the rest dropped; fewer rows than a chunk are one."""
    rows = ranked(df, [hash_order(seed, id), F.asc(id)], "__at").crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    chunk = F.floor((F.col("__at") - 1) / size)
    keep = (F.col("__n") < size) | (chunk < F.floor(F.col("__n") / size))
    return rows.where(keep).withColumn("chunk", F.when(F.col("__n") < size, F.lit(0).cast("long")).otherwise(chunk)).drop("__at", "__n")


def split(df: DataFrame, share: float, seed: int, id: str) -> DataFrame:
    """Adds part: "train" for the first ``share`` in a hashed order, else "test"."""
    rows = ranked(df, [hash_order(seed, id), F.asc(id)], "__at").crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    return rows.withColumn("part", F.when(F.col("__at") <= F.floor(F.col("__n") * share), "train").otherwise("test")).drop("__at", "__n")


def refill(df: DataFrame, keep: Column, order: list[str]) -> DataFrame:
    """The rows that pass, repeated in order until there are as many as before; adds index."""
    n = df.agg(F.count("*").alias("n"), F.count_if(keep).alias("m")).first()
    if not n["m"]:
        return df.limit(0).withColumn("index", F.lit(0).cast("long"))
    kept = ranked(df.where(keep), order, "__at").withColumn("__at", F.col("__at") - 1)
    times = F.floor((F.lit(n["n"]) - 1 - F.col("__at")) / n["m"])
    return kept.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), times))).withColumn("index", F.col("__at") + F.col("__k") * n["m"]).drop("__at", "__k")


def varied_groups(df: DataFrame, group: str = "group_id", reward: str = "reward") -> DataFrame:
    """Groups whose rewards differ, or that have one row."""
    w = W.partitionBy(group)
    return df.withColumn("__d", F.stddev_pop(reward).over(w)).withColumn("__n", F.count("*").over(w)).where("__d > 0 or __n = 1").drop("__d", "__n")


def bounded_accuracy(df: DataFrame, low: float, high: float, share: float, group: str = "group_id", sample: str = "sample_id") -> DataFrame:
    """Rows of groups whose accuracy is within bounds come first; ``share`` of all rows stays."""
    acc = F.avg(F.col("passed").cast("double")).over(W.partitionBy(group))
    rows = df.withColumn("__ok", acc.between(low, high))
    n = df.count()
    return top(rows, int(n * share), [F.desc("__ok"), F.asc(group), F.asc(sample)]).drop("__ok")


def untruncated_accuracy(df: DataFrame, low: float, high: float, most_length: int, share: float, group: str = "group_id", sample: str = "sample_id", length: str = "length") -> DataFrame:
    """As :func:`bounded_accuracy`, but groups with a response of ``most_length`` - 1 tokens or more come last too."""
    w = W.partitionBy(group)
    ok = F.avg(F.col("passed").cast("double")).over(w).between(low, high) & (F.max(length).over(w) < most_length - 1)
    return top(df.withColumn("__ok", ok), int(df.count() * share), [F.desc("__ok"), F.asc(group), F.asc(sample)]).drop("__ok")


def accumulated_groups(df: DataFrame, need: int, most_batches: int, batch: str = "batch", group: str = "group_id", reward: str = "reward") -> DataFrame:
    """Varied groups of as many batches, in order, as it takes to have ``need`` of them, the rest cut by group;
    too few within ``most_batches`` (0: any number) are an error."""
    varied = varied_groups(df, group, reward)
    groups = varied.select(batch, group).distinct()
    if most_batches:
        groups = groups.join(top(df.select(batch).distinct(), most_batches, [F.asc(batch)]), batch, "left_semi")
    taken = top(groups, need, [F.asc(batch), F.asc(group)])
    if taken.count() < need:
        raise ValueError(f"fewer than {need} groups with different rewards")
    return varied.join(taken, [batch, group], "left_semi")


def same_ids(a: DataFrame, b: DataFrame, id: str = "group_id") -> DataFrame:
    """The rows of ``a`` as they are; ids that only one side has are an error."""
    off = a.select(id).distinct().withColumn("__a", F.lit(True)).join(b.select(id).distinct().withColumn("__b", F.lit(True)), id, "full_outer").where("__a is null or __b is null")
    some = [r[id] for r in off.orderBy(id).limit(10).collect()]
    if some:
        raise ValueError(f"ids of {id} differ: {some}")
    return a
