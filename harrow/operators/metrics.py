"""Accuracy, votes, validation and training metrics over response rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.operators.select import ranked
from harrow.operators.votes import majority as majority_law


def accuracy_by_group(df: DataFrame, group: str = "group_id", passed: str = "passed") -> DataFrame:
    """(group, total, correct, accuracy) over rows with a group and a boolean."""
    rows = df.where(F.col(group).isNotNull() & F.col(passed).isNotNull())
    out = rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(passed).alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))


def overall(df: DataFrame, group: str = "group_id", passed: str = "passed") -> DataFrame:
    """Accuracy of samples, share of groups with a pass, and the number of both."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(passed), F.lit(False))).alias("k"))
    return g.agg(F.sum("n").alias("samples"), F.count("*").alias("groups"), (F.sum("k") / F.sum("n")).alias("accuracy"), F.avg((F.col("k") > 0).cast("double")).alias("best_of_n"))


def majority(df: DataFrame, value: str = "passed", vote: str = "pred", group: str = "group_id", sample: str = "sample_id") -> DataFrame:
    """(group, pred, value): the most frequent prediction, first seen on a tie, and its first row's value."""
    votes = df.groupBy(group, vote).agg(F.count("*").alias("n"), F.min(sample).alias("first"), F.min_by(value, sample).alias(value))
    best = F.max_by(F.struct(vote, value), F.struct("n", -F.col("first"))).alias("b")
    return votes.groupBy(group).agg(best).select(group, f"b.{vote}", f"b.{value}")


def uneven_groups(df: DataFrame, group: str = "group_id") -> DataFrame:
    """The sizes of groups, if they have more than one."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))
    return sizes.withColumn("__k", F.count("*").over(W.partitionBy())).where("__k > 1").drop("__k")


def evaluation(df: DataFrame, by: list[str], group: str = "group_id") -> DataFrame:
    """avg@n, pass@n, maj@n and counts for each value of ``by``; one shuffle by group, a small one after."""
    vote = df.groupBy(*by, group, "pred").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"), F.min_by("passed", "sample_id").alias("v"), F.count_if("passed").alias("k"), F.sum("length").alias("len"))
    g = vote.groupBy(*by, group).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("len").alias("len"), F.max_by("v", F.struct("n", -F.col("first"))).alias("maj"))
    return g.groupBy(*by).agg(
        F.count("*").alias("problems"), F.sum("n").alias("samples"), F.sum("k").alias("correct"), (F.sum("k") / F.sum("n")).alias("avg_at_n"),
        F.avg((F.col("k") > 0).cast("double")).alias("p_at_n"), F.avg(F.col("maj").cast("double")).alias("maj_at_n"), (F.sum("len") / F.sum("n")).alias("mean_tokens"),
    )


def macro(df: DataFrame, benchmark: str, category: str, passed: str = "passed") -> DataFrame:
    """Accuracy per benchmark, per category of one, overall (GROUPING SETS), and the mean over benchmarks."""
    sets = df.groupingSets([[F.col(benchmark)], [F.col(benchmark), F.col(category)], []], benchmark, category)
    got = sets.agg(F.grouping_id().alias("g"), F.avg(F.col(passed).cast("double")).alias("accuracy"), F.count("*").alias("samples"))
    level = F.when(F.col("g") == 0, "category").when(F.col("g") == 1, "benchmark").otherwise("overall")
    got = got.select(level.alias("level"), benchmark, category, "accuracy", "samples")
    per = df.groupBy(benchmark).agg(F.avg(F.col(passed).cast("double")).alias("a"), F.count("*").alias("n"))
    mean = per.agg(F.lit("macro").alias("level"), F.lit(None).cast("string").alias(benchmark), F.lit(None).cast("string").alias(category), F.avg("a").alias("accuracy"), F.sum("n").alias("samples"))
    return got.unionByName(mean)


def subset_sizes(n: Column) -> Column:
    """2, 4, 8, ... under n, and n, for n over 1."""
    # the binary digits of n - 1 less one are the powers under n, of which 30 count
    n = n.cast("long")
    powers = F.transform(F.sequence(F.lit(1), F.least(F.length(F.bin(n - 1)) - 1, F.lit(30))), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    return F.when(n > 2, F.array_append(powers, n)).when(n == 2, F.array(n)).otherwise(F.array().cast("array<bigint>"))


def validation(df: DataFrame, source: str = "benchmark", prompt: str = "group_id", value: str = "reward") -> DataFrame:
    """(source, metric, value): mean@n and std@n (population) of each prompt, averaged over prompts of n samples."""
    g = df.groupBy(source, prompt).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    long = g.select(source, F.explode(F.array(F.struct(F.concat(F.lit("mean@"), "n").alias("metric"), F.col("mean").alias("v")), F.struct(F.concat(F.lit("std@"), "n").alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("v")))).alias("m"))
    return long.where("m.v is not null").groupBy(source, F.col("m.metric").alias("metric")).agg(F.avg("m.v").alias("value"))


def expected_extremes(df: DataFrame, group: str = "group_id", value: str = "reward") -> DataFrame:
    """(group, k, best, worst, best_std, worst_std): what resampling k values with replacement has as mean and deviation of
    the largest and the least, exactly: the largest is at most x with probability F(x)^k. k runs over 2, 4, 8, ..., n."""
    counts = df.groupBy(group, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("c"))
    up, whole = W.partitionBy(group).orderBy(value), W.partitionBy(group)
    share = counts.withColumns({"n": F.sum("c").over(whole), "upto": F.sum("c").over(up)}).where("n > 1").withColumn("k", F.explode(subset_sizes(F.col("n"))))
    power = lambda c: F.pow(c / F.col("n"), F.col("k").cast("double"))
    is_best = power(F.col("upto")) - power(F.col("upto") - F.col("c"))
    is_worst = power(F.col("n") - F.col("upto") + F.col("c")) - power(F.col("n") - F.col("upto"))
    x = F.col(value)
    mean = {"best": F.sum(x * is_best), "worst": F.sum(x * is_worst)}
    square = {"best": F.sum(x * x * is_best), "worst": F.sum(x * x * is_worst)}
    std = [F.sqrt(F.greatest(square[c] - mean[c] * mean[c], F.lit(0.0))).alias(f"{c}_std") for c in mean]
    return share.groupBy(group, "k").agg(*(m.alias(c) for c, m in mean.items()), *std)


def validation_table(df: DataFrame, source: str = "benchmark", prompt: str = "group_id", values: tuple[str, ...] = ("reward",), vote: str | None = None) -> DataFrame:
    """(source, variable, metric, value): mean@n and std@n of each prompt's n values, and for k = 2, 4, 8, ..., n best@k, worst@k
    and, where there are votes, maj@k, each with /mean and /std, averaged over the prompts that have the metric. The three are the
    exact laws of resampling, not drawn. Variables that are strings are passed over; a prompt of one value has its mean alone."""
    kinds, key = dict(df.dtypes), "__prompt"
    rows = df.withColumn(key, F.struct(source, prompt))
    out = None
    for c in values:
        if kinds[c] == "string":
            continue
        own = rows.where(F.col(c).isNotNull()).withColumn("__v", F.col(c).cast("double"))
        named = lambda name, k, of: F.concat(F.lit(name), F.col(k).cast("string"), F.lit(of))
        flat = own.groupBy(key).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"))
        # all metrics of a row at once: a branch for each would compute the row anew
        several = lambda rows, *of: rows.select(key, F.explode(F.array(*(F.struct(m.alias("metric"), x.alias("x")) for m, x in of))).alias("m")).select(key, "m.*")
        flat = several(flat, (named("mean@", "n", ""), F.col("mean")), (F.when(F.col("n") > 1, named("std@", "n", "")), F.col("std"))).where("metric is not null")
        laws = several(expected_extremes(own, key, "__v"), *((named(f"{m}@", "k", f"/{of}"), F.col(col)) for m in ("best", "worst") for of, col in (("mean", m), ("std", f"{m}_std"))))
        parts = [flat, laws]
        if vote is not None:
            won = majority_law(own, None, key, vote, "__v")
            parts.append(several(won, *((named("maj@", "k", f"/{of}"), F.col(col)) for of, col in (("mean", "majority"), ("std", "majority_std")))))
        long = functools.reduce(DataFrame.unionByName, parts).groupBy(F.col(f"{key}.{source}").alias("source"), "metric").agg(F.avg("x").alias("value"))
        long = long.select("source", F.lit(c).alias("variable"), "metric", "value")
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise ValueError("no variable is a number")
    return out


def bootstrap(df: DataFrame, k: int, draws: int = 1000, seed: int = 42, group: str = "group_id", sample: str = "sample_id", value: str = "reward") -> DataFrame:
    """(group, best, best_std, worst, worst_std) over ``draws`` hashed resamples of ``k`` values. A resample
    index is a function of seed, draw and position, the same in every group of one size."""
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(sample, value))).alias("v")).select(group, F.col(f"v.{value}").alias("v"))
    pick = lambda d, j: F.element_at("v", (F.pmod(F.xxhash64(F.lit(seed), d, j), F.size("v")) + 1).cast("int"))
    sets = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: pick(d, j)))
    long = rows.select(group, F.transform(sets, lambda s: F.struct(F.array_max(s).alias("hi"), F.array_min(s).alias("lo"))).alias("s")).select(group, F.explode("s").alias("s"))
    return long.groupBy(group).agg(F.avg("s.hi").alias("best"), F.stddev_pop("s.hi").alias("best_std"), F.avg("s.lo").alias("worst"), F.stddev_pop("s.lo").alias("worst_std"))


def name_validation(df: DataFrame, core: str = "acc", metric: str = "metric") -> DataFrame:
    """Adds name: val-core for mean, maj and best of the core variable at the largest n, else val-aux."""
    n = F.try_element_at(F.split(metric, "@"), F.lit(-1)).try_cast("int")
    most = F.max(n).over(W.partitionBy("source", "variable"))
    main = (F.col("variable") == core) & (n == most) & F.col(metric).rlike("^(mean|maj|best)")
    return df.withColumn("name", F.concat_ws("/", F.when(main, "val-core").otherwise("val-aux"), "source", "variable", metric))


def summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, count) of equal bins from the least to the largest value, which the last one holds."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = df.crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("count"))
    all_bins = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return all_bins.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def data_metrics(df: DataFrame, most_length: int) -> DataFrame:
    """Mean, max and min of score, advantage, value and length, the shares at the length limit and without a
    response, and the explained variance of returns (reward) by values."""
    out = []
    for c in ("reward", "advantage", "value", "length"):
        out += [F.avg(c).alias(f"{c}_mean"), F.max(c).cast("double").alias(f"{c}_max"), F.min(c).cast("double").alias(f"{c}_min")]
    out += [F.avg((F.col("length") >= most_length).cast("double")).alias("clip_ratio"), F.avg((F.col("length") == 0).cast("double")).alias("aborted_ratio")]
    out.append((1 - F.var_samp(F.col("reward") - F.col("value")) / (F.var_samp("reward") + 1e-5)).alias("explained_variance"))
    return df.agg(*out)


def reduce_by_name(df: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """One value per name: the largest where the name holds "max", the least for "min", else the mean."""
    pick = F.when(F.contains(F.col(name), F.lit("max")), F.max(value)).when(F.contains(F.col(name), F.lit("min")), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(name).agg(pick.alias(value))


def roll_up(df: DataFrame, window: str, step: str = "step", name: str = "metric", value: str = "value") -> DataFrame:
    """(window, metric, value) by a rule that the name tells: last, then sums of times, means, extremes, sums."""
    n = F.col(name)
    has = lambda s: F.contains(n, F.lit(s))
    rule = F.when(has("version"), F.max_by(value, step)).when(has("timing_s"), F.sum(value)).when(has("avg") | has("mean"), F.avg(value)).when(has("max"), F.max(value)).when(has("min"), F.min(value)).when(has("sum") | has("total"), F.sum(value)).otherwise(F.avg(value))
    return df.groupBy(window, name).agg(rule.alias(value))


def batch_statistics(df: DataFrame, time: str, version: str, by: list[str]) -> DataFrame:
    p = lambda q: F.percentile(time, q)
    return df.groupBy(*by).agg(F.avg(time).alias("avg"), F.max(time).alias("max"), F.min(time).alias("min"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.countDistinct(version).alias("versions"))


def group_mean_std(df: DataFrame, group: str, value: str, floor: float = 1e-6) -> DataFrame:
    """(group, count, mean, std): the variance at least ``floor``; a singleton has 0 and 1."""
    n = F.count("*")
    return df.groupBy(group).agg(n.alias("count"), F.when(n > 1, F.avg(value)).otherwise(0.0).alias("mean"), F.when(n > 1, F.sqrt(F.greatest(F.var_samp(value), F.lit(floor)))).otherwise(1.0).alias("std"))


def factorize(df: DataFrame, label: str, name: str = "code") -> DataFrame:
    """Adds the place of each label among the distinct ones, from 0; whole numbers that are already labels stay
    apart from equal strings by their type. The distinct labels are numbered, not the rows."""
    codes = ranked(df.select(label).distinct(), [label], name).withColumn(name, F.col(name) - 1)
    return df.join(codes, df[label].eqNullSafe(codes[label]), "left").drop(codes[label])


def masked_stats(df: DataFrame, value: str, mask: Column) -> DataFrame:
    """Sum, mean (1e-8 in the divisor) and Bessel variance of ``value`` where the mask is 1."""
    x, m = F.when(mask == 1, F.col(value)).otherwise(0.0), F.sum(mask)
    mean, on = F.sum(x) / (m + 1e-8), F.when(mask == 1, F.col(value))
    # around the true mean, which loses no digits, and from there to the one with 1e-8 in its divisor
    off = F.avg(on) - mean
    variance = F.coalesce(F.var_pop(on) + off * off, F.lit(0.0)) * m / (m + 1e-8)
    return df.agg(F.sum(x).alias("sum"), mean.alias("mean"), F.when(m > 1, variance * m / (m - 1)).otherwise(variance).alias("var"))


def logprob_differences(df: DataFrame, a: str, b: str, mask: Column) -> DataFrame:
    """Pearson correlation, and largest, mean and deviation of the difference, of probabilities under the mask."""
    on, d = df.where(mask == 1), F.abs(F.exp(a) - F.exp(b))
    return on.agg(F.corr(F.exp(a), F.exp(b)).alias("correlation"), F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"))


def incomplete_groups(df: DataFrame, n: int, group: str = "group_id") -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") != n)


def flops(df: DataFrame, hidden: int, layers: int, params: int, length: str = "length") -> DataFrame:
    """Training FLOPs of a dense decoder: 6 per parameter and token, 12 per squared length, layer and width."""
    tokens, squares = F.sum(length).cast("double"), F.sum((F.col(length) * F.col(length)).cast("double"))
    return df.agg((6.0 * params * tokens + 12.0 * hidden * layers * squares).alias("flops"), tokens.alias("tokens"))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def distinct_first(df: DataFrame, value: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each distinct value."""
    return df.groupBy(*value).agg(F.min(order).alias(order))


def group_tokens(df: DataFrame, shard: str, group: str = "group_id", length: str = "length") -> DataFrame:
    """Groups, rows, tokens and longest row of each shard."""
    return df.groupBy(shard).agg(F.countDistinct(group).alias("groups"), F.count("*").alias("rows"), F.sum(length).alias("tokens"), F.max(length).alias("longest"))


def slowest(df: DataFrame, time: Column, keep: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(time).alias("least"), F.max(time).alias("most"), F.avg(time).alias("mean"), F.max_by(F.struct(*keep), F.struct(time, *keep)).alias("row")).select(*by, "least", "most", "mean", "row.*")


def throughput(df: DataFrame, tokens: str, seconds: str, devices: int, by: list[str]) -> DataFrame:
    """Tokens, seconds, tokens per second and device, and milliseconds per token."""
    t, s = F.sum(tokens), F.sum(seconds)
    return df.groupBy(*by).agg(t.alias("tokens"), s.alias("seconds"), F.try_divide(t, s * devices).alias("throughput"), F.try_divide(s * 1000, t).alias("ms_per_token"))


def mismatches(a: Column, b: Column, mask: Column) -> Column:
    """In how many unmasked places two arrays differ."""
    differ = F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("long"))
    return F.aggregate(F.zip_with(differ, mask, lambda d, m: d * m.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def masked_kl(df: DataFrame, mask: Column) -> DataFrame:
    """Mean of old less new log-probabilities over unmasked tokens."""
    return df.agg((F.sum((F.col("old_logp") - F.col("logp")) * mask) / F.sum(mask)).alias("kl"))


def batch_norm(df: DataFrame, value: str, group: str = "group_id", order: str = "sample_id") -> DataFrame:
    """``value`` over the batch's largest absolute sum from a token on, + 1e-6."""
    run = F.sum(value).over(W.partitionBy(group).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = df.withColumn("__run", run)
    top = rows.agg((F.max(F.abs("__run")) + 1e-6).alias("__top"))
    return rows.crossJoin(F.broadcast(top)).withColumn(value, F.col(value) / F.col("__top")).drop("__run", "__top")


def step_reward(df: DataFrame, score: str, group: str, order: str, penalty: float = -0.05) -> DataFrame:
    """Adds reward: 0 where the score is over the one before, else the penalty; the first against 0."""
    before = F.lag(score, 1, 0.0).over(W.partitionBy(group).orderBy(order))
    return df.withColumn("reward", F.when(F.col(score) > before, 0.0).otherwise(penalty))


def merge_workers(parts: list[DataFrame], assigned: DataFrame, id: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """All workers' rows, and what is wrong with them: (id, error) of ids that are missing, twice or of nobody."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    n = rows.groupBy(id).agg(F.count("*").alias("n"))
    both = assigned.select(id, F.lit(True).alias("wanted")).join(n, id, "full_outer")
    error = F.when(F.col("wanted").isNull(), "not assigned").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return rows, both.withColumn("error", error).where("error is not null").select(id, "error")


def response_counts(df: DataFrame, by: list[str], invalid: Column, failed: Column, most_length: int, length: str = "length") -> DataFrame:
    """Responses, invalid ones, errors, those at the token limit and mean tokens for each value of ``by``; null is no."""
    on = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return df.groupBy(*by).agg(F.count("*").alias("samples"), on(invalid).alias("invalid"), on(failed).alias("errors"), on(F.col(length) >= most_length).alias("at_limit"), F.avg(length).alias("mean_tokens"))


def require_even(df: DataFrame, group: str = "group_id") -> DataFrame:
    """The rows as they are; groups of more than one size are an error."""
    sizes = [r["n"] for r in uneven_groups(df, group).orderBy("n").limit(10).collect()]
    if sizes:
        raise ValueError(f"groups of {group} differ in size: {sizes}")
    return df


def bootstrap_votes(df: DataFrame, k: int, draws: int = 1000, seed: int = 42, group: str = "group_id", sample: str = "sample_id", vote: str = "pred", value: str = "passed") -> DataFrame:
    """(group, majority, majority_std): mean and deviation of the majority's value over ``draws`` resamples of k
    rows with replacement. Within a resample the first vote drawn wins a tie and gives the value. An index is
    the head of an MD5 of seed, draw and position, the same in every group of one size."""
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(vote).alias("vote"), F.col(value).cast("double").alias("value")))).alias("v"))
    head = lambda d, j: F.conv(F.left(F.md5(F.concat_ws("-", F.lit(str(seed)), d.cast("string"), j.cast("string"))), F.lit(7)), 16, 10).cast("long")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.element_at("v", (head(F.col("draw"), j) % F.size("v") + 1).cast("int")))
    counted = F.transform("drawn", lambda x, i: F.struct(F.size(F.filter("drawn", lambda y: y["vote"].eqNullSafe(x["vote"]))).alias("n"), (-i).alias("at"), x["value"].alias("value")))
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("drawn", drawn).withColumn("won", F.array_max(counted)["value"])
    return each.groupBy(group).agg(F.avg("won").alias("majority"), F.stddev_pop("won").alias("majority_std"))


def source_means(df: DataFrame, source: str, prompt: str, score: str) -> DataFrame:
    """(source, prompts, score): the mean over a prompt's responses, then over a source's prompts."""
    each = df.groupBy(source, prompt).agg(F.avg(score).alias("score"))
    return each.groupBy(source).agg(F.count("*").alias("prompts"), F.avg("score").alias("score"))


def flagged_histogram(df: DataFrame, value: str, chosen: Column, bins: int = 20) -> DataFrame:
    """The histogram, and whether a bin holds rows that are ``chosen``."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    held = df.where(chosen).crossJoin(F.broadcast(ends)).select(at.alias("bin")).distinct().withColumn("holds_chosen", F.lit(True))
    return histogram(df, value, bins).join(F.broadcast(held), "bin", "left").withColumn("holds_chosen", F.coalesce("holds_chosen", F.lit(False)))


def stage_times(df: DataFrame, stage: str, seconds: str, tokens: str) -> DataFrame:
    """(metric, value): timing_s/<stage>, and timing_per_token_ms/<stage> where the stage has tokens."""
    each = df.groupBy(stage).agg(F.sum(seconds).alias("s"), F.sum(tokens).alias("t"))
    both = F.array(F.struct(F.concat(F.lit("timing_s/"), stage).alias("metric"), F.col("s").alias("value")), F.struct(F.concat(F.lit("timing_per_token_ms/"), stage).alias("metric"), F.try_divide(F.col("s") * 1000, "t").alias("value")))
    return each.select(F.explode(both).alias("m")).select("m.*").where("value is not null")


def derived_metrics(rolled: DataFrame, by: list[str], devices: int, name: str = "metric", value: str = "value") -> DataFrame:
    """Rolled-up metrics with three of them computed anew: the difference of sequence lengths, throughput and
    idle ratio. The first two replace what stands there, so they need it; the ratio is added."""
    of = lambda n: F.max(F.when(F.col(name) == n, F.col(value)))
    spread, speed, idle = "global_seqlen/minmax_diff", "perf/throughput", "trainer/idle_ratio"
    parts = rolled.groupBy(*by).agg(
        F.when(of(spread).isNotNull(), of("global_seqlen/max") - of("global_seqlen/min")).alias("a"),
        F.when(of(speed).isNotNull(), F.try_divide(of("perf/total_num_tokens"), of("perf/time_per_step") * devices)).alias("b"),
        F.try_divide(of("timing_s/gen"), of("timing_s/step")).alias("c"),
    )
    new = parts.select(*by, F.explode(F.create_map(F.lit(spread), "a", F.lit(speed), "b", F.lit(idle), "c")).alias(name, value)).where(F.col(value).isNotNull())
    return rolled.join(new.select(*by, name), [*by, name], "left_anti").select(*by, name, value).unionByName(new)


def partial_statistics(df: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    """Samples that more than one version made: their number, share and longest span."""
    span = F.abs(F.col(end) - F.col(start))
    return df.groupBy(*by).agg(F.count_if(span > 0).alias("partial"), F.avg((span > 0).cast("double")).alias("partial_ratio"), F.max(span).alias("longest_span"))


def coerced_label(label: Column, near: float = 1e-6) -> Column:
    """A label as text: numbers, and text that is one, without decimals where they are near a whole number."""
    x = label.try_cast("double")
    whole = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**53) & (F.abs(x - F.round(x)) <= near)
    return F.when(whole, F.round(x).cast("long").cast("string")).otherwise(F.trim(label.cast("string")))


def decoder_flops(df: DataFrame, shape: dict[str, int], length: str = "length") -> DataFrame:
    """Training FLOPs of a decoder with grouped queries and gated layers; ``shape`` names hidden, layers, heads,
    kv_heads, head_dim, intermediate and vocabulary, and for experts also experts_per_token and routed."""
    d, head = shape["hidden"], shape["head_dim"]
    width = shape["heads"] * head
    projections = d * (2 * width + 2 * shape["kv_heads"] * head)
    layers = 3 * d * shape["intermediate"] * shape.get("experts_per_token", 1) + d * shape.get("routed", 0)
    params = shape["layers"] * (projections + layers) + 2 * shape["vocabulary"] * d
    tokens, squares = F.sum(length).cast("double"), F.sum((F.col(length) * F.col(length)).cast("double"))
    return df.agg((6.0 * params * tokens + 12.0 * width * shape["layers"] * squares).alias("flops"), tokens.alias("tokens"))


def canonical_json(*columns: str) -> Column:
    """The columns as JSON with keys in order and nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def distinct_by_json(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each canonical JSON of the columns."""
    first = df.withColumn("__j", canonical_json(*columns)).groupBy("__j").agg(F.min_by(F.struct(*df.columns), order).alias("r"))
    return first.select("r.*")


def sequence_metrics(df: DataFrame, longest_response: int, longest_prompt: int, values: bool = True) -> DataFrame:
    """(metric, value) of a batch of sequences with score, reward, advantages, returns, mask, response_length and
    prompt_length, and values for a critic. Scores and rewards are those of sequences with a response, tokens those that
    the mask keeps. Extremes and deviations of nothing are null; a batch without any response is an error."""
    kept, tokens = F.col("response_length") > 0, ["advantages", "returns", *(["values"] if values else [])]
    three = lambda name, x: [F.avg(x).alias(f"{name}/mean"), F.max(x).cast("double").alias(f"{name}/max"), F.min(x).cast("double").alias(f"{name}/min")]
    share = lambda name, hit: F.avg(hit.cast("double")).alias(name)
    long, prompt = F.col("response_length"), F.col("prompt_length")
    alive = F.when(kept, long)
    of_rows = df.agg(
        *three("critic/score", F.when(kept, F.col("score"))),
        *three("critic/rewards", F.when(kept, F.col("reward"))),
        *three("response_length", long),
        share("response_length/clip_ratio", long == longest_response),
        *three("response_length_non_aborted", alive),
        share("response_length_non_aborted/clip_ratio", alive == longest_response),
        share("response/aborted_ratio", ~kept),
        *three("prompt_length", prompt),
        share("prompt_length/clip_ratio", prompt == longest_prompt),
        F.when(F.count_if(kept) > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no sequence of the batch has a response")).cast("boolean")).alias("__alive"),
    )
    zipped = F.explode(F.arrays_zip(F.col("mask").alias("__m"), *(F.col(t).alias(t) for t in tokens)))
    t = df.select(zipped.alias("t")).where("t.__m = 1").select("t.*")
    of_tokens = t.agg(
        *(x for c in tokens for x in three(f"critic/{c}", F.col(c))),
        *([(1 - F.var_samp(F.col("returns") - F.col("values")) / (F.var_samp("returns") + 1e-5)).alias("critic/vf_explained_var")] if values else []),
    )
    one = of_rows.where("__alive").drop("__alive").crossJoin(of_tokens)  # one row each
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in one.columns))).alias("r")).select("r.*")
