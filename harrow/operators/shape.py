"""Shaping prompts, chats and batches: templates, expansion, repetition, padding, chunking, sequence assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from harrow.operators.select import ranked


def prompt(problem: Column, instruction: str, true_false: Column | None = None) -> Column:
    text = F.concat(F.lit(instruction + " "), problem)
    return text if true_false is None else F.when(true_false, F.concat(text, F.lit(" Answer True or False."))).otherwise(text)


def choices(options: Column) -> Column:
    """Options as lines "A. text"."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.chr(i + 65), F.lit(". "), F.trim(x))), "\n")


def answer_letter(answer: Column, index: Column) -> Column:
    """The answer's letter, else that of its index."""
    return F.coalesce(F.nullif(F.upper(F.trim(answer)), F.lit("")), F.chr(index + 65))


def after_last(text: Column, marker: str) -> Column:
    return F.trim(F.substring_index(text, marker, -1))


def between(text: Column, left: str, right: str) -> Column:
    return F.trim(F.substring_index(F.substring_index(text, left, -1), right, 1))


def integer_text(x: Column) -> Column:
    """A whole number without decimals; other numbers as they are."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def prompt_records(df: DataFrame, source: str, order: str, problem: str, answer: str, split: str) -> DataFrame:
    """The nested record: messages, reward spec and extra info with a dense index."""
    rows = ranked(df, [order], "index").withColumn("index", F.col("index") - 1)
    return rows.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.col(problem).alias("content"))).alias("prompt"),
        F.struct(F.col(answer).cast("string").alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), "index", F.col("index").alias("original_index")).alias("extra_info"),
    )


def combined_input(parts: list[tuple[str, DataFrame]], order: str) -> DataFrame:
    """All parts in the given order with a running group_id from 0."""
    rows = None
    for i, (name, part) in enumerate(parts):
        own = part.withColumns({"benchmark": F.lit(name), "__part": F.lit(i)})
        rows = own if rows is None else rows.unionByName(own)
    return ranked(rows, ["__part", order], "group_id").withColumn("group_id", F.col("group_id") - 1).drop("__part")


def matching(df: DataFrame, equal: dict[str, str] | None = None, holds: dict[str, str] | None = None) -> DataFrame:
    """Rows whose columns equal the given values and hold the given strings."""
    for name, value in (equal or {}).items():
        df = df.where(F.col(name) == value)
    for name, value in (holds or {}).items():
        df = df.where(F.contains(F.col(name), F.lit(value)))
    return df


def dated(df: DataFrame, column: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """Rows of ISO dates from ``since`` on and before ``before``."""
    if since is not None:
        df = df.where(F.col(column) >= since)
    return df if before is None else df.where(F.col(column) < before)


def labelled(df: DataFrame, column: str) -> DataFrame:
    """Rows with a label that isn't empty."""
    return df.where(F.length(column) > 0)


def with_fields(struct: Column, **fields: Column) -> Column:
    """The struct with fields set, those that it has already and new ones; names with a dot go into inner structs."""
    for name, value in fields.items():
        struct = struct.withField(name.replace("__", "."), value)
    return struct


def sampled_rows(df: DataFrame, row: str, sample: str, value: str) -> DataFrame:
    """(row, responses): a list per row of what n sampling passes gave, in their order."""
    return df.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(sample, value))), lambda x: x[value]).alias("responses"))


def split_or_whole(df: DataFrame, split: Column, name: str) -> DataFrame:
    """Rows of a split; all rows where it has none."""
    part = df.where(split == name)
    return df if part.isEmpty() else part


def expand(df: DataFrame, n: int, name: str = "sample_id") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def repeat(df: DataFrame, n: int | Column, index: str, size: int | None = None, interleave: bool = True, name: str = "at") -> DataFrame:
    """Rows repeated n times, each after itself, or the whole batch (of ``size`` rows) after itself."""
    times = F.lit(n) if isinstance(n, int) else n
    rows = df.withColumn("__k", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times.cast("long") - 1))))
    return rows.withColumn(name, F.col(index) * n + F.col("__k") if interleave else F.col("__k") * size + F.col(index)).drop("__k")


def pad_to(df: DataFrame, divisor: int, index: str) -> DataFrame:
    """Rows from the start again, until the size divides; adds at (the place) and pad."""
    n = df.count()
    size = -(-n // divisor) * divisor
    if not n:
        return df.withColumns({"at": F.col(index), "pad": F.lit(False)})
    times = F.floor((F.lit(size) - 1 - F.col(index)) / n)
    rows = df.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), times)))
    return rows.withColumns({"at": F.col("__k") * n + F.col(index), "pad": F.col("__k") > 0}).drop("__k")


def unpad(df: DataFrame) -> DataFrame:
    return df.where("not pad").drop("at", "pad")


def fold(df: DataFrame, size: int, index: str, columns: list[str]) -> DataFrame:
    """(fold, a list per column) of each ``size`` consecutive rows."""
    rows = df.groupBy(F.floor(F.col(index) / size).alias("fold")).agg(F.array_sort(F.collect_list(F.struct(index, *columns))).alias("r"))
    return rows.select("fold", *(F.col(f"r.{c}").alias(c) for c in columns))


def unfold(df: DataFrame, columns: list[str], by: str = "fold") -> DataFrame:
    rows = df.select(by, F.posexplode(F.arrays_zip(*columns)).alias("pos", "r"))
    return rows.select(by, F.col("pos").cast("long").alias("pos"), *(F.col(f"r.{c}").alias(c) for c in columns))


def chunk_of(index: str, k: int, n: int, padded: bool = False) -> Column:
    """The chunk of k equal ones; sizes must divide unless the batch may be padded."""
    if n % k and not padded:
        raise ValueError(f"{n} rows don't divide into {k} chunks")
    return F.floor(F.col(index) / -(-n // k))


def select_rows(df: DataFrame, index: str, start: int, stop: int, step: int = 1) -> DataFrame:
    return df.where((F.col(index) >= start) & (F.col(index) < stop) & ((F.col(index) - start) % step == 0))


def fold_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages) in the order of turns."""
    got = df.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    return got.select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def flatten_chat(messages: Column) -> Column:
    """Lines "**Role**: text" without system messages."""
    shown = F.filter(messages, lambda m: m["role"] != "system")
    return F.array_join(F.transform(shown, lambda m: F.concat(F.lit("**"), F.initcap(m["role"]), F.lit("**: "), m["content"])), "\n")


def unpivot_preferences(df: DataFrame, keep: list[str], chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    both = F.array(F.struct(F.col(chosen).alias("response"), F.lit(1).alias("label")), F.struct(F.col(rejected).alias("response"), F.lit(0).alias("label")))
    return df.select(*keep, F.explode(both).alias("r")).select(*keep, "r.*")


def segments(text: Column) -> Column:
    """Text cut at <image> and <video>, empty pieces dropped; each with its type."""
    parts = F.filter(F.split(text, "(?=<image>|<video>)|(?<=<image>|<video>)"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.when(x == "<image>", "image").when(x == "<video>", "video").otherwise("text").alias("type"), x.alias("text")))


def clean_choice(text: Column) -> Column:
    """Stripped, "[title]" as a full stop, other brackets gone, double spaces single."""
    t = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def shuffled_options(options: Column, key: Column, seed: int) -> Column:
    """(options, letter): options in a hashed order of the row, and the letter where the first one went."""
    marked = F.transform(options, lambda x, i: F.struct(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"), F.lit("-"), i.cast("string"))).alias("h"), i.alias("i"), x.alias("x")))
    order = F.array_sort(marked)
    return F.struct(F.transform(order, lambda o: o["x"]).alias("options"), F.chr(F.array_position(F.transform(order, lambda o: o["i"]), 0).cast("int") + 64).alias("letter"))


# ---- token sequences ---------------------------------------------------------------------------


def fit_length(tokens: Column, most: int, side: str = "right") -> Column:
    """Cut to ``most``: "right" cuts the end, "left" the start, "middle" the middle; "error" raises."""
    n, half = F.size(tokens), most // 2
    cut = {
        "right": F.slice(tokens, 1, most),
        "left": F.slice(tokens, F.greatest(n - most + 1, F.lit(1)), F.lit(most)),
        "middle": F.concat(F.slice(tokens, 1, half), F.slice(tokens, F.greatest(n - (most - half) + 1, F.lit(1)), F.lit(most - half))),
        "error": F.raise_error(F.lit("a sequence is too long")).cast("array<int>"),
    }[side]
    return F.when(n > most, cut).otherwise(tokens)


def pad(tokens: Column, length: int, fill: Column, left: bool = False) -> Column:
    more = F.array_repeat(fill, F.greatest(F.lit(length) - F.size(tokens), F.lit(0)))
    return F.concat(more, tokens) if left else F.concat(tokens, more)


@F.pandas_udf(ArrayType(LongType()))
def _running(masks: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else np.cumsum(np.asarray(m, np.int64)) for m in masks])


def position_ids(mask: Column) -> Column:
    """(running count - 1) where the mask is 1, else 0."""
    on = F.transform(mask, lambda m: m.cast("int"))
    return F.zip_with(_running(on), on, lambda r, m: (r - 1) * m)


def assemble(prompt: Column, response: Column, most: int) -> dict[str, Column]:
    """Input ids cut to ``most`` and a response mask that is shifted by one, as targets are."""
    ids = F.slice(F.concat(prompt, response), 1, most)
    mask = F.transform(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), lambda _, i: F.when(i + 1 >= F.size(prompt), 1).otherwise(0))
    return {"input_ids": ids, "response_mask": mask, "was_truncated": F.size(prompt) + F.size(response) > most}


def sft_mask(prompt_length: Column, length: Column) -> Column:
    """1 from the last prompt token on, the last token out: those whose next token is a response's."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when((i >= prompt_length - 1) & (i < length - 1), 1).otherwise(0))


def response_mask(attention: Column, length: int | Column) -> Column:
    """The attention mask of the last ``length`` positions, all of them if there are fewer."""
    n = F.least(F.size(attention), F.lit(length) if isinstance(length, int) else length)
    return F.slice(attention, F.greatest(F.size(attention) - n, F.lit(0)) + 1, n)


def chat_mask(messages: Column) -> Column:
    """Per word of a chat: 1 in assistant messages."""
    return F.flatten(F.transform(messages, lambda m: F.transform(F.filter(F.split(m["content"], r"\s+"), lambda w: w != ""), lambda w: F.when(m["role"] == "assistant", 1).otherwise(0))))


def unpadded(tokens: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])


def place(values: Column, valid: Column, length: int) -> Column:
    """The first min(len, valid) values, then -1."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when((i <= valid) & (i <= F.size(values)), F.try_element_at(values, i)).otherwise(-1.0))


# ---- batches and records --------------------------------------------------------------------------


def comma_answers(values: Column) -> Column:
    """Several numeric answers as one text, whole ones without decimals."""
    return F.array_join(F.transform(values, integer_text), ",")


def rows_at(df: DataFrame, index: str, places: list[int]) -> DataFrame:
    """The rows at given places, in that order and as often as they are named; adds at. Places from the end are negative."""
    n = df.count() if any(p < 0 for p in places) else 0
    wanted = df.sparkSession.createDataFrame([(i, p + n if p < 0 else p) for i, p in enumerate(places)], f"at long, {index} long")
    return df.join(F.broadcast(wanted), index)


def rows_where(df: DataFrame, mask: DataFrame, index: str, flag: str) -> DataFrame:
    """The rows whose flag in a table of (index, flag) is true."""
    return df.join(mask.where(F.col(flag)).select(index), index, "left_semi")


def pad_with_end(df: DataFrame, divisor: int, index: str, last: bool = True) -> DataFrame:
    """The last (or first) row again until the size divides; adds at (the place) and pad."""
    n = df.count()
    more = -n % divisor
    rows = df.withColumns({"at": F.col(index), "pad": F.lit(False)})
    if not n or not more:
        return rows
    end = df.where(F.col(index) == (n - 1 if last else 0)).withColumn("at", F.explode(F.sequence(F.lit(n).cast("long"), F.lit(n + more - 1).cast("long"))))
    return rows.unionByName(end.withColumn("pad", F.lit(True)))


def agreed(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One value per column and group of parts; parts that differ are an error, nulls count as a value."""
    one = lambda c: F.when(F.size(F.collect_set(F.struct(c))) > 1, F.raise_error(F.lit(f"parts differ in {c}"))).otherwise(F.any_value(c)).alias(c)
    return df.groupBy(*by).agg(*(one(c) for c in columns))


def append_kept(rows: DataFrame, more: DataFrame, keep: Column) -> DataFrame:
    """The rows and those of a generated batch that pass."""
    return rows.unionByName(more.where(keep).select(*rows.columns))


def flat(df: DataFrame, sep: str = "/") -> DataFrame:
    """Fields of nested structs as columns named by their path."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        return [p for f in schema.fields for p in (leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)])]

    return df.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)) for p in leaves(df.schema, ())))


def preference_input(prompt: Column, chosen: Column, rejected: Column, eos: int, length: int) -> Column:
    """(input_ids, attention_mask) of both responses after the prompt, chosen first: an end token each, zeros up
    to ``length``, cut there."""
    ids = [F.slice(F.concat(prompt, r, F.array(F.lit(eos))), 1, length) for r in (chosen, rejected)]
    return F.struct(F.array(*(pad(i, length, F.lit(0)) for i in ids)).alias("input_ids"), F.array(*(pad(F.transform(i, lambda _: F.lit(1)), length, F.lit(0)) for i in ids)).alias("attention_mask"))


def counting_task(id: Column, seed: int, least: int = 3, most: int = 10, alphabet: str = "abcdefghijklmnopqrstuvwxyz", train: float = 0.9) -> Column:
    """(word, letter, problem, reasoning, answer, split) of a counting task made from an id: hashed letters, and a letter to count."""
    h = lambda part, n: (F.conv(F.left(F.md5(F.concat_ws("-", F.lit(str(seed)), id.cast("string"), part)), F.lit(7)), 16, 10).cast("long") % n).cast("int")
    letter_at = lambda i: F.substr(F.lit(alphabet), h(F.concat(F.lit("c"), i.cast("string")), len(alphabet)) + 1, F.lit(1))
    part = F.when(h(F.lit("s"), 1000) < int(train * 1000), "train").otherwise("test")

    def task(letters: Column, letter: Column) -> Column:
        upto = lambda i: F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y == letter)).cast("string")
        lines = F.transform(letters, lambda x, i: F.concat(x, F.when(x == letter, F.lit(" = ")).otherwise(F.lit(" != ")), letter, F.lit(": "), upto(i)))
        count = F.size(F.filter(letters, lambda y: y == letter))
        ask = F.concat(F.lit("How often does "), letter, F.lit(" occur in "), F.array_join(letters, ""), F.lit("?"))
        return F.struct(F.array_join(letters, "").alias("word"), letter.alias("letter"), ask.alias("problem"), F.concat(F.array_join(lines, "\n"), F.lit("\n\\boxed{"), count.cast("string"), F.lit("}")).alias("reasoning"), count.alias("answer"), part.alias("split"))

    # an expression in a lambda is computed for each element that it is called for; a lambda's argument is computed once
    bound = lambda x, fn: F.element_at(F.transform(F.array(x), fn), 1)
    letters = F.transform(F.sequence(F.lit(1), h(F.lit("n"), most - least + 1) + least), letter_at)
    return bound(letters, lambda x: bound(F.element_at(x, h(F.lit("t"), F.size(x)) + 1), lambda y: task(x, y)))
