"""Loss masks of chats with several turns, from rows of one message each.

Consecutive tool messages are one part under one header; every other message is a part. A part's tokens are its header's,
its messages' and an end token. Only an assistant's own tokens and end count (1), not its header; a flag stored with
a part's first message replaces the whole part's mask. A null text has no tokens. Messages of equal turn are ordered by
role and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
END = "<|end|>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def header(role: Column) -> Column:
    return F.array(F.concat(F.lit("<|"), role, F.lit("|>")))


def parts(messages: DataFrame, tokens: Callable[[Column], Column] = words, head: Callable[[Column], Column] = header, override: str | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, role, messages, tokens, mask): parts are numbered from 0 in order."""
    w = W.partitionBy(conv).orderBy(turn, role, text)
    starts = F.when((F.col(role) == "tool") & (F.lag(role).over(w) == "tool"), 0).otherwise(1)
    flag = F.col(override) if override else F.lit(None).cast("int")
    own = messages.select(F.col(conv), F.col(role).alias("__role"), tokens(F.col(text)).alias("__tokens"), flag.alias("__flag"), F.row_number().over(w).alias("__at"), starts.alias("__start"))
    numbered = own.withColumn("part", F.sum("__start").over(W.partitionBy(conv).orderBy("__at")) - 1)
    message = F.struct("__at", "__tokens", "__flag", "__role")
    island = numbered.groupBy(conv, "part").agg(F.array_sort(F.collect_list(message)).alias("__m"))
    first, body = F.col("__m")[0], F.flatten(F.transform("__m", lambda m: m["__tokens"]))
    top = head(F.coalesce(first["__role"], F.lit("")))
    known = F.when(first["__role"] == "assistant", 1).otherwise(0)
    mask = F.concat(F.transform(top, lambda _: F.coalesce(first["__flag"], F.lit(0))), F.transform(F.concat(body, F.array(F.lit(END))), lambda _: F.coalesce(first["__flag"], known)))
    return island.select(conv, "part", first["__role"].alias("role"), F.size("__m").alias("messages"), F.concat(top, body, F.array(F.lit(END))).alias("tokens"), mask.alias("mask"))


def folded(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, tokens, mask) of whole chats."""
    got = parts.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("part", "tokens", "mask"))).alias("__p"))
    return got.select(conv, *(F.flatten(f"__p.{k}").alias(k) for k in ("tokens", "mask")))


def faults(messages: DataFrame, override: str | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, fault) of chats that no mask fits: the first message that is wrong in itself, else a beginning other than
    [system,] user, assistant."""
    w = W.partitionBy(conv).orderBy(turn, role, text)
    r, at = F.col("__role"), F.col("__at")
    flag = F.col(override) if override else F.lit(None).cast("int")
    own = messages.select(F.col(conv), F.col(role).alias("__role"), flag.alias("__flag"), F.row_number().over(w).alias("__at"), F.lag(role).over(w).alias("__before"))
    leads = ~((r == "tool") & F.coalesce(F.col("__before") == "tool", F.lit(False)))
    wrong = (
        F.when((r == "system") & (at > 1), "a system message after the first")
        .when(~F.coalesce(r.isin(*ROLES), F.lit(False)), F.concat(F.lit("unknown role "), F.coalesce(r, F.lit("null"))))
        .when(leads & ~F.col("__flag").isin(0, 1), "a mask other than 0 or 1")
    )
    first = lambda k: F.max(F.when(at == k, r))
    seen = own.withColumn("__wrong", wrong).groupBy(conv).agg(F.min_by("__wrong", F.when(F.col("__wrong").isNotNull(), at)).alias("__wrong"), *(first(k).alias(f"__{k}") for k in (1, 2, 3)))
    opens = lambda a, b: F.coalesce((F.col(a) == "user") & (F.col(b) == "assistant"), F.lit(False))
    begins = F.when(F.col("__1") == "system", opens("__2", "__3")).otherwise(opens("__1", "__2"))
    return seen.select(conv, F.coalesce("__wrong", F.when(~F.coalesce(begins, F.lit(False)), "the beginning is not user, assistant")).alias("fault")).where("fault is not null")
