"""Training sources by name: parts of named datasets as (id, problem, answer, split), and the prompts made of them.

Parts are DataFrames, as datasets are read from where the caller keeps them. Where a source takes half of a shuffled set,
the order is by a hash of a seed and the row's place. An answer that a dataset marks by "####" is what stands behind it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.answers import boxed
from harrow.operators.select import hash_order, ranked, top
from harrow.operators.shape import between, choices, integer_text
from harrow.sources.benchmarks import read as read_lines_as_variants

_ASK = "Please reason step by step, and put your final answer within \\boxed{}.\n\n"
_OPTIONS = "\nChoose the correct option by its alphabet. You answer should be \\boxed{A/B/C/...}\\n"


@dataclass(frozen=True)
class Part:
    """A part of a source: its fields, the rows it keeps, and the split they go to."""

    problem: Callable[[], Column]
    answer: Callable[[], Column]
    id: str = "id"
    keep: Callable[[], Column] | None = None
    split: str = "train"


@dataclass(frozen=True)
class Source:
    """Parts in the order in which a limit takes them; a half of them all (0 or 1), if only that is taken."""

    parts: dict[str, Part]
    aliases: tuple[str, ...] = ()
    half: int | None = None


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name).cast("string")


def _with_options() -> Column:
    """The question with its options as lines; as it is where there are none."""
    question, listed = F.trim(F.col("question")), choices(F.col("options").cast("array<string>"))
    return F.when(F.size("options") > 0, F.concat(question, F.lit("\n"), listed, F.lit(_OPTIONS))).otherwise(question)


def _letter(letter: str) -> Callable[[], Column]:
    """The stated letter, else that of the index from 0 to 25, else empty."""
    at = F.col("answer_index")
    return lambda: F.coalesce(F.nullif(F.trim(F.col(letter)), F.lit("")), F.when(at.between(0, 25), F.chr(at + 65)), F.lit(""))


def _whole() -> Column:
    """Numbers without decimals, other answers as they are."""
    number = F.col("answer").try_cast("double")
    return F.when(number == F.floor(number), integer_text(number)).otherwise(F.col("answer").cast("string"))


def _hashes() -> Column:
    return F.btrim(F.substring_index("answer", "####", -1), F.lit(" \t\n\r"))


def _dapo_problem() -> Column:
    return between(F.col("prompt")[0]["content"], "is the answer to the problem.\n\n", '\nRemember to put your answer on its own line after "Answer:".')


_AIME24, _AIME25 = Part(_col("problem"), lambda: boxed("solution")), Part(_col("problem"), _col("answer"))
_SUBJECTS = ("algebra", "counting_and_probability", "geometry", "intermediate_algebra", "number_theory", "prealgebra", "precalculus")
_MATH = Part(_col("problem"), lambda: boxed("solution"), "problem_id")
_QUIZ = Part(_with_options, lambda: _letter("answer")(), "question_id")
_THEOREM = {"test": Part(_col("Question"), _col("Answer"))}
_GPQA = {"train": Part(_with_options, lambda: _letter("answer_letter")(), "question_id")}


def _amc(year: str | None) -> dict[str, Part]:
    return {"train": Part(_col("problem"), _whole, keep=(lambda: F.contains(F.col("url"), F.lit(f"{year}_AMC"))) if year else None)}


#: Names and aliases of the sources, their parts and fields.
SOURCES: dict[str, Source] = {
    "aime24": Source({"aime24": _AIME24}, ("aime-24",)),
    "aime25": Source({"aime25": _AIME25}, ("aime-25",)),
    "aime": Source({"aime24": _AIME24, "aime25": _AIME25}, ("aime24_25", "aime-merged")),
    "math": Source(dict.fromkeys(_SUBJECTS, _MATH), ("hendrycks_math",)),
    "metamath": Source({"train": Part(_col("query"), lambda: F.substring_index("response", "The answer is: ", -1))}, ("meta-math",)),
    "strategyqa": Source({"train": Part(_col("question"), lambda: F.initcap(F.col("answer").cast("string")))}, ("strategy-qa",)),
    "webinstruct": Source({"train": Part(_col("original_question"), _col("short_answer"), "task_id")}),
    "deepscaler": Source({"train": Part(_col("problem"), _col("answer"), "task_id")}),
    "mmlupro": Source({"test": _QUIZ}, ("mmlu-pro", "mmlu_pro")),
    "mmlupro-math": Source({"test": Part(_QUIZ.problem, _QUIZ.answer, "question_id", lambda: F.col("category") == "math")}),
    "gsm8k": Source({"train": Part(_col("question"), _hashes)}, ("gsm-8k",)),
    "theoremqa": Source(_THEOREM),
    "theoremqa_train": Source(_THEOREM, half=0),
    "theoremqa_test": Source(_THEOREM, half=1),
    "supergpqa": Source(_GPQA),
    "supergpqa_train": Source(_GPQA, half=0),
    "supergpqa_test": Source(_GPQA, half=1),
    "amc": Source(_amc(None)),
    "amc22": Source(_amc("2022")),
    "amc23": Source(_amc("2023")),
    "math500": Source({"test": Part(_col("problem"), _whole)}),
    "dapo": Source({"train": Part(_dapo_problem, lambda: F.col("reward_model.ground_truth").cast("string"), "extra_info.index")}, ("dapo-math-17k",)),
}

_NAMES = {a: name for name, s in SOURCES.items() for a in (name, *s.aliases)}


def source_name(key: str) -> str:
    if key.lower() not in _NAMES:
        raise ValueError(f"unknown source {key!r}; there are {', '.join(SOURCES)}")
    return _NAMES[key.lower()]


def _present(df: DataFrame, path: str) -> bool:
    field, kind = path.split("."), df.schema
    for f in field:
        if f not in getattr(kind, "names", ()):
            return False
        kind = kind[f].dataType
    return True


def standardized(parts: dict[str, DataFrame], key: str, order: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """(id, problem, answer, split, part, at) of a source: its parts' rows in the order of the parts and, in each, of the column
    ``order``; ``most`` takes the first ones. The id is empty where a part has none. A part that isn't given is an error."""
    source, rows = SOURCES[source_name(key)], None
    if missing := [p for p in source.parts if p not in parts]:
        raise ValueError(f"{key}: the parts {missing} are not given")
    for i, (name, part) in enumerate(source.parts.items()):
        df = parts[name]
        id = F.coalesce(F.col(part.id).cast("string"), F.lit("")) if _present(df, part.id) else F.lit("")
        kept = df.where(part.keep()) if part.keep else df
        own = kept.select(id.alias("id"), part.problem().alias("problem"), part.answer().alias("answer"), F.lit(part.split).alias("split"), F.lit(i).alias("part"), F.col(order).alias("at"))
        rows = own if rows is None else rows.unionByName(own)
    first = ["part", "at"]
    if source.half is not None:
        first = ["__rank"]
        shuffled = ranked(rows.withColumn("__h", hash_order(seed, "at")), ["__h", "part", "at"], "__rank")
        size = shuffled.agg(F.floor(F.count("*") / 2).alias("__half"))
        cut = F.col("__rank") <= F.col("__half")
        # one row
        rows = shuffled.join(F.broadcast(size)).where(cut if source.half == 0 else ~cut).drop("__half", "__h")
    rows = rows if most is None else top(rows, most, first)
    return rows.drop("__rank")


def user_prompt(problem: Column, key: str) -> Column:
    own = F.concat(problem, F.lit(". Your answer should be True/False.")) if source_name(key) == "strategyqa" else problem
    return F.concat(F.lit(_ASK), own)


def records(rows: DataFrame, key: str) -> DataFrame:
    """Nested records with an index from 0 in the order of the rows."""
    at = ranked(rows, ["part", "at"], "index").withColumn("index", F.col("index") - 1)
    return at.select(
        F.lit(source_name(key)).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), user_prompt(F.col("problem"), key).alias("content"))).alias("prompt"),
        F.struct(F.col("answer").alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct("split", "index", F.col("index").alias("original_index")).alias("extra_info"),
    )


def of_split(records: DataFrame, split: str) -> DataFrame:
    """The records of a split; all of them where it has none."""
    own = records.where(F.col("extra_info.split") == split)
    return records if own.isEmpty() else own


# ---- prompt files ------------------------------------------------------------------------------------------


def read_prompts(spark: SparkSession, path: str, first: int = 1, last: int = 10_000) -> DataFrame:
    """(line, problem, answer, index, source, entry) of the physical lines ``first`` to ``last`` of a file of JSON objects, or of
    the elements of a file that holds one list. Where all have a training record's fields, the problem is its messages as JSON;
    else, for all, it is what stands under problem, else under prompt, else the entry itself. Blank lines count but give no
    row; a line that is no object is an error."""
    head = spark.read.text(path).where(F.btrim("value", F.lit(" \t\ufeff")) != "").limit(1).collect()
    if head and head[0][0].lstrip(" \t\ufeff").startswith("["):
        listed = F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"))
        rows = spark.read.text(path, wholetext=True).select(listed.alias("line", "row"))
    else:
        rows = read_lines_as_variants(spark, path)
    rows = rows.withColumn("line", F.col("line").cast("long") + 1).where(F.col("line").between(first, last))
    return prompts_of(rows)


def prompts_of(rows: DataFrame) -> DataFrame:
    """The same of (line, row) with a VARIANT each."""
    row = F.col("row")
    text = lambda *keys: F.coalesce(*(F.try_variant_get(row, f"$.{k}", "string") for k in keys))
    there = lambda key: F.try_variant_get(row, f"$.{key}", "variant").isNotNull()
    full = there("prompt") & there("reward_model.ground_truth") & there("extra_info.index") & there("data_source")
    whole = rows.where(F.assert_true(row.isNotNull(), F.concat(F.lit("no JSON object in line "), F.col("line").cast("string"))).isNull())
    trained = whole.agg(F.coalesce(F.bool_and(full), F.lit(False)).alias("all")).first()["all"]
    if trained:
        fields = (text("prompt"), text("reward_model.ground_truth"), F.try_variant_get(row, "$.extra_info.index", "long"), text("data_source"))
    else:
        fields = (F.coalesce(text("problem", "prompt"), F.to_json(row)), F.coalesce(text("answer", "ground_truth"), F.lit("")), F.lit(None).cast("long"), F.coalesce(text("data_source"), F.lit("")))
    return whole.select("line", *(f.alias(n) for f, n in zip(fields, ("problem", "answer", "index", "source"), strict=True)), F.to_json(row).alias("entry"))
