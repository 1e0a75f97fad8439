"""Evaluation benchmarks by name: what their rows must hold, how these become questions and answers, and the combined input
of an evaluation.

A row is a VARIANT, so that a benchmark's files are read without a schema of their own and a whole number keeps its type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import answers as A
from harrow.operators.select import ranked
from harrow.sources.files import read_numbered

_POINTER = "version https://git-lfs.github.com/spec/"
_SPACE = " \t\n\r\f\v"


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACE))


def _has(row: Column, key: str) -> Column:
    """Is the key there, if only with a JSON null?"""
    return F.try_variant_get(row, f"$.{key}", "variant").isNotNull()


def _text(row: Column, key: str) -> Column:
    """A field as text, a whole number without decimals; null where it is absent or null."""
    got = F.try_variant_get(row, f"$.{key}", "variant")
    number = F.try_variant_get(row, f"$.{key}", "double")
    broken = F.schema_of_variant(got).rlike("^(DECIMAL|DOUBLE|FLOAT)")
    whole = broken & (number == F.floor(number)) & (F.abs(number) < 1e18)
    return F.when(whole, number.cast("long").cast("string")).otherwise(F.try_variant_get(row, f"$.{key}", "string"))


def _list(row: Column, key: str) -> Column:
    """A field that is a list, as texts; else null."""
    is_list = F.schema_of_variant(F.try_variant_get(row, f"$.{key}", "variant")).startswith("ARRAY")
    return F.when(is_list, F.transform(F.try_variant_get(row, f"$.{key}", "array<string>"), lambda x: _strip(F.coalesce(x, F.lit("")))))


def _first(row: Column, keys: tuple[str, ...]) -> Column:
    """The first field that isn't empty; a list as its filled items."""
    filled = [F.nullif(F.coalesce(F.array_join(F.filter(_list(row, k), lambda x: x != ""), ", "), _strip(_text(row, k))), F.lit("")) for k in keys]
    return F.coalesce(*filled, F.lit(None).cast("string"))


def _after_hashes(row: Column) -> Column:
    text = _text(row, "answer")
    return F.when(F.contains(text, F.lit("####")), _strip(F.substring_index(text, "####", -1)))


def _no_hashes(row: Column) -> Column:
    return F.when(~F.contains(_text(row, "answer"), F.lit("####")), "no #### in the answer")


def _no_list(row: Column) -> Column:
    return F.when(_has(row, "final_answer") & (F.coalesce(F.size(_list(row, "final_answer")), F.lit(0)) < 1), "the final answers are not a filled list")


def _no_box(row: Column) -> Column:
    fault = A.boxed_fault(F.coalesce(_text(row, "solution"), F.lit("")))
    return F.when(_has(row, "solution"), F.concat(F.lit("the solution's last box: "), fault))


@dataclass(frozen=True)
class Benchmark:
    """How many rows a benchmark has, the keys of each, its other names, and where its fields come from."""

    rows: int
    required: tuple[str, ...]
    aliases: tuple[str, ...] = ()
    question: str = "problem"
    answer: Callable[[Column], Column] = lambda row: _strip(_text(row, "answer"))
    fault: Callable[[Column], Column] | None = None
    category: tuple[str, ...] = ("problem_type", "subject", "type")
    source_id: tuple[str, ...] = ("problem_idx", "id")


_PLAIN = ("id", "problem", "answer")

#: Names, numbers of rows, keys and aliases of the benchmarks, in the order of an evaluation.
BENCHMARKS: dict[str, Benchmark] = {
    "gsm8k": Benchmark(1319, ("question", "answer"), ("gsm-8k",), "question", _after_hashes, _no_hashes, (), ("id",)),
    "math500": Benchmark(500, ("problem", "solution", "answer"), ("math-500",), category=("subject",), source_id=("unique_id", "id")),
    "minerva_math": Benchmark(272, ("problem", "solution", "type", "idx"), ("minerva", "minerva-math"), "problem", lambda row: A.boxed_strict(_text(row, "solution")), _no_box, ("type",), ("idx",)),
    "olympiadbench": Benchmark(675, ("id", "question", "solution", "final_answer"), ("olympiad-bench",), "question", lambda row: F.array_join(_list(row, "final_answer"), ", "), _no_list, ("subfield",), ("id",)),
    "aime24": Benchmark(30, _PLAIN, ("aime-24", "aime2024", "aime-2024")),
    "aime25": Benchmark(30, _PLAIN, ("aime-25", "aime2025", "aime-2025")),
    "aime26": Benchmark(30, _PLAIN, ("aime-26", "aime2026", "aime-2026")),
    "hmmt26": Benchmark(33, ("problem_idx", "problem", "answer"), ("hmmt-26", "hmmt2026", "hmmt-2026", "hmmt-feb-2026")),
    "amc23": Benchmark(40, _PLAIN, ("amc-23", "amc2023", "amc-2023")),
}

_NAMES = {a: name for name, b in BENCHMARKS.items() for a in (name, *b.aliases)}


def names(given: Iterable[str] | None = None) -> list[str]:
    """The benchmarks' own names, each once, in the order given; all of them where none is given. An unknown one is an error."""
    out: list[str] = []
    for raw in given or BENCHMARKS:
        if raw.lower() not in _NAMES:
            raise ValueError(f"unknown benchmark {raw!r}; there are {', '.join(BENCHMARKS)}")
        if _NAMES[raw.lower()] not in out:
            out.append(_NAMES[raw.lower()])
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line, row, pointer) of JSON lines, lines from 0, blank ones passed over. ``row`` is null where a line is no JSON
    object; ``pointer`` tells a reference to a stored file from data."""
    value = F.regexp_replace("value", "^\ufeff", "")
    parsed = F.try_parse_json(value)
    row = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    return read_numbered(spark, path).where(_strip(value) != "").select("line", row.alias("row"), value.startswith(_POINTER).alias("pointer"))


def as_rows(df: DataFrame, line: str) -> DataFrame:
    """The same from a table: ``line`` orders its rows, the other columns are the row's keys."""
    row = F.to_variant_object(F.struct(*(c for c in df.columns if c != line)))
    return df.select(F.col(line).cast("long").alias("line"), row.alias("row"), F.lit(False).alias("pointer"))


def _fields(rows: DataFrame, b: Benchmark) -> DataFrame:
    row = F.col("row")
    return rows.select("line", "row", "pointer", _text(row, b.question).alias("question"), b.answer(row).alias("answer"), _first(row, b.category).alias("category") if b.category else F.lit(None).cast("string").alias("category"), F.coalesce(_first(row, b.source_id), F.lit("")).alias("source_id"))


def faults(rows: DataFrame, name: str) -> DataFrame:
    """(line, fault): what is wrong with the rows of a benchmark, one per check, and with their number (line null). The
    number is one aggregate; the rest a pass without a shuffle."""
    b, row = BENCHMARKS[names([name])[0]], F.col("row")
    missing = F.array_join(F.array_compact(F.array(*(F.when(~_has(row, k), k) for k in sorted(b.required)))), ", ")
    empty = (_strip(F.coalesce("question", F.lit(""))) == "") | (_strip(F.coalesce("answer", F.lit(""))) == "")
    own = [F.when(row.isNotNull(), b.fault(row))] if b.fault else []
    checks = [
        F.when(F.col("pointer"), "a pointer to a stored file"),
        F.when(row.isNull() & ~F.col("pointer"), "not a JSON object"),
        F.when(row.isNotNull() & (missing != ""), F.concat(F.lit("missing keys: "), missing)),
        *own,
        F.when(row.isNotNull() & empty, "empty question or answer"),
    ]
    each = _fields(rows, b).select("line", F.explode(F.array_compact(F.array(*checks))).alias("fault"))
    number = rows.agg(F.count("*").alias("n")).where(F.col("n") != b.rows)
    return each.unionByName(number.select(F.lit(None).cast("long").alias("line"), F.concat(F.col("n").cast("string"), F.lit(f" rows, not {b.rows}")).alias("fault")))


def check(rows: DataFrame, name: str) -> None:
    """Fails with the first faults, if there are any."""
    found = faults(rows, name).orderBy(F.col("line").asc_nulls_first(), "fault").limit(10).collect()
    if found:
        raise ValueError(f"{names([name])[0]}: " + "; ".join(r["fault"] if r["line"] is None else f"line {r['line']}: {r['fault']}" for r in found))


def standardized(rows: DataFrame, name: str) -> DataFrame:
    """(line, question, answer, category, source_id). Rows with faults come with null or empty fields; :func:`check` finds them."""
    return _fields(rows, BENCHMARKS[names([name])[0]]).drop("row", "pointer")


def evaluation_input(parts: dict[str, DataFrame], system: str = "Please reason step by step, and put your final answer within \\boxed{}.") -> DataFrame:
    """The prompts of several benchmarks in the given order: messages, truth and where each comes from. ``index`` runs over
    all from 0, ``benchmark_index`` over a benchmark's own rows."""
    rows = None
    for i, (name, part) in enumerate(parts.items()):
        own = standardized(part, name).withColumns({"benchmark": F.lit(names([name])[0]), "__part": F.lit(i)})
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("there are no benchmarks")
    at = ranked(rows, ["__part", "line"], "index").withColumn("index", F.col("index") - 1)
    first = at.groupBy("__part").agg(F.min("index").alias("__first"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    # one row per benchmark
    return at.join(F.broadcast(first), "__part").select(
        F.col("benchmark").alias("data_source"),
        F.array(message("system", F.lit(system)), message("user", F.col("question"))).alias("prompt"),
        F.lit("math").alias("ability"),
        F.struct(F.col("answer").alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct("index", "benchmark", (F.col("index") - F.col("__first")).alias("benchmark_index"), "source_id", F.coalesce("category", F.lit("")).alias("category")).alias("extra_info"),
    )
