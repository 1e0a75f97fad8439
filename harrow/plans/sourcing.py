"""Queries of benchmarks, training sources, canonical hashes and reward managers."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import managers as G
from harrow.functions import rewards as R
from harrow.plans import standins as S
from harrow.plans.registry import query, r6
from harrow.sources import benchmarks as B
from harrow.sources import files as I
from harrow.sources import prompts as P

ROLL = "WITH " + S.SQL["rollouts"]


# ---- benchmarks: orders as word problems, parts as contest problems, customers' orders as lists of answers


def _word_problems(spark, sf_dir):
    """Of every seven orders one lacks the mark, one the answer's text and one the key."""
    k, total = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    answer = F.when(k % 7 == 3, total).when(k % 7 == 5, F.concat(total, F.lit(" ####  "))).otherwise(F.concat(F.lit("a #### b\n#### "), total))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Cost of "), k.cast("string"), F.lit("?")).alias("question"), answer.alias("answer"), k.alias("id"))


def _contest(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat(F.lit("Half of "), F.col("p_size").cast("string"), F.lit("?")).alias("problem"), (F.col("p_size") / 2).alias("answer"), F.array(F.lit(" "), "p_type", "p_brand").alias("subject"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).alias("problem_idx"), F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("id"))


def _olympiad(spark, sf_dir):
    """Every customer; those without orders have no answers."""
    o = S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("final_answer"))
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left")
    return c.select("c_custkey", F.concat(F.lit("Orders of "), "c_name", F.lit("?")).alias("question"), F.coalesce("final_answer", F.array().cast("array<bigint>")).alias("final_answer"), F.lit("").alias("solution"), F.lit("Combinatorics").alias("subfield"), F.col("c_custkey").alias("id"))


_GSM = "w AS (SELECT o_orderkey AS line, o_orderkey % 7 AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total, 'Cost of ' || o_orderkey || '?' AS question FROM orders)"
_AMC = "a AS (SELECT p_partkey AS line, 'Half of ' || p_size || '?' AS question, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE p_size // 2 || '.5' END AS answer, p_type || ', ' || p_brand AS category, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'id' || p_partkey END AS source_id FROM part)"
_OLY = "l AS (SELECT c_custkey AS line, 'Orders of ' || c_name || '?' AS question, (SELECT string_agg(o_orderkey, ', ' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS answer FROM customer)"


@query(f"""WITH {_GSM}, {_OLY} SELECT 'gsm8k' AS benchmark, line, CASE k WHEN 3 THEN 'no #### in the answer' ELSE 'empty question or answer' END AS fault FROM w WHERE k IN (3, 5)
  UNION ALL SELECT 'gsm8k', line, 'empty question or answer' FROM w WHERE k = 3 UNION ALL SELECT 'gsm8k', NULL, count(*) || ' rows, not 1319' FROM w HAVING count(*) <> 1319
  UNION ALL SELECT 'olympiadbench', line, f FROM l, (VALUES ('the final answers are not a filled list'), ('empty question or answer')) AS t(f) WHERE answer IS NULL
  UNION ALL SELECT 'olympiadbench', NULL, count(*) || ' rows, not 675' FROM l HAVING count(*) <> 675
  UNION ALL SELECT 'hmmt26', line, 'missing keys: answer, problem, problem_idx' FROM l UNION ALL SELECT 'hmmt26', line, 'empty question or answer' FROM l UNION ALL SELECT 'hmmt26', NULL, count(*) || ' rows, not 33' FROM l HAVING count(*) <> 33""")
def benchmark_faults(spark, sf_dir):
    """The customers' rows are also taken for another benchmark, whose keys they lack."""
    given = {"gsm8k": B.as_rows(_word_problems(spark, sf_dir), "o_orderkey"), "olympiadbench": B.as_rows(_olympiad(spark, sf_dir), "c_custkey"), "hmmt26": B.as_rows(_olympiad(spark, sf_dir), "c_custkey")}
    found = [B.faults(rows, name).select(F.lit(name).alias("benchmark"), "line", "fault") for name, rows in given.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {_GSM}, {_AMC}, {_OLY}, u AS (SELECT 1 AS part, 'gsm8k' AS data_source, line, question, total AS answer, '' AS category, CAST(line AS VARCHAR) AS source_id FROM w WHERE k NOT IN (3, 5)
    UNION ALL SELECT 0, 'amc23', line, question, answer, category, source_id FROM a UNION ALL SELECT 2, 'olympiadbench', line, question, answer, 'Combinatorics', CAST(line AS VARCHAR) FROM l WHERE answer IS NOT NULL)
  SELECT data_source, question, answer, category, source_id, row_number() OVER (ORDER BY part, line) - 1 AS idx, row_number() OVER (PARTITION BY part ORDER BY line) - 1 AS benchmark_index FROM u""")
def benchmark_input(spark, sf_dir):
    """The prompts of three benchmarks, without the rows that have faults."""
    k = F.col("o_orderkey") % 7
    parts = {"amc-23": B.as_rows(_contest(spark, sf_dir), "p_partkey"), "gsm-8k": B.as_rows(_word_problems(spark, sf_dir).where(~k.isin(3, 5)), "o_orderkey"), "olympiad-bench": B.as_rows(_olympiad(spark, sf_dir).where(F.size("final_answer") > 0), "c_custkey")}
    got = B.evaluation_input(parts)
    e = F.col("extra_info")
    return got.select("data_source", F.col("prompt")[1]["content"].alias("question"), F.col("reward_model.ground_truth").alias("answer"), e["category"].alias("category"), e["source_id"].alias("source_id"), e["index"].alias("idx"), e["benchmark_index"].alias("benchmark_index"))


# ---- training sources -------------------------------------------------------------------------------


def _quiz(spark, sf_dir):
    k = F.col("p_partkey")
    letter = F.when(k % 4 == 0, F.lit(" ")).when(k % 4 == 1, F.chr((k % 3 + 65).cast("int")))
    options = F.when(k % 5 != 0, F.array("p_brand", F.concat(F.lit(" "), "p_type"), "p_name")).otherwise(F.array().cast("array<string>"))
    return S.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" ")).alias("question"), options.alias("options"), letter.alias("answer"), (k % 29).cast("int").alias("answer_index"), F.col("p_type").alias("category"), k.alias("question_id"))


_QUIZ = r"""q AS (SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS id, p_name || CASE WHEN p_partkey % 5 <> 0 THEN chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_name || chr(10) || 'Choose the correct option by its alphabet. You answer should be \boxed{A/B/C/...}\n' ELSE '' END AS problem,
    CASE WHEN p_partkey % 4 = 1 THEN chr(CAST(p_partkey % 3 + 65 AS INT)) WHEN p_partkey % 29 <= 25 THEN chr(CAST(p_partkey % 29 + 65 AS INT)) ELSE '' END AS answer FROM part)"""


@query(f"WITH {_QUIZ} SELECT id, problem, answer, 'train' AS split FROM q")
def quiz_source(spark, sf_dir):
    return P.standardized({"test": _quiz(spark, sf_dir)}, "MMLU-Pro", "p_partkey").select("id", "problem", "answer", "split")


_AIME = """m AS (SELECT 0 AS part, o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS problem, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS answer FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 1, p_partkey, 'p' || p_partkey, p_name, CAST(p_size AS VARCHAR) FROM part)"""


def _aime(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    solution = F.concat(F.lit("first \\boxed{0}, then \\boxed{"), F.floor("o_totalprice").cast("string"), F.lit("}"))
    first = o.select(F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("problem"), solution.alias("solution"))
    second = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("at"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("problem"), F.col("p_size").alias("answer"))
    return {"aime24": first, "aime25": second}


@query(f"WITH {_AIME} SELECT id, problem, answer FROM m QUALIFY row_number() OVER (ORDER BY part, pos) <= 800")
def merged_source(spark, sf_dir):
    """The first 800 rows of two parts: of the first part, and of the second what is left."""
    return P.standardized(_aime(spark, sf_dir), "aime24_25", "at", most=800).select("id", "problem", "answer")


@query("""SELECT CASE WHEN r <= n // 2 THEN 'theoremqa_train' ELSE 'theoremqa_test' END AS source, id, problem, answer FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'About ' || o_orderpriority AS problem, o_orderstatus AS answer,
  row_number() OVER (ORDER BY md5('42-' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)""")
def halved_source(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("id"), F.concat(F.lit("About "), "o_orderpriority").alias("Question"), F.col("o_orderstatus").alias("Answer"))
    half = lambda key: P.standardized({"test": o}, key, "o_orderkey").select(F.lit(key).alias("source"), "id", "problem", "answer")
    return half("theoremqa_train").unionByName(half("theoremqa_test"))


@query(f"WITH {_AIME} SELECT 'aime' AS data_source, 'Please reason step by step, and put your final answer within \\boxed{{}}.' || chr(10) || chr(10) || problem AS prompt, answer, 'train' AS split, row_number() OVER (ORDER BY part, pos) - 1 AS idx FROM m")
def source_records(spark, sf_dir):
    got = P.of_split(P.records(P.standardized(_aime(spark, sf_dir), "aime", "at"), "aime"), "val")
    e = F.col("extra_info")
    return got.select("data_source", F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("answer"), e["split"].alias("split"), e["index"].alias("idx"))


# ---- hashes ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(to_json({a: [{k: n_chars, v: lang}], id: doc_id, z: {lang: CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, source: source}})) AS hash FROM documents")
def canonical_hashes(spark, sf_dir):
    """Digests of nested records, whose fields stand in another order in the table."""
    lang = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.struct("source", lang.alias("lang")).alias("z"), F.col("doc_id").alias("id"), F.array(F.struct(F.col("lang").alias("v"), F.col("n_chars").alias("k"))).alias("a"))
    return d.select("doc_id", F.sha2(I.canonical_json(d, "z", "id", "a"), 256).alias("hash"))


# ---- reward managers ------------------------------------------------------------------------------------


def _responses(spark, sf_dir):
    line = S.rollouts(spark, sf_dir)
    text = F.concat(F.lit("so \\boxed{"), F.col("length").cast("string"), F.lit("} #### "), F.col("length").cast("string"))
    source = F.when(F.col("sample_id") % 2 == 0, "math").otherwise("gsm8k")
    truth = F.when(F.col("passed"), F.col("length").cast("string")).otherwise("0")
    kept = F.when(F.col("masked_in"), F.col("length")).otherwise(0)
    return line.select("group_id", "sample_id", source.alias("source"), text.alias("response"), truth.alias("truth"), kept.alias("length"), F.lit(50).alias("width"))


_PLACED = "round(reward, 6) + 0.0 AS reward, CASE WHEN reward = 0 THEN 0 WHEN kept > 0 THEN kept ELSE 50 END AS place"
_KEPT = f"{ROLL}, k AS (SELECT *, CASE WHEN masked_in THEN length ELSE 0 END AS kept FROM rollouts)"


def _placed(df):
    """The reward and the place, from 1, of the token that has it; 0 for a reward of 0."""
    at = F.when(F.col("reward") == 0, F.lit(0).cast("long")).otherwise(F.array_position("token_rewards", F.col("reward")))
    return df.select("group_id", "sample_id", r6("reward").alias("reward"), at.alias("place"))


@query(f"{_KEPT}, r AS (SELECT * EXCLUDE (reward), CASE WHEN passed THEN 1.0 ELSE 0.0 END + least(-(kept - 30) / 20 * 0.5, 0) AS reward FROM k) SELECT group_id, sample_id, {_PLACED} FROM r")
def manager_dapo(spark, sf_dir):
    return _placed(G.managed("dapo", _responses(spark, sf_dir), most=50, buffer=20, factor=0.5, log=True))


@query(f"{_KEPT}, r AS (SELECT * EXCLUDE (reward), CASE WHEN passed THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM k) SELECT group_id, sample_id, {_PLACED} FROM r")
def manager_naive(spark, sf_dir):
    return _placed(G.managed("naive", _responses(spark, sf_dir)))


def _halved(sources, responses, truths, right=1.0):
    """Half as much for one source, with what was read."""
    given = [r.rpartition("#### ")[2] for r in responses]
    return [{"score": right * (0.5 if s == "math" else 1.0) * (g == t), "acc": g == t, "pred": g} for s, g, t in zip(sources, given, truths, strict=True)]


@query(f"{_KEPT}, r AS (SELECT * EXCLUDE (reward), CASE WHEN passed THEN CASE WHEN sample_id % 2 = 0 THEN 1.5 ELSE 3.0 END ELSE 0.0 END::DOUBLE AS reward FROM k) SELECT group_id, sample_id, {_PLACED}, passed, CAST(length AS VARCHAR) AS pred FROM r")
def manager_batch(spark, sf_dir):
    got = G.managed("batch", _responses(spark, sf_dir), _halved, right=3.0)
    return _placed(got).join(got.select("group_id", "sample_id", "passed", F.col("extra")["pred"].alias("pred")), ["group_id", "sample_id"])


def _strict(source, response, truth):
    """A list for short answers; fails where the truth is no answer."""
    given = response.rpartition("#### ")[2]
    if truth == "0":
        raise ValueError("no truth")
    return [len(given) / 2, given] if len(given) < 2 else len(given)


@query(f"{_KEPT}, r AS (SELECT * EXCLUDE (reward), CASE WHEN NOT passed THEN 0.0 WHEN length < 10 THEN 0.5 ELSE 2.0 END::DOUBLE AS reward FROM k) SELECT group_id, sample_id, {_PLACED} FROM r")
def manager_prime(spark, sf_dir):
    return _placed(G.managed("prime", _responses(spark, sf_dir), _strict))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM orders""")
def countdown_scores(spark, sf_dir):
    """A third reach the target; others miss it by one, or the problem states none."""
    k, a = F.col("o_orderkey"), (F.col("o_custkey") + 1).cast("string")
    target = (F.col("o_custkey") + 4 + (k % 3 == 1).cast("int")).cast("string")
    problem = F.concat(F.lit("Given the numbers [3, "), a, F.lit("], find an expression to "), F.when(k % 3 == 2, "stop").otherwise(F.concat(F.lit("reach the target "), target)), F.lit("."))
    response = F.concat(F.lit("so \\boxed{3+"), a, F.lit("="), target, F.lit("}"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", R.dispatch(F.lit("countdown"), response, problem).alias("score"))
