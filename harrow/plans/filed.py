"""Queries of files written from the given tables and read back, and of functions on texts and names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.functions import answers as N
from harrow.functions import rewards as R
from harrow.operators import select as T
from harrow.operators import shape as H
from harrow.operators import spectral as X
from harrow.plans import standins as S
from harrow.plans.registry import query, r6
from harrow.sources import benchmarks as B
from harrow.sources import files as I
from harrow.sources import prompts as P
from harrow.sources.tables import shared_dir

ROLL = "WITH " + S.SQL["rollouts"]
_ORDER = StructType().add("o_orderkey", "long").add("status", "string")


def _path(spark, kind):
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# ---- lines ------------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    """Orders as lines: of each ten one is blank, one cut short, and one no object."""
    k = F.col("o_orderkey")
    row = F.to_json(F.struct("o_orderkey", F.col("o_orderstatus").alias("status")))
    text = F.when(k % 10 == 3, " ").when(k % 10 == 5, F.left(row, F.lit(9))).when(k % 10 == 7, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(row)
    path = _path(spark, "lines")
    S.table(spark, sf_dir, "orders").select(text.alias("value")).write.text(path)
    return path


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 NOT IN (3, 5, 7)")
def lenient_lines(spark, sf_dir):
    return I.read_lines(spark, _lines(spark, sf_dir), _ORDER)


@query("""SELECT CASE o_orderkey % 10 WHEN 5 THEN left('{"o_orderkey":' || o_orderkey, 9) ELSE '[' || o_orderkey || ']' END AS value, true AS placed FROM orders WHERE o_orderkey % 10 IN (5, 7)""")
def malformed_lines(spark, sf_dir):
    """Lines that are no objects; a second reading finds each at the place that was named."""
    path = _lines(spark, sf_dir)
    m = F.col("_metadata")
    bad = I.bad_lines(spark, path, _ORDER)
    lines = spark.read.text(path).groupBy(m["file_path"].alias("file")).agg(F.count("*").alias("n"))
    return bad.join(lines, "file").select("value", F.col("line").between(1, F.col("n")).alias("placed"))


def _entries(spark, sf_dir, trained):
    """Orders as (line, row) of a prompt file. With ``trained`` all are training records; else every fourth has no problem of its own."""
    k = F.col("o_orderkey")
    o = S.table(spark, sf_dir, "orders")
    if trained:
        rows = o.select(k.alias("line"), F.array(F.struct(F.lit("user").alias("role"), F.col("o_orderpriority").alias("content"))).alias("prompt"), F.struct(F.col("o_orderstatus").alias("ground_truth")).alias("reward_model"), F.struct((k * 2).alias("index")).alias("extra_info"), F.lit("orders").alias("data_source"))
        return B.as_rows(rows, "line")
    own = lambda cond, value: F.when(cond, value)
    rows = o.select(k.alias("line"), own(k % 4 == 0, F.col("o_orderpriority")).alias("problem"), own(k % 4 != 3, F.concat(F.lit("p"), "o_orderpriority")).alias("prompt"), own(k % 3 == 0, F.col("o_custkey")).alias("answer"), own(k % 3 != 2, F.col("o_orderstatus")).alias("ground_truth"))
    return B.as_rows(rows, "line")


@query("""SELECT o_orderkey AS line, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 4 <> 3 THEN 'p' || o_orderpriority ELSE NULL END AS problem,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_orderstatus ELSE '' END AS answer, NULL::BIGINT AS index, '' AS source, o_orderkey % 4 = 3 AS whole FROM orders""")
def generic_prompts(spark, sf_dir):
    """Entries that are no training records; one without a problem is its own problem."""
    got = P.prompts_of(_entries(spark, sf_dir, False))
    whole = F.col("problem") == F.col("entry")
    return got.select("line", F.when(~whole, F.col("problem")).alias("problem"), "answer", "index", "source", whole.alias("whole"))


@query("""SELECT o_orderkey AS line, '[{"content":"' || o_orderpriority || '","role":"user"}]' AS problem, o_orderstatus AS answer, o_orderkey * 2 AS index, 'orders' AS source FROM orders""")
def training_prompts(spark, sf_dir):
    return P.prompts_of(_entries(spark, sf_dir, True)).drop("entry")


# ---- folders ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_orderkey % 3 AS INT) AS part FROM orders")
def numbered_parts(spark, sf_dir):
    root, o = _path(spark, "parts"), S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    for n in range(3):
        o.where(F.col("o_orderkey") % 3 == n).write.json(f"{root}/part_{n}")
    return I.read_parts(spark, f"{root}/part_*", _ORDER).select("o_orderkey", "part")


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS before FROM orders")
def resumed_rows(spark, sf_dir):
    """Half of the orders are done; the rest is appended, and all are read back."""
    path, o = _path(spark, "done"), S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    I.append(o.where("o_orderkey % 2 = 0"), path)
    left = I.resume(o, path, "o_orderkey", _ORDER)
    I.append(left.withColumn("status", F.lit("new")), path)
    return I.read_lines(spark, path, _ORDER).select("o_orderkey", (F.col("status") != "new").alias("before"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def resumed_signed(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select("o_orderkey")
    done = o.where("o_orderkey % 3 = 0").withColumn("signature", F.lit("v1"))
    return I.resume_strict(o, done, "o_orderkey", "signature", "v1")


@query("SELECT p_partkey, p_name, 2 AS copies FROM part")
def both_formats(spark, sf_dir):
    path, p = _path(spark, "both"), S.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    I.write_both(p, path)
    schema = p.schema
    both = spark.read.parquet(f"{path}.parquet").unionByName(I.read_lines(spark, f"{path}.jsonl", schema))
    return both.groupBy(*p.columns).agg(F.count("*").cast("int").alias("copies"))


@query("SELECT CAST(o_orderkey % 4 AS INT) AS step, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def dumped_steps(spark, sf_dir):
    path = _path(spark, "steps")
    o = S.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("step"), "o_custkey")
    for half in (o.where("step < 2"), o.where("step >= 2")):
        I.dump_steps(half, path)
    return spark.read.schema("o_custkey long, step int").json(path).groupBy("step").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS step, l_linenumber % 4 AS rank FROM lineitem) SELECT step, count(*) AS ranks FROM f GROUP BY 1 HAVING count(*) = 4""")
def complete_checkpoints(spark, sf_dir):
    """An order's lines are the ranks of a step, of which there should be four."""
    path = F.concat(F.lit("runs/global_step_"), F.col("l_orderkey").cast("string"), F.lit("/actor/model_world_size_4_rank_"), (F.col("l_linenumber") % 4).cast("string"), F.lit(".pt"))
    return I.complete_steps(S.table(spark, sf_dir, "lineitem").select(path.alias("path")))


@query(f"{ROLL} SELECT group_id, count(*) AS n, round(sum(reward), 6) + 0.0 AS reward FROM rollouts GROUP BY 1")
def kept_rollouts(spark, sf_dir):
    """What the second call reads is what the first one wrote."""
    root, line = _path(spark, "rollouts"), S.rollouts(spark, sf_dir).select("group_id", "reward")
    I.kept(spark, root, ("e", "p"), 8, 4, lambda: line)
    again = I.kept(spark, root, ("e", "p"), 8, 4, lambda: line.limit(0))
    return again.groupBy("group_id").agg(F.count("*").alias("n"), r6(F.sum("reward")).alias("reward"))


@query("""WITH s AS (SELECT vec_id AS group_id, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, group_id) AS place FROM s), d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents)
  SELECT group_id, place, doc_id, source FROM t LEFT JOIN d ON group_id = line WHERE place <= 50""")
def top_lines(spark, sf_dir):
    """A report of the 50 best with their lines."""
    lines = T.ranked(S.table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], "line").withColumn("line", F.col("line") - 1)
    scores = S.vectors(spark, sf_dir).select(F.col("vec_id").alias("group_id"), F.col("v")[0].alias("score"))
    return T.top_lines(scores, lines, 50).select("group_id", "place", "doc_id", "source")


# ---- names, texts and sequences ---------------------------------------------------------------------


@query("""WITH n AS (SELECT o_orderkey, o_orderkey % 9 AS k, o_orderkey % 40 AS layer FROM orders)
  SELECT o_orderkey, CASE WHEN k IN (0, 1, 2) THEN CAST(layer AS INT) END AS layer, CASE k WHEN 0 THEN 'Q' WHEN 1 THEN 'O' WHEN 2 THEN 'UP' END AS family, CASE k WHEN 0 THEN 'Q' WHEN 1 THEN 'O' END AS attention FROM n""")
def parameter_families(spark, sf_dir):
    """Names of parameters: weights of three kinds, then a bias, another module, an adapter, a layer without number, a vector, another head."""
    k, layer = F.col("o_orderkey") % 9, (F.col("o_orderkey") % 40).cast("string")
    tails = ("self_attn.q_proj.weight", "x.self_attn.o_proj.weight", "mlp.up_proj.weight", "mlp.up_proj.bias", "attention.q_proj.weight", "self_attn.q_proj.weight.lora", "self_attn.q_proj.weight", "self_attn.k_proj.weight", "lm_head.weight")
    where = F.when(k % 3 == 0, "model.layers.").when(k % 3 == 1, "h.").otherwise("net.blocks.")
    name = F.concat(where, F.when(k == 6, "x").otherwise(layer), F.lit("."), F.element_at(F.array(*map(F.lit, tails)), (k + 1).cast("int")))
    shape = F.when(k == 7, F.array(F.lit(8))).otherwise(F.array(F.lit(8), F.lit(4)))
    got = X.classify(name, shape)
    return S.table(spark, sf_dir, "orders").select("o_orderkey", got["layer"].alias("layer"), got["family"].alias("family"), X.classify(name, shape, "qkvo")["family"].alias("attention"))


@query(f"""{ROLL}, t AS (SELECT group_id, list(length ORDER BY sample_id) AS t FROM rollouts GROUP BY 1)
  SELECT group_id, list_concat(t[:4], list_resize([]::BIGINT[], greatest(4 - len(t), 0), 0)) AS "right", list_concat(list_resize([]::BIGINT[], greatest(4 - len(t), 0), 0), CASE WHEN len(t) > 4 THEN t[-4:] ELSE t END) AS "left", CASE WHEN len(t) > 5 THEN list_concat(t[:2], t[-3:]) ELSE t END AS middle FROM t""")
def cut_sides(spark, sf_dir):
    t = F.col("t")
    rows = S.rollouts(spark, sf_dir).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "length"))), lambda x: x["length"]).alias("t"))
    zero = F.lit(0).cast("long")
    return rows.select("group_id", H.pad(H.fit_length(t, 4), 4, zero).alias("right"), H.pad(H.fit_length(t, 4, "left"), 4, zero, left=True).alias("left"), H.fit_length(t, 5, "middle").alias("middle"))


@query("""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[<>`\\s]+', ' ', 'g')) AS t FROM conversations WHERE turn < 4), g AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN t END) AS a, max(CASE WHEN turn = 1 THEN t END) AS b, max(CASE WHEN turn = 2 THEN t END) AS c FROM c GROUP BY 1)
  SELECT conv_id, CASE WHEN conv_id % 3 = 2 THEN 1 ELSE 3 END::INT AS messages, CASE WHEN conv_id % 3 = 2 THEN '' ELSE coalesce(a, '') END AS first, CASE conv_id % 3 WHEN 0 THEN coalesce(b, '') ELSE '' || CASE conv_id % 3 WHEN 1 THEN ' ' || coalesce(b, '') || ' ' ELSE '' END END AS code,
    CASE WHEN conv_id % 3 = 2 THEN '' ELSE coalesce(b, '') END AS tool, CASE WHEN conv_id % 3 = 2 THEN 'the tool has no turn' END AS fault FROM g""")
def tool_transcripts(spark, sf_dir):
    """A conversation's messages as text, code and what it printed; in a third the code is fenced, in another the tool is missing."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[<>`\s]+", " "))
    c = S.table(spark, sf_dir, "conversations").where("turn < 4")
    turn = lambda n: F.coalesce(F.max(F.when(F.col("turn") == n, text)), F.lit(""))
    g = c.groupBy("conv_id").agg(turn(0).alias("a"), turn(1).alias("b"), turn(2).alias("c"))
    k = F.col("conv_id") % 3
    code = F.when(k == 0, F.concat(F.lit("```python\n"), "b", F.lit("\n```"))).when(k == 1, F.concat(F.lit(" "), "b", F.lit(" "))).otherwise("")
    rest = F.when(k == 2, "nothing").otherwise(F.concat(F.lit("\n<interpreter>"), "b", F.lit("</interpreter>"), "c", F.lit("<answer>\\boxed{1}</answer>\n")))
    whole = F.concat(F.when(k == 2, "").otherwise(F.col("a")), F.lit("<code>"), code, F.lit("</code>"), rest)
    m = F.col("t.messages")
    return g.select("conv_id", N.tool_transcript(whole).alias("t")).select("conv_id", F.size(m).alias("messages"), m[0]["content"].alias("first"), m[0]["code"].alias("code"), F.coalesce(F.try_element_at(m, F.lit(2))["content"], F.lit("")).alias("tool"), "t.fault")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN '{"key": ' || o_orderkey || ', "note": "' || o_orderstatus || CASE o_orderkey % 4 WHEN 0 THEN '' ELSE '\\n' END || o_orderpriority || '"}' END AS object,
  CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey AS VARCHAR) ELSE 'x' || o_orderkey END AS block, o_orderkey % 4 = 1 AS formed, o_orderpriority AS single, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS truth FROM orders""")
def loose_texts(spark, sf_dir):
    """Objects in texts, plain, with a bare line end, in triple quotes or cut short; code in fences; whole thoughts; spaces and stops; first truths."""
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    note = F.concat(F.when(k == 2, '"""').otherwise('"'), "o_orderstatus", F.when(k == 0, "").otherwise("\n"), "o_orderpriority", F.when(k == 2, '"""').otherwise('"'))
    text = F.concat(F.lit("```json\n{\"note\": "), note, F.lit(', "key": '), key, F.when(k == 3, "").otherwise("}\n```"))
    block = F.concat(F.lit("```python\n0```\n```"), F.when(k < 2, "python").otherwise("sh"), F.lit("\n"), F.when(k < 2, key).otherwise(F.concat(F.lit("x"), key)), F.lit("```"))
    fenced = N.code_fence(F.when(k < 2, block).otherwise(F.substring_index(block, "0```\n", -1)))
    thought = F.concat(F.when(k % 2 == 1, "<think>").otherwise(""), "o_orderpriority", F.lit("</think> so "), F.when(k == 3, "boxed").otherwise("\\boxed{1}"))
    spaced = F.concat(F.lit(" $ "), F.replace("o_orderpriority", F.lit(" "), F.lit(" \n ")), F.lit(" $..."))
    solution = F.concat(F.lit("a ####\n#### "), F.format_number(F.floor("o_totalprice"), 0), F.lit("\n#### 7"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", N.json_object(text).alias("object"), fenced.alias("block"), N.well_formed(thought).alias("formed"), N.simple_normal(spaced).alias("single"), N.first_hash_answer(solution).alias("truth"))


@query(f"""{ROLL} SELECT group_id, round(sum((passed AND sample_id < 3)::INT) / least(count(*), 3), 6) + 0.0 AS first_three, round(sum(passed::INT) / count(*), 6) + 0.0 AS every FROM rollouts GROUP BY 1""")
def pass_rates(spark, sf_dir):
    rows = S.rollouts(spark, sf_dir).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "passed"))), lambda x: x["passed"]).alias("r"))
    return rows.select("group_id", r6(R.pass_rate(F.col("r"), 3)).alias("first_three"), r6(R.pass_rate(F.col("r"), None)).alias("every"))
