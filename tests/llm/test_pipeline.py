"""Each stage by a plain version of its decision, over a whole small table; run() agrees with the stages."""

import brute
import corpus_pipeline as P
from test_jaccard import brute_classes

from harrow.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_copies", "decontamination", "personal_data", "mixture"]
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= before.keys() and docs.columns[: len(columns)] == columns
        if name == "quality_rules":
            assert not [i for i in after if brute.quality(after[i])[-1]]
            passed = [i for i in before if not brute.quality(before[i])[-1]]
            assert len(after) > 0.95 * len(passed)
        elif name == "near_copies":
            assert after.keys() == {c for _, c, _ in brute_classes(list(before.items()))}
        elif name == "decontamination":
            assert after.keys() == {i for i in before if not brute.leaks(before[i], items)[-1]}
        elif name == "personal_data":
            assert after.keys() == before.keys() and not any(sum(brute.pii(t)[:4]) for t in after.values())
            assert all(after[i] == before[i] for i in after if not brute.pii(before[i])[-1] and "[" not in after[i])
    last = {(r["doc_id"], r["taken"]) for r in docs.collect()}
    assert all(t > 0 for _, t in last)
    assert {(r["doc_id"], r["taken"]) for r in P.run(spark, SF).collect()} == last


def test_entry_without_the_operators(tmp_path):
    """The entry imports, with the other queries, where the operators are not installed."""
    import pathlib
    import shutil
    import subprocess
    import sys

    top = pathlib.Path(P.__file__).parent
    shutil.copytree(top / "harrow", tmp_path / "harrow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(any(k.startswith('op') and k[2:3].isdigit() for k in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == ["False", "False"], out.stderr
