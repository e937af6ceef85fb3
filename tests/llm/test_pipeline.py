"""The pipeline against its stages restated one by one, and the registration of the queries."""

import os
import re
import shutil

import __spark_entry__ as E
import corpus_pipeline
from lingomesh.llm import quality_rules, toxicity
from lingomesh.llm.common import components, gapless_rank

from . import brute
from .test_pages_models import labelled


def test_pipeline_equals_its_stages(spark, tmp_path):
    docs, labels = labelled(300)
    docs = [(i, t + " ." * 60 if i % 2 else t, "en" if i % 3 else None, "s", len(t)) for i, t, _ in docs]
    base = " ".join(f"p{k}" for k in range(120))
    docs += [(900 + k, base + f" tail{k}", "xx", "s", 1) for k in range(4)] + [(910, base + " " + " ".join(f"r{k}" for k in range(400)), "xx", "s", 1)]
    docs += [(920, None, None, None, None), (None, None, None, None, None), (901, base + " tail1", "xx", "s", 1), (930, " ".join(f"p{k}" for k in range(30, 90)), "xx", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame([(*d, "e") for d in docs], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, lab = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")

    left = [(r["doc_id"], r["text"]) for r in toxicity.accepted(table, lab).select("doc_id", "text").collect()]
    assert len(left) < len(docs)
    first = spark.createDataFrame(left, "doc_id long, text string").join(table.select("doc_id", "lang").distinct(), "doc_id", "left")
    bad = {r["doc_id"] for r in quality_rules.metrics(first).collect() if not r["kept"]}
    left = [d for d in left if d[0] not in bad]
    assert {900, 910} <= {i for i, _ in left} and 920 not in {i for i, _ in left}
    roots = {i: c for i, _, c in brute.jaccard_classes(left)}
    left = [d for d in left if roots[d[0]] == d[0]]
    assert {900, 910} <= {i for i, _ in left} and not {901, 902, 903} & {i for i, _ in left}
    words = {i: (n, cut) for i, n, cut, _ in brute.substring_dedup(left)}
    left = {i for i, (n, cut) in words.items() if cut < n or n == 0}
    assert words[910][1] == 120 and 930 not in left

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == left
    total = {}
    for r in rows:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 1024
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, str(tmp_path))
        assert stage.columns == table.columns, name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_entry_without_the_subpackage(tmp_path):
    """The other queries stay when the folders of this subpackage are gone."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(f"{root}/lingomesh", f"{tmp_path}/lingomesh", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mapping_lean' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_components(spark):
    import random

    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2001 + i) for i in range(200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(x) == got[x] for x in parent if any(x in e and e[0] != e[1] for e in edges))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gapless_rank(spark):
    rows = [(i % 3 if i % 7 else None, i, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i long, rank2 string").repartition(4)
    got = {}
    for r in gapless_rank(df, ["k"], ["i"], "rank", rows_per_bucket=20).collect():
        got.setdefault(r["k"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 500
