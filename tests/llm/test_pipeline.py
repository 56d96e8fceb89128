"""The pipeline's stages against brute force, the registry, and the library without this subpackage."""

import base64
import hashlib
import os
import re
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as E
import corpus_pipeline as C
from llm_tables import documents
from test_mixing import brute as brute_mix
from test_near_dup import brute as brute_classes
from touchline.llm import queries as Q
from tools.oracle_check import check

REPO = os.path.dirname(os.path.abspath(E.__file__))
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name, sf):
    sf_dir, con = f"/root/testdata/{sf}", duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    line, ok = check(spark, con, name, Q.QUERIES[name], Q.ORACLES[name], sf_dir)
    assert ok, line


def test_registered():
    names = E.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "mixing", "byte_bpe"]


def test_stages_equal_brute_force(spark, tmp_dir):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang", "source").collect()]
    odd = [(9000, None, "en", "src1"), (9001, "", "en", None), (9002, "12 !!", None, "src2"),
           (9003, given[0][1], "en", "src3"), (9003, given[0][1], "en", "src3")]
    docs = documents(spark, given + odd)
    read, kept = docs, {}
    for name, stage in C.STAGES:
        stage(spark, read, "/root/testdata/sf0.001").write.parquet(f"{tmp_dir}/{name}")
        read = spark.read.parquet(f"{tmp_dir}/{name}")
        kept[name] = read.collect()
        if name != C.STAGES[-1][0]:
            assert read.columns == docs.columns
    one = sorted((r.doc_id, r.text, r.source) for r in kept["language_id"])
    assert one == sorted((i, t, s) for i, t, _, s in given + odd if t and any(c.isalpha() for c in t))
    two = sorted((r.doc_id, r.text, r.source) for r in kept["near_dedup"])
    low = {c for _, c in brute_classes([(i, t) for i, t, _ in one])}
    assert two == sorted({r for r in one if r[0] in low})
    words = Counter()
    for r in kept["mixing"]:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = Counter()
    for (i, _, _), n in brute_mix(two)[0].items():
        want[i] += n
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = Counter()
    for r in kept["mixing"]:
        ids = library.encode_ordinary(r.text)
        coded[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in kept["byte_bpe"]) == coded


def test_library_without_the_subpackage(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(REPO, root, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(n[:2] == 'op' for n in e.queries()))"],
                          cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, ops = map(int, said.stdout.split()[-2:])
    assert n >= 50 and ops == 0
