"""Results do not depend on executors that are lost on the way."""

import json
import subprocess
import sys
from pathlib import Path

from larkspur.llm import divergence, embeddings, mixing, simhash, substrings


def test_a_lost_executor_changes_nothing(spark, sf, tmp_path):
    shared, docs = tmp_path / "shared", f"{sf}/documents.parquet"
    shared.mkdir()
    script = Path(__file__).with_name("lost_executor.py")
    done = subprocess.run([sys.executable, script, str(shared), docs], capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    got = json.loads(done.stdout.strip().splitlines()[-1])
    assert got.pop("lost") == 5
    table = spark.read.parquet(docs)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = {
        "substrings": substrings.dedup(table),
        "mixing": mixing.mix(table, narrow_only=True),
        "groups": simhash.groups(table),
        "vectors": embeddings.near_duplicates(vectors),
        "sources": divergence.audited(table),
    }
    assert got == {name: sorted(map(str, df.collect())) for name, df in want.items()}
