"""Run as a script: operators on a small cluster of two executors, one of which is killed on the way.

Arguments: a folder that all share, and the folder with documents.parquet. Prints one JSON line.
"""

import json
import os
import sys
import threading
import time
from pathlib import Path

import psutil
import pyspark

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def executors() -> list[psutil.Process]:
    return [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]


def lose_one(shared: Path, after: int, lost: list[int]) -> None:
    """Kill an executor of this process's own cluster when so many tables have been begun."""
    while len(list(shared.iterdir())) < after:
        time.sleep(0.05)
    victim = executors()[0]
    lost.append(victim.pid)
    victim.kill()


def main(shared: Path, docs: str) -> None:
    home = shared.parent / "home"
    home.mkdir()
    for name in ("jars", "bin"):
        (home / name).symlink_to(Path(pyspark.__file__).parent / name)
    (home / "RELEASE").touch()
    os.environ["SPARK_HOME"] = str(home)
    os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"
    os.environ["PYSPARK_PYTHON"] = sys.executable
    from larkspur.llm import divergence, embeddings, mixing, simhash, substrings
    from larkspur.session import session

    conf = {"spark.executor.memory": "800m", "spark.sql.shuffle.partitions": "6", "spark.checkpoint.dir": str(shared), "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"}
    spark = session("local-cluster[2,1,1024]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    table = spark.read.parquet(docs).repartition(6)
    vectors = spark.read.parquet(docs.replace("documents", "embeddings")).repartition(6)
    lost: list[int] = []
    out = {}
    runs = {
        "substrings": substrings.dedup,
        "mixing": lambda d: mixing.mix(d, narrow_only=True),
        "groups": simhash.groups,
        "vectors": lambda _: embeddings.near_duplicates(vectors),
        "sources": divergence.audited,
    }
    for name, run in runs.items():
        thread = threading.Thread(target=lose_one, args=(shared, len(list(shared.iterdir())) + 2, lost))
        thread.start()
        out[name] = sorted(map(str, run(table).collect()))
        thread.join()
    print(json.dumps({"lost": len(lost), **out}), flush=True)
    os._exit(0)


if __name__ == "__main__":
    main(Path(sys.argv[1]), sys.argv[2])
