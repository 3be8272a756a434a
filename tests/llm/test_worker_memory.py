"""Workers don't keep the memory of tasks that have ended; in a session of its own, whose one worker runs them all."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]

SCRIPT = r"""
import random, re, sys
import public_tokenizers
import pyarrow as pa
from pathlib import Path
from glyphmill.llm import bpe, suffixes
from glyphmill.session import session

spark = session("local[1]", 1, spark__checkpoint__dir="file://" + sys.argv[1], spark__sql__warehouse__dir=sys.argv[1], spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("ERROR")


def probe(batches):
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"kb": [sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))]})


def held():
    return spark.range(1).coalesce(1).mapInArrow(probe, "kb long").first().kb / 1024


pick = random.Random(5)
spark.createDataFrame([(k, " ".join("".join(pick.choices("abcdefghij", k=7)) for _ in range(4000))) for k in range(90)], "doc_id long, text string").coalesce(1).write.parquet(sys.argv[1] + "/docs")
docs = spark.read.parquet(sys.argv[1] + "/docs")
for make in (suffixes.remove_repeats, lambda df: bpe.round_trip(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)):
    make(docs.limit(1)).collect()
    before = held()
    make(docs).write.format("noop").mode("overwrite").save()
    print("held", round(before), round(held()))
"""


def test_freed_memory_goes_back(tmp_path):
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    grown = [int(after) - int(before) for _, before, after in (x.split() for x in done.stdout.splitlines() if x.startswith("held"))]
    assert len(grown) == 2 and max(grown) < 60, (grown, done.stderr[-2000:])
