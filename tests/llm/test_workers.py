"""Python workers must not need the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from daygrid.session import build_session
from daygrid.llm import alignment, bpe, decontamination, divergence, near_duplicates, pii, pivots, repeats
spark = build_session("worker", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
docs = spark.createDataFrame([(i, "call +1 (408) 555-7715 now " + "word " * i) for i in range(8)] * 2, "doc_id long, text string")
assert near_duplicates.near_duplicates(docs).count() == 16
assert repeats.remove_repeats(docs, 20).count() == 16
assert bpe.encode(docs, bpe.send_lexicon(docs, bpe.tokenizer_path(), 10)).count() == 16
assert decontamination.contained_items(docs, docs.withColumnRenamed("doc_id", "item_id")).count() > 0
assert alignment.with_pair_counts(*alignment.digests(docs, bpe.tokenizer_path(), bpe.tokenizer_path("piece_bpe_32k.model"))).count() == 16
assert divergence.divergence(docs.selectExpr("text", "'en' AS lang", "cast(doc_id % 2 AS string) AS source")).count() > 2
rows = docs.selectExpr("doc_id AS vec_id", "array(1F, cast(doc_id AS float)) AS embedding")
assert pivots.top_k(rows, rows.vec_id % 20 == 0, 3).count() == 6
assert pii.find_spans(docs, pii.train(pii.labelled_windows(docs))).where("size(base) = 1").count() == 16
"""


def test_functions_travel_by_value(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert run.returncode == 0, run.stderr[-3000:]
