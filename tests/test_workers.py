"""Python workers must not need the package: a cluster ships no copy of it by itself."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys, datetime as dt
sys.path.insert(0, {repo!r})
from daygrid.session import build_session
from daygrid.operators.association import acf, ljung_box, pacf
from daygrid.operators.bootstrap import bootstrap_intervals
from daygrid.operators.learning import direct_task
from daygrid.operators.models import direct_arx
spark = build_session("worker", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
df = spark.createDataFrame([(d, float(i * i % 7)) for i, d in enumerate(days)], "day date, y double")
assert ljung_box(acf(df, [], "day", "y", 14), []).count() == 2
assert pacf(df, [], "day", "y", 5).count() == 6
assert bootstrap_intervals(df.selectExpr("day AS target", "y AS y_real", "y + 1 AS a"), ["a"], resamples=20).first().bias == -1.0
task = direct_task(df, [], "day", "y", 1, "2024-02-10", "2024-02-20")
assert direct_arx(task, [], ["y"], 1).where("y_pred is not null").count() == 11
"""


def test_functions_travel_by_value(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
