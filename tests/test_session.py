"""Sessions without any preset folder, and operators called from another working directory."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = """
    import sys
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", "2").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    assert spark.conf.get("spark.checkpoint.dir", None) is None
    from stockflow.operators.fold import sorted_fold
    from stockflow.operators.ledger import replay
    from stockflow.session import ensure_checkpoint_dir, scratch_dir
    base = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark)
    spark.range(3).checkpoint().write.parquet(scratch_dir(spark, "kept"))
    assert spark.read.parquet(scratch_dir(spark, "kept")).count() == 3
    from stockflow.plans.registry import queries
    print("ROWS", queries()["ledger_closing"](spark, "/root/testdata/sf0.001").count())
"""


def test_empty_conf_folder_and_other_directory(tmp_path):
    conf = tmp_path / "conf"
    conf.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYTHONPATH"))}
    env |= {"SPARK_CONF_DIR": str(conf), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(JOB.format(root=ROOT))], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout.split("ROWS")[1]) > 0
