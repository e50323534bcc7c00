import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from .conftest import ROOT

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

sys.path.insert(0, ROOT)
from ledgerloom.plans import queries as plans  # noqa: E402


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return db


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
        if v is None or v is pd.NaT or v is pd.NA:
            return "null"
        return str(v).replace(" 00:00:00", "")

    names = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_oracle(spark, oracle, name):
    a, b = plans.QUERIES[name](spark, TINY).toPandas(), oracle.sql(plans.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    """Their values are tested where their operators are; here they must have rows, and no column may be null throughout."""
    rows = plans.QUERIES[name](spark, TINY).toPandas()
    assert len(rows) and not [c for c in rows.columns if rows[c].isna().all() and not c.startswith(("auc_unseen", "senders", "ap_"))]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_folders(tmp_path):
    """In a copy without them, the rest of the library is imported and answers."""
    for name in ("__spark_entry__.py", "ledgerloom"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    code = """
import __spark_entry__ as e, sys
from pyspark.sql import SparkSession
names = set(e.queries())
assert "d03_flagship_alerts" in names and set(e.oracle_sql()) <= names
assert not any(n.startswith("op") or n == "pipeline" for n in names) and not any(m.startswith("ledgerloom.llm") for m in sys.modules)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0 and e.queries()["d04_h02_alert_rows"](spark, e.SMOKE_DIR).count() > 0
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, check=True, timeout=300)
