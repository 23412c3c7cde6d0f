"""The entry point with and without the training-data subpackage, and SQL counterparts on the driver tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from strandworks.plans import registry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.01")
QUICK = ["f2_low_count_filter", "a5_lm_fit", "robust_genes", "a8_bh_fdr", "e1_ora", "e2_gsea_es", "n2_components", "m5_auc", "s1_km", "s3_logrank", "s5_cindex", "s7_time_auc", "s11_calibration", "s12_net_benefit", "t1_paired_wilcoxon", "q7_fold_change", "p2_melting_temp", "j4_in_silico_pcr", "c3_contacts"]


def test_entry_without_the_subpackage(tmp_path):
    (tmp_path / "strandworks").mkdir()
    for p in (ROOT / "strandworks").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "strandworks" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    n, ours, fits = out.stdout.split()
    assert int(n) > 80 and ours == "0" and fits == "True", out.stderr


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, str(DATA))
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    place = [columns.index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in place) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
