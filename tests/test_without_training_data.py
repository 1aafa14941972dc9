"""The engine stands where the training-data part is deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("keeps", [[], ["corpus_pipeline.py"]])
def test_registry_without_training_data(tmp_path, keeps):
    shutil.copytree(ROOT / "tallyforge", tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *(k for k in keeps if (ROOT / k).exists())):
        shutil.copy(ROOT / name, tmp_path / name)
    code = "import bench, __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 150; assert not any(k == 'pipeline' or k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
