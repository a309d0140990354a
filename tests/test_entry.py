"""The entry module without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_llm(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "latticeloom", tmp_path / "latticeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(o) <= set(q); " \
           "assert not any(n == 'pipeline' or n.startswith('op') for n in q); assert 'G3_length_scale' in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
