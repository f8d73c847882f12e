"""The entry file works without the corpus folder, whether or not the pipeline file stays."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names(root: Path) -> set[str]:
    code = "import __spark_entry__ as entry; print('NAMES', *entry.queries()); assert set(entry.oracle_sql()) <= set(entry.queries())"
    clean = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=root, env=clean, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split("NAMES", 1)[1].split())


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_corpus_folder(tmp_path, pipeline):
    shutil.copytree(ROOT / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    bare, here = names(tmp_path), names(ROOT)
    assert "cmp_01_retrieve_evidence" in bare
    assert bare <= here and all(name == "pipeline" or name.startswith("op") for name in here - bare)
