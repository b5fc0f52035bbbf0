"""The entry points without the optional corpus folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


CODE = """
import __spark_entry__ as e
found = e.queries()
assert e.__file__.startswith({folder!r})
assert len(found) > 100 and set(e.oracle_sql()) <= set(found)
assert not [name for name in found if name == "pipeline" or name[:2] == "op"]
"""


@pytest.mark.parametrize("left", [["__spark_entry__.py"], ["__spark_entry__.py", "corpus_pipeline.py"]])
def test_entry_without_the_corpus_folders(tmp_path, left):
    for name in left:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "abundix", tmp_path / "abundix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    paths = [p for p in sys.path if p and Path(p).resolve() not in (ROOT, ROOT / "tests")]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(paths)}
    said = subprocess.run([sys.executable, "-c", CODE.format(folder=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
