"""The engine works without the training-data operators, and nothing in it imports them."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_nothing_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "tablemill")):
        if os.path.basename(folder) != "llm" and "llm" not in os.path.relpath(folder, ROOT).split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"(from|import)[^\n]*\bllm\b", open(os.path.join(folder, f)).read()), f


def test_entry_without_it(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tablemill"), tmp_path / "tablemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=path_with(tmp_path), capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) > 60 and out[-1] == "False"


def path_with(folder) -> dict[str, str]:
    """The environment, with the folder before what it has."""
    return os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (str(folder), os.environ.get("PYTHONPATH", "")) if x)}


def test_other_tests_without_it(tmp_path):
    for folder in ("tablemill", "tests"):
        shutil.copytree(os.path.join(ROOT, folder), tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    everything = ["--ignore", "tests/test_isolation.py"] if os.environ.get("TEST_WHOLE_COPY") else ["-k", "half_even or html_never_fails or question_files or aliases or scan"]
    out = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", *everything], cwd=tmp_path, env=path_with(tmp_path), capture_output=True, text=True)
    assert out.returncode == 0 and "error" not in out.stdout.lower(), out.stdout


def test_missing_library_is_an_error(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tablemill"), tmp_path / "tablemill", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=path_with(tmp_path), capture_output=True, text=True)
    assert out.returncode and "xxhash" in out.stderr
