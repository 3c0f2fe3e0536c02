"""The entry point without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _copied(tmp_path, *left_out):
    shutil.copytree(ROOT / "bankrec", tmp_path / "bankrec", ignore=shutil.ignore_patterns("__pycache__", "llm" if "llm" in left_out else "-"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = ("import __spark_entry__ as e, re; "
            "print([q for q in e.queries() if re.match('op[0-9]|pipeline', q)], len(e.oracle_sql()) > 40)")
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})


def test_without_text_operators(tmp_path):
    for k, left_out in enumerate((("llm",), ("llm", "corpus_pipeline.py"))):
        done = _copied(tmp_path / str(k), *left_out)
        assert done.returncode == 0 and done.stdout.startswith("[] True"), done.stderr
