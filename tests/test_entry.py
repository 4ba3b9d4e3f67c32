import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_the_optional_parts(tmp_path):
    """The entry module and the library work where the optional subpackage and the pipeline are not there."""
    shutil.copytree(ROOT / "sketchmill", tmp_path / "sketchmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_library_does_not_import_the_optional_parts():
    for path in (ROOT / "sketchmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
