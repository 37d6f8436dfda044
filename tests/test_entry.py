"""The entry point where the optional part has been taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
OPTIONAL = {"spanloom/llm", "tests/llm"}


def copy_without(at: Path, pipeline: bool) -> None:
    gone = OPTIONAL if pipeline else OPTIONAL | {"corpus_pipeline.py"}

    def skip(folder: str, names: list[str]) -> set[str]:
        inside = Path(folder).relative_to(ROOT)
        return {n for n in names if n in (".git", "__pycache__") or str(inside / n) in gone}

    shutil.copytree(ROOT, at, ignore=skip)


def test_queries_without_the_optional_part(tmp_path):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'tokenize' in q and 'tokenize' in o and not set(o) - set(q); print(sorted(n for n in q if n[:2] == 'op' and n[2:3].isdigit() or n == 'pipeline'))"
    for pipeline in (True, False):
        at = tmp_path / str(pipeline)
        copy_without(at, pipeline)
        got = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, timeout=120)
        assert got.returncode == 0, got.stderr
        assert got.stdout.strip() == "[]"


def test_errors_inside_the_optional_part_are_raised(tmp_path):
    at = tmp_path / "whole"
    copy_without(at, True)
    (at / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=at, capture_output=True, text=True, timeout=120)
    assert got.returncode != 0 and "no_such_module_at_all" in got.stderr
