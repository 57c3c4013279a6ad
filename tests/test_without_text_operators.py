"""The library stands without its text operators."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_else_names_them():
    for path in (ROOT / "voxmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_entry_without_them(tmp_path):
    for name in ("__spark_entry__.py", "voxmill"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "voxmill").mkdir()
    for part in (ROOT / "voxmill").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "voxmill" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mesh_validity' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
