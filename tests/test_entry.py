"""The registered queries and their SQL; the library without its training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert all(callable(q) for q in queries.values())


def test_the_rest_works_without_the_training_data_package(tmp_path):
    for name in ("terracell", "__spark_entry__.py"):
        source, target = ROOT / name, tmp_path / name
        if source.is_dir():
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, target)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'g1_geometric_features' in q and not any(k.startswith('op') for k in q), q; import terracell.cli, terracell.streaming.ingest"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.parametrize("missing", ["xxhash", "tokenizers", "tiktoken", "public_tokenizers"])
def test_the_rest_works_without_the_packages_of_the_training_data(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'g1_geometric_features' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True)


def test_nothing_imports_the_training_data_package():
    for f in (ROOT / "terracell").rglob("*.py"):
        if "llm" not in f.parts:
            assert "terracell.llm" not in f.read_text(), f
