"""The driver's entry points: names, SQL, and that the rest works where the text operators are gone."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(entry.__file__).parent


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(isinstance(s, str) for s in sql.values())
    assert len(queries) - len(sql) <= 10


def test_without_text_operators(tmp_path):
    for name in ("pagemint", "__spark_entry__.py"):
        source, to = HERE / name, tmp_path / name
        if source.is_file():
            to.write_text(source.read_text())
            continue
        for f in source.rglob("*.py"):
            if "llm" not in f.relative_to(source).parts:
                (to / f.relative_to(source)).parent.mkdir(parents=True, exist_ok=True)
                (to / f.relative_to(source)).write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'headline' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
