import os
import subprocess
import sys

import __spark_entry__ as entry
from topiclake.llm import queries

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_operator_is_registered():
    names = list(queries.Q)
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(queries.SQL) <= set(names) and set(names) <= set(entry.queries())


def test_the_rest_does_without(tmp_path):
    """A copy without the package and the pipeline still imports."""
    for folder in ("topiclake", "workload"):
        for here, _, files in os.walk(os.path.join(ROOT, folder)):
            if "llm" in here.split(os.sep) or "__pycache__" in here:
                continue
            to = os.path.join(tmp_path, os.path.relpath(here, ROOT))
            os.makedirs(to, exist_ok=True)
            for f in files:
                with open(os.path.join(here, f)) as a, open(os.path.join(to, f), "w") as b:
                    b.write(a.read())
    with open(os.path.join(ROOT, "__spark_entry__.py")) as a, open(tmp_path / "__spark_entry__.py", "w") as b:
        b.write(a.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
