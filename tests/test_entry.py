import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left_out", [["catchment/llm", "tests/llm"], ["catchment/llm", "corpus_pipeline.py"],
                                      ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, left_out):
    home = tmp_path / "repo"
    gone = {os.path.join(ROOT, x) for x in left_out}
    shutil.copytree(ROOT, home, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in gone])
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql();"
            "print(len([n for n in q if n[:2] != 'op']), len([n for n in q if n[:2] == 'op']), 'pipeline' in q, set(o) <= set(q))")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=home, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    table, corpus, pipeline, known = out.stdout.split()
    assert int(table) > 150 and pipeline == "False" and known == "True"
    assert (int(corpus) == 0) == ("catchment/llm" in left_out)
