import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(root, *gone):
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for x in gone:
        path = os.path.join(root, x)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(root)})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_queries_without_the_training_data_operators(tmp_path):
    folders = (os.path.join("tessella", "llm"), os.path.join("tests", "llm"))
    some = _names(tmp_path / "a", *folders)
    assert some == _names(tmp_path / "b", *folders, "corpus_pipeline.py") and int(some[0]) > 50 and some[2] == "False"
