"""The driver's contract, with and without the training-data subpackage."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k.startswith("op") or k == "pipeline" for k in e.queries()))
"""


def test_without_the_subpackage():
    got = subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) >= 45 and int(got[1]) >= 35 and got[2] == "False"


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and "kupiec_passed" in got.columns
