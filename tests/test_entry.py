"""What the entry registers when a part of the library, or a package that only that part needs, is missing."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(len([q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]), len(entry.queries()) > 60)
"""


def run(name):
    return subprocess.run(
        [sys.executable, "-c", SCRIPT.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120
    )


@pytest.mark.parametrize("name", ["edgelog.llm", "corpus_pipeline", "public_tokenizers"])
def test_the_operators_are_left_out(name):
    assert run(name).stdout.split() == ["0", "True"]


def test_a_missing_part_of_the_library_is_an_error():
    assert run("edgelog.operators.triples").returncode != 0
