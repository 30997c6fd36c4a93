"""The line reader of Python sources agrees with the syntax tree on whole sources, and keeps what is outside a broken statement."""

import ast
import glob
import os
import random

import pytest
from tidemark.operators import pysource

SOURCE = '''"""Doc with def not_me():
class Nor: this
"""
import os
LIMIT = 12
a = b = {"k": [1,
    2]}
typed: int = 3
bare: str
x.y = 1; z = 2
if LIMIT == 12:
    inner = f"def {LIMIT}"
    for k in range(3): each = k
else: other = 1

class Orchard(Base, metaclass=Meta):
    """Text
def fake(): pass
    """
    shade = 1

    @property
    def size(self):
        def nested(q): return q
        return nested

    class Row:
        def pick(self, a=(1,
                          2)):
            found = 1
            return a

    async def _wait(self):
        pass

@app.route("/x").TestCase
def handler(a): return "def no(): x"

@mark.slow
class Tested:
    def test_it(self): pass

def test_alone():
    # def comment():
    return """
class Inside:
"""
tail = lambda: 3
'''


def test_whole_sources_agree():
    tree, lines = list(pysource._of_tree(ast.parse(SOURCE))), pysource._of_lines(SOURCE)
    assert tree == lines
    by = {r[0]: r for r in tree}
    assert by["Orchard::nested"][1] == "Method" and by["Row"][1] == "Class" and by["Row::pick"][2:4] == (28, 31) and by["handler"][1] == "Test" and by["Orchard::_wait"][6] is False
    assert {n for n, r in by.items() if r[1] == "Const"} == {"LIMIT", "a", "b", "typed", "bare", "z", "inner", "each", "other", "tail"} and by["a"][2:5] == (6, 7, "a = …")


@pytest.mark.parametrize("path", sorted(glob.glob(os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tidemark", "*", "*.py")))[:12] + [os.__file__, random.__file__])
def test_real_sources_agree(path):
    with open(path) as file:
        source = file.read()
    assert pysource._of_lines(source) == list(pysource._of_tree(ast.parse(source)))


@pytest.mark.parametrize("broken", ["value = (1, 2", "return ][", "def (x:", "if x ==\n", "call(a, [b", "x = 'open", "1 +* 2", "class :"])
def test_symbols_outside_a_broken_statement_stay(broken):
    before = "LIMIT = 1\n\nclass Barn:\n    def open(self):\n        return 1\n\n"
    after = "    def close(self):\n        return 2\n\ndef alone():\n    pass\n"
    whole = pysource.rows(before + "    pass\n" * (1 + broken.count("\n")) + after)
    got = pysource.rows(before + f"    {broken}\n" + after)
    assert [r for r in got if r[0] in {w[0] for w in whole}] == whole and len(got) - len(whole) <= 1


def test_nothing_and_nonsense():
    assert pysource.rows("") == [] and pysource.rows("def (") == [] and pysource.rows("\0\0") == []
    assert [r[:4] for r in pysource.rows("def broken(\nasync def fetch():\n")] == [("broken", "Function", 1, 1), ("fetch", "Function", 2, 2)]
