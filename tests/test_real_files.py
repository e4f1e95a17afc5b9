"""The nesting tree against Python's own parser, on the files of an installed package."""

import ast
import bisect
import glob
import os

import pyspark

from saltmarsh.operators import lexer


def test_every_definition_is_a_statement():
    files = sorted(glob.glob(f"{os.path.dirname(pyspark.__file__)}/sql/*.py"))[:20]
    assert files
    for f in files:
        with open(f, encoding="utf-8") as x:
            content = x.read()
        starts = [0] + [k + 1 for k, c in enumerate(content) if c == "\n"]
        line = lambda at: bisect.bisect_right(starts, at)  # noqa: B023, E731
        mine = {(line(r[5]), line(r[6] - 1)) for r in lexer.Reader(content, "python", words=False).rows()[0]}
        for node in ast.walk(ast.parse(content)):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                assert (min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno) in mine, (f, node.name)
