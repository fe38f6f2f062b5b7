"""Python sources, by the standard library's parser."""

from __future__ import annotations

import ast
import re

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Lines of a file that are passed over, at most, until the rest parses.
PASSED_OVER = 200


def tolerant(code: str) -> ast.Module:
    """The tree of code; of code with syntax errors that of what is left when the lines they are found on say nothing."""
    lines, error = code.split("\n"), None
    for _ in range(PASSED_OVER):
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            error = error or e
            if opener := re.search(r"expected an indented block after .* on line (\d+)", e.msg or ""):
                lines[int(opener[1]) - 1] += " pass"
                continue
            at = min((e.lineno or 0), len(lines)) - 1
            line = lines[at] if at >= 0 else ""
            indent = line[: len(line) - len(line.lstrip())]
            # a block's first line keeps a block open, so that what it holds still parses
            quiet = indent + ("if True:" if line.rstrip().endswith(":") and line.strip() != "if True:" else "pass")
            if at < 0 or line == quiet:
                if at < 0 or line.strip() == "":
                    break
                quiet = ""  # even that doesn't fit here
            lines[at] = quiet
    raise error


def callees(node: ast.AST) -> list[str]:
    """Names called in a node, outer calls before those within them, repeated ones kept."""
    out = []
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.Call):
            name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", None)
            out += [name] if name else []
        out += callees(child)
    return out


def method(node: ast.FunctionDef, lines: list[str]) -> dict:
    a = node.args
    named = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
    return {
        "name": node.name,
        "return_type": ast.unparse(node.returns) if node.returns else "",
        "parameters": [x.arg for x in named],
        "body": "\n".join(lines[node.body[0].lineno - 1 : node.end_lineno]),
        "start_line": node.lineno,
        "end_line": node.end_lineno,
        "callees": callees(ast.Module(node.body, [])),
    }


def parse(code: str) -> dict:
    """The first class with its assigned names and methods; without a class, the top-level functions. Lines with syntax errors are passed over."""
    tree, lines = tolerant(code), code.split("\n")
    first = next((n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)), None)
    body = first.body if first else tree.body
    properties = []
    for n in body if first else ():
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
        properties += [t.id for t in targets if isinstance(t, ast.Name)]
    return {"package_name": "", "class_name": first.name if first else "", "properties": properties, "methods": [method(n, lines) for n in body if isinstance(n, FUNCTIONS)]}
