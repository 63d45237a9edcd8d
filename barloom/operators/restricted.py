"""Running the source of a registered indicator with few names and few modules.

The source may use expressions, assignments, functions, conditions and loops; names and attributes that
begin with an underscore, other statements, imports beyond ``ALLOWED`` and built-ins beyond ``BUILTINS``
are refused, at the latest when they are used. Modules are seen through a facade of their public functions,
classes and constants, so that what they import themselves isn't reached. It runs on the driver.
"""

from __future__ import annotations

import ast
import importlib
import types
from typing import Any

#: Modules that may be imported.
ALLOWED = ("math", "pyspark.sql", "pyspark.sql.functions", "barloom.functions", "barloom.functions.windows", "barloom.functions.stats", "barloom.operators.indicators", "barloom.operators.specs")
#: The built-in names that the source may use.
BUILTINS = (
    "None", "True", "False", "abs", "all", "any", "bool", "dict", "enumerate", "filter", "float", "frozenset", "int", "isinstance", "len", "list", "map", "max", "min", "print", "range",
    "reversed", "round", "set", "sorted", "str", "sum", "tuple", "zip", "ArithmeticError", "KeyError", "IndexError", "TypeError", "ValueError", "ZeroDivisionError",
)
#: What of the grammar may be used.
GRAMMAR = (
    ast.Module, ast.Expr, ast.expr, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Import, ast.ImportFrom, ast.alias,
    ast.FunctionDef, ast.arguments, ast.arg, ast.keyword, ast.Return, ast.If, ast.For, ast.While, ast.Break, ast.Continue, ast.Pass, ast.comprehension, ast.Raise,
)
REFUSED = (ast.Await, ast.Yield, ast.YieldFrom, ast.NamedExpr)


class Facade:
    """A module's public names: those it lists, else what it defines itself and plain constants; no modules among them."""

    __slots__ = ("_names", "_title")

    def __init__(self, module: types.ModuleType):
        listed = getattr(module, "__all__", None)
        own = lambda v: isinstance(v, int | float | str | tuple) or getattr(v, "__module__", module.__name__) == module.__name__
        inside = {n: getattr(module, n, None) for n in listed or vars(module) if not n.startswith("_")}
        self._title = module.__name__
        self._names = {n: v for n, v in inside.items() if not isinstance(v, types.ModuleType) and (listed or own(v))}

    def __getattr__(self, name: str) -> Any:
        if name in self._names:
            return self._names[name]
        if f"{self._title}.{name}" in ALLOWED:
            return Facade(importlib.import_module(f"{self._title}.{name}"))
        raise AttributeError(f"{self._title} has no public {name!r}")


def _import(name: str, globals_: Any = None, locals_: Any = None, wanted: tuple[str, ...] | None = (), level: int = 0) -> Facade:
    if level or not (name in ALLOWED or wanted and any(f"{name}.{w}" in ALLOWED for w in wanted)):
        raise ImportError(f"imports aren't allowed: {name}")
    if not wanted and "." in name:
        raise ImportError(f"import a name from it instead: from {name.rpartition('.')[0]} import {name.rpartition('.')[2]}")
    return Facade(importlib.import_module(name))


def check(source: str) -> ast.Module:
    """The syntax tree of ``source``; ValueError for whatever isn't allowed in it."""
    tree = ast.parse(source)
    for node in ast.walk(tree):
        if isinstance(node, REFUSED) or not isinstance(node, GRAMMAR):
            raise ValueError(f"not allowed: {type(node).__name__} in line {getattr(node, 'lineno', '?')}")
        names = [getattr(node, k) for k in ("id", "attr", "arg", "name", "asname") if isinstance(getattr(node, k, None), str)]
        if bad := [n for n in names if n.startswith("_") or n in ("eval", "exec", "open", "compile", "getattr", "setattr", "globals", "locals", "vars", "input", "breakpoint")]:
            raise ValueError(f"names aren't allowed: {', '.join(bad)} in line {getattr(node, 'lineno', '?')}")
        modules = [a.name for a in node.names] if isinstance(node, ast.Import) else []
        if isinstance(node, ast.ImportFrom):
            modules = [] if node.module in ALLOWED else [f"{'.' * node.level}{node.module or ''}.{a.name}" for a in node.names]
        if bad := [m for m in modules if m not in ALLOWED]:
            raise ValueError(f"imports aren't allowed: {', '.join(bad)}")
    return tree


def run(source: str, **given: Any) -> dict[str, Any]:
    """The names that ``source`` leaves; ``given`` are there from the start."""
    tree, builtins = check(source), importlib.import_module("builtins")
    space: dict[str, Any] = {"__name__": "registered", "__builtins__": {n: getattr(builtins, n) for n in BUILTINS} | {"__import__": _import}, **given}
    exec(compile(tree, "<indicator>", "exec"), space)
    return space
