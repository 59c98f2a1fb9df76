"""Every name that a function of the package reads from its module exists there."""

import builtins
import dis
import importlib
import pkgutil
import types
from pathlib import Path

import daygrid
import pytest

MODULES = [m.name for m in pkgutil.walk_packages(daygrid.__path__, "daygrid.")]


def _code(code):
    yield code
    for inner in code.co_consts:
        if isinstance(inner, types.CodeType):
            yield from _code(inner)


@pytest.mark.parametrize("name", MODULES)
def test_global_names_are_defined(name):
    module = importlib.import_module(name)
    source = Path(module.__file__).read_text()
    read = {(c.co_name, i.argval) for c in _code(compile(source, module.__file__, "exec"))
            for i in dis.get_instructions(c) if i.opname == "LOAD_GLOBAL"}
    assert [r for r in sorted(read) if not hasattr(module, r[1]) and not hasattr(builtins, r[1])] == []
