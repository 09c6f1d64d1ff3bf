"""Domain checks that a contract declares: ``module:NAME`` or ``file.py:NAME``.

A pack is a list of (name, check); a check takes the batch and returns findings, like the built-in ones.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable, Iterable
from pathlib import Path

from lorekeep.operators.checks import CORE_CHECKS


class PackError(ValueError):
    pass


def load_pack(spec: str, base_dir: str = ".") -> list[tuple[str, Callable]]:
    module_name, _, attribute = spec.rpartition(":")
    if not module_name or not attribute:
        raise PackError(f"'{spec}' names no attribute; use module:NAME or file.py:NAME")
    try:
        if module_name.endswith(".py"):
            path = Path(base_dir) / module_name
            if not path.is_file():
                raise PackError(f"'{spec}': there is no file {path}")
            made = importlib.util.spec_from_file_location(f"_pack_{path.stem}", path)
            module = importlib.util.module_from_spec(made)
            made.loader.exec_module(module)
        else:
            module = importlib.import_module(module_name)
    except PackError:
        raise
    except Exception as problem:
        raise PackError(f"'{spec}' can't be imported: {problem}") from problem
    pack = getattr(module, attribute, None)
    if not isinstance(pack, list | tuple):
        raise PackError(f"'{spec}' is no list of (name, check)")
    for entry in pack:
        if not isinstance(entry, list | tuple) or len(entry) != 2 or not isinstance(entry[0], str) or not entry[0]:
            raise PackError(f"'{spec}' holds {entry!r}, which is no (name, check)")
        if not callable(entry[1]):
            raise PackError(f"'{spec}': check '{entry[0]}' can't be called")
    return [tuple(x) for x in pack]


def load_packs(specs: Iterable[str], base_dir: str = ".") -> list[tuple[str, Callable]]:
    """All packs in order; a name that a built-in or an earlier check has is refused."""
    found: list[tuple[str, Callable]] = []
    for spec in specs:
        for name, check in load_pack(spec, base_dir):
            if name in CORE_CHECKS:
                raise PackError(f"'{spec}': '{name}' would shadow a core check")
            if name in [n for n, _ in found]:
                raise PackError(f"'{spec}': there is already a check '{name}'")
            found.append((name, check))
    return found
