"""Boards from outside: modules of a folder, each of which names one board and how its entries are asked.

A module whose name doesn't begin with an underscore defines ``BOARD`` (a ``boards.Board``) and ``SEED`` (a value as in
``jobboard.SEEDS``, or a function of the entry that gives its URL or None). What is malformed is reported, and the others load.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from . import jobboard
from .boards import BOARDS, FIELDS, Board


class PluginError(TypeError):
    """A module that doesn't keep the contract."""


@dataclass(frozen=True)
class Plugins:
    boards: tuple[Board, ...] = BOARDS
    seeds: dict[str, tuple | Callable[[dict], str | None]] = field(default_factory=lambda: dict(jobboard.SEEDS))
    errors: dict[str, str] = field(default_factory=dict)

    def names(self) -> tuple[str, ...]:
        return tuple(sorted(self.seeds))

    def seed(self, board: str, entry: dict) -> str | None:
        how = self.seeds[board]
        return how(entry) if callable(how) else jobboard.seed(board, entry, self.seeds)

    def board_of(self, entry: dict) -> str | None:
        return jobboard.board_of(entry, self.boards, self.seeds)


def files(folder: str) -> list[Path]:
    """The folder's modules, by name."""
    return sorted(p for p in Path(folder).glob("*.py") if p.is_file() and not p.name.startswith("_")) if Path(folder).is_dir() else []


def load(path: Path) -> tuple[Board, tuple | Callable]:
    spec = importlib.util.spec_from_file_location(f"board_{path.stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    board, seed = getattr(module, "BOARD", None), getattr(module, "SEED", None)
    if not isinstance(board, Board) or not board.name:
        raise PluginError("BOARD has to be a Board with a name")
    if set(board.fields) != set(FIELDS) or board.match not in ("exact", "ending", "suffix"):
        raise PluginError(f"BOARD needs a rule for each of {', '.join(FIELDS)}, and a way to match hosts")
    if not (callable(seed) or isinstance(seed, tuple) and seed and seed[0] in ("fixed", "endpoint", "path", "company", "entry")):
        raise PluginError("SEED has to be a function or one of the known kinds")
    return board, seed


def discover(folder: str | None, builtin: bool = True) -> Plugins:
    """The built-in boards and those of the folder, which replace built-in ones of their name."""
    known = {b.name: b for b in BOARDS} if builtin else {}
    seeds: dict = dict(jobboard.SEEDS) if builtin else {}
    errors = {}
    for path in files(folder) if folder else []:
        try:
            board, seed = load(path)
        except Exception as error:  # noqa: BLE001  one module's fault is told, and leaves the others
            errors[path.name] = f"{type(error).__name__}: {error}"
        else:
            known[board.name], seeds[board.name] = board, seed
    return Plugins(tuple(known[n] for n in sorted(known)), seeds, errors)
