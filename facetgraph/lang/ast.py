"""Nodes of the syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Ref:
    """A reference literal, @id."""

    id: str


@dataclass(frozen=True)
class Bind:
    name: str


@dataclass(frozen=True)
class Prop:
    """A property, or a path of properties, of a label (None: of the object at hand). No path: the object itself."""

    path: tuple[str, ...]
    label: str | None = None


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    named: tuple = ()


@dataclass(frozen=True)
class Op:
    """name: = != < <= > >= in and or not maybe"""

    name: str
    args: tuple


@dataclass(frozen=True)
class FilterSet:
    label: str | None
    where: Any


@dataclass(frozen=True)
class Item:
    """An output: key (a text, or an expression), value, and its flags."""

    key: Any
    value: Any
    maybe: bool = False
    omit_null: bool = False
    force_list: bool = False


@dataclass
class Construct:
    kind: str  # dict, list, value
    label: str | None
    items: list
    where: Any = None
    group: Any = None
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int | None = None
    depth: int = 0
    merge_all: bool = False
    name_map: dict | None = None
