"""JSON, YAML and TOML as trees of objects, fields, arrays and values with RFC 6901 pointers."""

from __future__ import annotations

import datetime
import json
import math
import re
import tomllib
from decimal import Decimal

import yaml

from arbora.model import Limits

from .tree import Artifact, Budget, Node, Source, document


class Literal(str):
    """A number as it was written."""


def escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _scalar(value: object) -> tuple[str, str]:
    if value is None:
        return "null", "null"
    if isinstance(value, bool):
        return str(value).lower(), "boolean"
    if isinstance(value, Literal):
        return str(value), "number"
    return str(value), "string"


def tree(value: object, budget: Budget, pointer: str = "", name: str = "root", depth: int = 1) -> Node:
    """A value's node; keys in code point order, each a field around its value."""
    budget.depth(depth)
    budget.node()
    locator = {"path": pointer}
    if isinstance(value, dict):
        node = Node("object", name, locator=locator)
        for key in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass")):
            child = tree(value[key], budget, f"{pointer}/{escape(key)}", key, depth + 1)
            node.children.append(Node("field", key, locator=child.locator, children=[child]))
        return node
    if isinstance(value, list):
        return Node("array", name, locator=locator, children=[tree(x, budget, f"{pointer}/{i}", str(i), depth + 1) for i, x in enumerate(value)])
    text, kind = _scalar(value)
    return Node("value", name, text, locator=locator, attributes={"type": kind})


def _reject(name: str) -> None:
    raise ValueError(f"parse JSON: invalid literal {name}")


def read_json(source: Source, limits: Limits) -> Artifact:
    text = source.data.decode("utf-8", "replace")
    try:
        value = json.loads(text, parse_int=Literal, parse_float=Literal, parse_constant=_reject, strict=True)
    except json.JSONDecodeError as e:
        raise ValueError(f"parse JSON: {e}") from None
    root = document(source, tree(value, Budget(limits)))
    return Artifact(source, "json", "application/json", root)


def go_float(x: float) -> str:
    """A double as JSON text: shortest digits, an exponent only below 1e-6 or from 1e21 on, no trailing ``.0``."""
    if math.isinf(x) or math.isnan(x):
        raise ValueError("normalize TOML: unsupported value")
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-6 <= abs(x) < 1e21:
        out = format(Decimal(repr(x)), "f")
        return out.rstrip("0").rstrip(".") if "." in out else out
    digits, _, power = f"{Decimal(repr(x)).normalize():e}".partition("e")
    return f"{digits}e{power[0]}{power[1:].lstrip('0')}"


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return Literal(value)
    if isinstance(value, float):
        return Literal(go_float(value))
    if isinstance(value, datetime.datetime | datetime.time):
        text = value.isoformat()
        head, dot, rest = text.partition(".")
        if dot:
            tail = re.sub(r"^[0-9]+", "", rest)
            text = f"{head}.{rest[: len(rest) - len(tail)].rstrip('0')}{tail}"
        return text.replace("+00:00", "Z")
    return value.isoformat() if isinstance(value, datetime.date) else value


def read_toml(source: Source, limits: Limits) -> Artifact:
    try:
        value = tomllib.loads(source.data.decode("utf-8"))
    except ValueError as e:
        raise ValueError(f"parse TOML: {e}") from None
    return Artifact(source, "toml", "application/toml", document(source, tree(_plain(value), Budget(limits))), {"encoding": "utf-8"})


_NULL = {"", "~", "null", "Null", "NULL"}
_BOOL = {"true", "True", "TRUE", "false", "False", "FALSE"}
_NUMBER = re.compile(r"[-+]?(?:0x[0-9a-fA-F_]+|0o?[0-7_]+|0b[01_]+|[0-9][0-9_]*|(?:\.[0-9]+|[0-9][0-9_]*(?:\.[0-9_]*)?)(?:[eE][-+]?[0-9]+)?|\.(?:inf|Inf|INF))|\.(?:nan|NaN|NAN)")
_TIME = re.compile(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::?[0-9]{2})?))?)?")


class _Core:
    """YAML 1.2 core types and timestamps; ``yes`` and ``on`` are strings."""

    def resolve(self, kind, value, implicit):
        if kind is not yaml.ScalarNode:
            return super().resolve(kind, value, implicit)
        tag = "str"
        if implicit[0]:
            if value in _NULL:
                tag = "null"
            elif value in _BOOL:
                tag = "bool"
            elif _NUMBER.fullmatch(value):
                tag = "int"
            elif _TIME.fullmatch(value):
                tag = "timestamp"
        return f"tag:yaml.org,2002:{tag}"


class _Loader(_Core, yaml.SafeLoader):
    pass


class _Unsure(Exception):
    """What libyaml and the Python loader may place differently."""


if yaml.__with_libyaml__:

    class _Fast(_Core, yaml.CSafeLoader):
        def resolve(self, kind, value, implicit):
            if kind is yaml.ScalarNode and value == "" and implicit[0]:
                raise _Unsure
            return super().resolve(kind, value, implicit)

else:
    _Fast = None

#: Characters of which, and signs without which, a text has the same nodes at the same marks for both loaders, if no plain scalar is empty.
_ALIKE = re.compile(r"[\n -~]*")
_TELLING = re.compile(r"[%&*!?|>\\]|---|\.\.\.")
#: Levels that a text read by libyaml can have at most; it composes on the C stack.
_LEVELS = 1024


def _composed(text: str) -> list[yaml.Node]:
    """A stream's documents: by libyaml where that can't make a difference, else, and for all errors, by the Python loader."""
    if _Fast and _ALIKE.fullmatch(text) and not _TELLING.search(text) and text.count("[") + text.count("{") + max(map(len, text.split("\n"))) <= _LEVELS:
        try:
            return list(yaml.compose_all(text, _Fast))
        except (yaml.YAMLError, _Unsure):
            pass
    return list(yaml.compose_all(text, _Loader))


_TYPES = {"null": "null", "bool": "boolean", "int": "number", "float": "number", "timestamp": "timestamp"}


class _Yaml:
    def __init__(self, limits: Limits) -> None:
        self.budget = Budget(limits)
        self.seen: set[int] = set()

    def node(self, value: yaml.Node, pointer: str, name: str, depth: int, above: tuple[int, ...] = ()) -> Node:
        if id(value) in above:
            raise ValueError("parse YAML: cyclic or invalid alias")
        if id(value) in self.seen:  # reached again, so through an alias, which is a level of its own
            self.budget.depth(depth)
            self.budget.node()
            depth += 1
        self.seen.add(id(value))
        self.budget.depth(depth)
        self.budget.node()
        above += (id(value),)
        locator = {"path": pointer}
        where = self._place(value)
        if isinstance(value, yaml.MappingNode):
            node = Node("object", name, locator=locator, attributes=where)
            keys = set()
            for key, item in value.value:
                if not isinstance(key, yaml.ScalarNode):
                    raise ValueError("parse YAML: mapping keys must be scalars")
                if key.value in keys:
                    raise ValueError(f'parse YAML: duplicate key "{key.value}"')
                keys.add(key.value)
                child = self.node(item, f"{pointer}/{escape(key.value)}", key.value, depth + 1, above)
                node.children.append(Node("field", key.value, locator=child.locator, attributes=self._place(key), children=[child]))
            return node
        if isinstance(value, yaml.SequenceNode):
            return Node("array", name, locator=locator, attributes=where, children=[self.node(x, f"{pointer}/{i}", str(i), depth + 1, above) for i, x in enumerate(value.value)])
        kind = _TYPES.get(value.tag.rsplit(":", 1)[-1], "string") if value.tag.startswith("tag:yaml.org,2002:") else "string"
        return Node("value", name, "null" if kind == "null" else value.value, locator=locator, attributes=where | {"type": kind})

    @staticmethod
    def _place(value: yaml.Node) -> dict[str, str]:
        return {"line": str(value.start_mark.line + 1), "column": str(value.start_mark.column + 1)}


def read_yaml(source: Source, limits: Limits) -> Artifact:
    try:
        documents = _composed(source.data.decode("utf-8"))
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise ValueError(f"parse YAML: {e}") from None
    build = _Yaml(limits)
    if not documents:
        child = Node("value", "root", "null", attributes={"type": "null"})
    elif len(documents) == 1:
        child = build.node(documents[0], "", "root", 1)
    else:
        child = Node("array", "documents")
        for i, d in enumerate(documents):
            build.seen.clear()
            child.children.append(build.node(d, f"/{i}", str(i), 1))
    return Artifact(source, "yaml", "application/yaml", document(source, child), {"encoding": "utf-8", "documents": str(len(documents))})


def read_config(source: Source, limits: Limits) -> Artifact:
    if source.extension in (".yaml", ".yml"):
        return read_yaml(source, limits)
    if source.extension == ".toml":
        return read_toml(source, limits)
    raise ValueError(f'parse config: unsupported extension "{source.extension}"')
