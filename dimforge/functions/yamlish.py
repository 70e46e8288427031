"""Is a text a YAML mapping, and what does it hold? Uses the YAML library where there is one."""

from __future__ import annotations

import json
import re

try:
    import yaml

    _LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
except ImportError:  # the plain subset below is read instead
    yaml = None

_KEY = re.compile(r"""^(?P<indent> *)(?P<key>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|:?[^\s"'\[\]{},#&*!|>%@`:-][^:#]*?|:[^\s:]+)\s*:(?:\s+(?P<value>.*))?$""")


def mapping(text: str) -> dict | None:
    """The mapping that `text`, a JSON object or one YAML document, holds; None if it isn't one."""
    if text.lstrip()[:1] == "{":
        try:
            got = json.loads(text)
            return got if isinstance(got, dict) else None
        except (ValueError, RecursionError):
            pass
    if yaml is None:
        return _subset(text)
    try:
        try:
            got = yaml.load(text, _LOADER)
        except (yaml.constructor.ConstructorError, ValueError, TypeError):  # a mapping, perhaps, whose values have no Python form
            if not isinstance(yaml.compose(text, _LOADER), yaml.MappingNode):
                return None
            got = yaml.load(text, yaml.BaseLoader)
        return {str(k): v for k, v in got.items()} if isinstance(got, dict) else None
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None


def is_mapping(text: str) -> bool:
    """Whether :func:`mapping` gives anything, without making the values where that can be told from the structure."""
    if yaml is None or text.lstrip()[:1] == "{":
        return mapping(text) is not None
    try:
        node = yaml.compose(text, _LOADER)
    except (yaml.YAMLError, ValueError, RecursionError):
        return False
    return isinstance(node, yaml.MappingNode) and (_usual(node, 8) or mapping(text) is not None)


def _usual(node, depth: int) -> bool:
    """Nothing below `node` but text keys, scalars and lists: what always can be made."""
    if isinstance(node, yaml.ScalarNode):
        return True
    if not depth:
        return False
    if isinstance(node, yaml.SequenceNode):
        return all(_usual(x, depth - 1) for x in node.value)
    return all(k.tag == "tag:yaml.org,2002:str" and _usual(v, depth - 1) for k, v in node.value)


def _scalar(v: str):
    if v.startswith(("{", "[")):
        return json.loads(v)
    if v.startswith(('"', "'")):
        if len(v) < 2 or v[-1] != v[0]:
            raise ValueError(v)
        return json.loads(v) if v[0] == '"' else v[1:-1].replace("''", "'")
    if ": " in v or v.endswith(":"):
        raise ValueError(v)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(v, int(v) if re.fullmatch(r"[+-]?\d+", v) else v)


def _subset(text: str) -> dict | None:
    """Block mappings of scalars, nested by indentation; one document, no tabs, no anchors."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    lines = [x.rstrip() for x in text.split("\n")]
    if lines and lines[0] == "---":
        lines = lines[1:]
    pending: tuple[dict, str] | None = None
    for line in lines:
        if not line or line.lstrip().startswith("#"):
            continue
        m = _KEY.match(line)
        if not m:
            return None
        depth = len(m["indent"])
        while stack and depth < stack[-1][0]:
            stack.pop()
        if pending and depth > stack[-1][0] >= 0:
            child: dict = {}
            pending[0][pending[1]] = child
            stack.append((depth, child))
        elif stack[-1][0] == -1:
            stack.append((depth, root))
        elif depth != stack[-1][0]:
            return None
        key, value = m["key"].strip("\"'"), (m["value"] or "").strip()
        try:
            stack[-1][1][key] = _scalar(value)
        except ValueError:
            return None
        pending = (stack[-1][1], key) if not value else None
    return root or None
