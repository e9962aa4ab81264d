"""Trajectories in whatever shape they come: JSON in text, lists, objects of thoughts and actions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys under which a trajectory, a role, a content, a tool's name may stand.
LISTS = ("messages", "trajectory", "history", "conversation", "turns", "steps", "events")
ROLES = ("role", "from", "speaker", "type")
CONTENTS = ("content", "text", "value", "message", "observation", "output")
NAMES = ("name", "tool", "tool_name", "function")
# Parts of a step, in order, and the role that says each.
STEP = (("thought", "assistant"), ("action", "assistant"), ("response", "assistant"), ("observation", "tool"))


def _text(value: object) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):  # parts of a content
        return "\n".join(filter(None, (_text(v.get("text", "")) if isinstance(v, dict) else _text(v) for v in value)))
    return "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _open(value: object) -> object:
    """The value of JSON in text, however often it was wrapped; any other value as it is."""
    while isinstance(value, str) and value.strip()[:1] in ("[", "{", '"'):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            break
    return value


def messages_of(value: object) -> list[dict]:
    """Messages (role, content, name as written) of a trajectory; a text that is none is one message."""
    node = _open(value)
    if isinstance(node, dict):
        held = next((node[k] for k in LISTS if isinstance(_open(node.get(k)), list)), None)
        node = _open(held) if held is not None else [node]
    if not isinstance(node, list):
        return [{"role": "user", "content": _text(node), "name": None}] if _text(node) else []
    out = []
    for step in map(_open, node):
        if not isinstance(step, dict):
            if _text(step):
                out.append({"role": "user", "content": _text(step), "name": None})
            continue
        name = next((step[k] for k in NAMES if isinstance(step.get(k), str)), None)
        role = next((step[k] for k in ROLES if isinstance(step.get(k), str)), None)
        if role is None and any(step.get(k) for k, _ in STEP):
            out += [{"role": r, "content": _text(step[k]), "name": name if r == "tool" else None} for k, r in STEP if step.get(k)]
            continue
        content = next((step[k] for k in CONTENTS if step.get(k) is not None), "")
        out.append({"role": role or "user", "content": _text(content), "name": name})
    return out


def loose_messages(trajectory: Column) -> Column:
    """The messages of a trajectory in text, roles as written (``adapters.normal_role`` makes them plain); null gives none."""

    @F.pandas_udf("array<struct<role:string,content:string,name:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: messages_of(t) if t is not None else [])

    return run(trajectory)
