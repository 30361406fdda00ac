"""JSON_EXTRACT and JSON_UNQUOTE.

One path without wildcards is read by the engine's own JSON functions; several paths and wildcards need a walk over
the document, done in batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Value, text

LEG = re.compile(r'\s*(?:(\*\*)|\.\s*(\*|"(?:[^"\\]|\\.)*"|[A-Za-z_$][\w$]*)|\[\s*(\*|\d+)\s*\])')


def legs(path: str) -> list[tuple[str, object]]:
    """(kind, name or index) of a path's steps: member, cell, and their wildcards and '**'."""
    path = path.strip()
    if not path.startswith("$"):
        raise ValueError(f"not a JSON path: {path}")
    out, at = [], 1
    while path[at:].strip():
        m = LEG.match(path, at)
        if not m:
            raise ValueError(f"not a JSON path: {path}")
        deep, member, cell = m.groups()
        if deep:
            out.append(("**", None))
        elif member is not None:
            out.append(("*", "member") if member == "*" else ("member", json.loads(member) if member[0] == '"' else member))
        else:
            out.append(("*", "cell") if cell == "*" else ("cell", int(cell)))
        at = m.end()
    if out and out[-1][0] == "**":
        raise ValueError(f"a path may not end in **: {path}")
    return out


def walk(value, steps: list[tuple[str, object]]) -> list:
    """What a path finds, in the document's order, each place once."""
    found = [value]
    for kind, name in steps:
        after = []
        for v in found:
            if kind == "member":
                after += [v[name]] if isinstance(v, dict) and name in v else []
            elif kind == "cell":
                if isinstance(v, list):
                    after += [v[name]] if name < len(v) else []
                elif name == 0:
                    after.append(v)
            elif kind == "*":
                after += list(v.values()) if name == "member" and isinstance(v, dict) else list(v) if name == "cell" and isinstance(v, list) else []
            else:
                todo = [v]
                while todo:
                    x = todo.pop(0)
                    after.append(x)
                    todo = (list(x.values()) if isinstance(x, dict) else list(x) if isinstance(x, list) else []) + todo
        found, seen = [], set()
        for v in after:
            if not isinstance(v, (dict, list)) or id(v) not in seen:
                seen.add(id(v))
                found.append(v)
    return found


def _many(paths: list[str]) -> bool:
    """Whether what is found comes as an array."""
    return len(paths) > 1 or any(kind in ("*", "**") for p in paths for kind, _ in legs(p))


def plain(paths: list[str]) -> bool:
    """Whether an expression of built-in functions can follow the paths."""
    return not _many(paths) and all(kind == "member" and re.fullmatch(r"\w+", name) for kind, name in legs(paths[0]))


def extractor(paths: list[str]):
    """A function of JSON texts, in batches, that walks paths which no expression can."""
    steps, many = [legs(p) for p in paths], _many(paths)

    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        def one(raw):
            try:
                value = json.loads(raw) if raw is not None else None
            except ValueError:
                return None
            found = [v for p in steps for v in walk(value, p)] if raw is not None else []
            return json.dumps(found if many else found[0], ensure_ascii=False, separators=(", ", ": ")) if found else None

        return s.map(one)

    return extract


def json_extract(doc: Value, *paths: str) -> Column:
    """JSON text of what the paths find; an array for several paths or wildcards; NULL for nothing."""
    if plain(paths):
        return F.to_json(F.variant_get(F.try_parse_json(text(doc)), paths[0].replace(" ", ""), "variant"))
    return extractor(list(paths))(text(doc))


def json_unquote(value: Value) -> Column:
    """The text of a JSON string; anything else as it is."""
    v = text(value)
    inner = F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>")
    return F.when(v.rlike(r'(?s)^".*"$'), F.coalesce(F.get(inner, F.lit(0)), v)).otherwise(v)


def json_value(doc: Value, path: str) -> Column:
    """doc->>path"""
    return json_unquote(json_extract(doc, path))
