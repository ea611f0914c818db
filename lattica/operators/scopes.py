"""Fixes to whole program texts that need to know which block a word stands in.

Each is a function of one text, and apply() runs it over a column in Arrow batches. Strings and comments are never changed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lattica.tables import ready

_PARTS = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|`[^`]*`|/\*.*?\*/|//[^\n]*|[A-Za-z_]\w*|\d[\w.]*|\s+|[-+*/%&|^<>=!]+|.', re.S)
_NAME = re.compile(r"[A-Za-z_]\w*")
#: A comment that asks for a statement at the end of the block it stands in.
_STEP = re.compile(r"/\*step:(.*)\*/", re.S)
#: What changes the variable on its left.
_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "++", "--"))


def place_steps(text: str) -> str:
    """Puts the statement of each /*step: ...*/ comment before the end of its block; in a block without an end it is dropped."""
    out: list[str] = []
    blocks: list[list[str]] = [[]]
    for part in _PARTS.findall(text):
        if (step := _STEP.fullmatch(part)) is not None:
            blocks[-1].append(step[1].strip())
            continue
        if part == "{":
            blocks.append([])
        elif part == "}" and len(blocks) > 1:
            out += [f"\n{s}\n" for s in blocks.pop()]
        out.append(part)
    return "".join(out)


def distinct_variables(text: str) -> str:
    """The n-th declaration (var, let) of one name in one block becomes name_n, and so do the uses that mean it.

    A use means the innermost block that has declared the name; members (behind a dot) aren't uses.
    """
    parts = _PARTS.findall(text)
    blocks: list[dict[str, int]] = [{}]
    out: list[str] = []
    last, declares = "", False  # the part before, without white space
    for part in parts:
        if part == "{":
            blocks.append({})
        elif part == "}" and len(blocks) > 1:
            blocks.pop()
        elif _NAME.fullmatch(part) and last != ".":
            if declares:
                blocks[-1][part] = blocks[-1].get(part, 0) + 1
            n = next((b[part] for b in reversed(blocks) if part in b), 1)
            out.append(f"{part}_{n}" if n > 1 else part)
            declares, last = part in ("var", "let"), part
            continue
        out.append(part)
        if not part.isspace():
            declares, last = False, part
    return "".join(out)


def shadow_parameters(text: str) -> str:
    """A parameter that its function's body assigns to is taken as name_param and copied to a variable of its own name."""
    parts = _PARTS.findall(text)
    solid = [i for i, p in enumerate(parts) if not p.isspace()]
    close = {"(": ")", "{": "}"}

    def end_of(at: int) -> int | None:
        """Place in solid of what closes the bracket at place `at`."""
        opened, closed, depth = parts[solid[at]], close[parts[solid[at]]], 0
        for k in range(at, len(solid)):
            depth += (parts[solid[k]] == opened) - (parts[solid[k]] == closed)
            if depth == 0:
                return k
        return None

    word = lambda k: parts[solid[k]] if 0 <= k < len(solid) else ""
    for at in range(len(solid)):
        if word(at) != "func" or word(at + 2) != "(":
            continue
        last = end_of(at + 2)
        start = next((k for k in range(last or len(solid), len(solid)) if word(k) in ("{", "func")), None)
        stop = end_of(start) if start is not None and word(start) == "{" else None
        if last is None or stop is None:
            continue
        names = [k for k in range(at + 3, last) if word(k - 1) in ("(", ",") and word(k + 1) == ":"]
        copies = ""
        for k in names:
            name = word(k)
            if any(word(j) == name and word(j - 1) not in (".", "var", "let") and word(j + 1) in _ASSIGN for j in range(start + 1, stop)):
                parts[solid[k]] = f"{name}_param"
                copies += f"\nvar {name} = {name}_param"
        parts[solid[start]] = "{" + copies
    return "".join(parts)


FIXES = (place_steps, shadow_parameters, distinct_variables)


def apply(df: DataFrame, text: str, name: str = "fixed", fixes: tuple[Callable[[str], str], ...] = FIXES) -> DataFrame:
    """df with a column of fixed texts, the fixes one after another; null stays null."""
    ready(df.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            for fix in fixes if t is not None else ():
                t = fix(t)
            return t

        return pd.Series([one(t) for t in texts], dtype=object)

    return df.withColumn(name, run(F.col(text)))
