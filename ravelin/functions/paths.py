"""Scalar functions over paths, globs and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_of_path(file: Column, depth: int = 2, root: str = "") -> Column:
    """The first depth folders of a path (its file name left out), after the root."""
    parts = F.filter(F.split(F.when(file.startswith(root), F.substring(file, len(root) + 1, 1 << 30)).otherwise(file) if root else file, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.least(F.lit(depth), F.size(parts) - 1))), "/")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over whole paths: * and ** cross folders, ? is one character, [..] and {a,b} as usual."""
    out, at, braces = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        elif c == "[" and "]" in glob[at + 1 :]:
            end = glob.index("]", at + 1)
            out, at = out + "[" + glob[at + 1 : end].replace("!", "^", 1) + "]", end
        else:
            out += re.escape(c)
        at += 1
    return f"^{out}$"


def should_include(path: Column, include: list[str] | None, exclude: list[str]) -> Column:
    """Whether a path is taken: what is excluded is out, and without an include list all else is in."""
    hit = lambda globs: F.coalesce(*(F.when(path.rlike(glob_regex(g)), F.lit(True)) for g in globs), F.lit(False)) if globs else F.lit(False)
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncated_signature(text: Column, most: int = 200) -> Column:
    """The first line, trimmed, and cut after so many characters."""
    first = trimmed(F.get(F.split(text, "\n"), F.lit(0)))
    return F.when(F.char_length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)
