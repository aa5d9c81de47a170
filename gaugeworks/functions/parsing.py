"""Parsers that no built-in function expresses: Arrow-batched pandas functions over plain Python ones, which never raise on bad text."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def render(value, indent: int = 0) -> str:
    """A JSON value as indented text: mappings as 'name: value', lists as '- value', null as nothing."""
    pad = "  " * indent
    if isinstance(value, dict):
        return "\n".join(f"{pad}{k}:\n{render(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}{k}: {render(v)}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{pad}- {render(v, indent + 1).lstrip()}" for v in value)
    if isinstance(value, bool):
        return pad + ("yes" if value else "no")
    return "" if value is None else pad + str(value)


def render_text(text: str | None) -> str | None:
    """render() of a JSON text; text that is no JSON stays as it is."""
    if text is None:
        return None
    try:
        return render(json.loads(text))
    except ValueError:
        return text


def first_array(text: str | None) -> str | None:
    """The first JSON array within prose, as compact JSON; null where none parses."""
    for m in re.finditer(r"\[", text or ""):
        try:
            found, _ = json.JSONDecoder().raw_decode(text, m.start())
        except ValueError:
            continue
        return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    return None


def run_program(text: str | None) -> tuple[float | None, str | None]:
    """Lines 'v1 = add(2, v0)' with add, sub, mul, div, up to the first 'ANSWER vK'; other lines are passed over.

    (value, error: null, or undefined_var, div_by_zero, no_program (no assignment at all), no_answer_line).
    """
    known: dict[str, float] = {}
    steps = re.compile(r"ANSWER\s+v(?P<answer>\d+)|v(?P<name>\d+)\s*=\s*(?P<op>add|sub|mul|div)\(\s*(?P<a>[^,()]+?)\s*,\s*(?P<b>[^,()]+?)\s*\)", re.IGNORECASE)
    number = lambda x: known[str(int(x[1:]))] if re.fullmatch(r"[vV]\d+", x) else float(re.sub("[,$]", "", x))
    for line in (text or "").splitlines():
        m = steps.fullmatch(line.strip())
        try:
            if m and m["answer"]:
                return known[str(int(m["answer"]))], None
            if m:
                a, b = number(m["a"]), number(m["b"])
                known[str(int(m["name"]))] = {"add": a + b, "sub": a - b, "mul": a * b, "div": a / b if b else None}[m["op"].lower()]
        except (KeyError, ValueError):
            return None, "undefined_var"
        if m and m["op"] and m["op"].lower() == "div" and b == 0:
            return None, "div_by_zero"
    return None, "no_answer_line" if known else "no_program"


def unified_diff(old: str | None, new: str | None, context: int = 3) -> str:
    return "\n".join(difflib.unified_diff((old or "").split("\n"), (new or "").split("\n"), "old", "new", lineterm="", n=context))


def board(fen: str | None) -> str | None:
    """The placement field of a FEN as eight rows of eight characters; null where it is none."""
    rows = (fen or "").split(" ")[0].split("/")
    out = ["".join("." * int(c) if c.isdigit() else c for c in r) for r in rows]
    return "\n".join(out) if len(out) == 8 and all(len(r) == 8 for r in out) else None


def _text(f) -> object:
    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series([f(v) for v in x], dtype=object)

    return of


def rendered(c: Column) -> Column:
    return _text(render_text)(c)


def salvaged_array(c: Column) -> Column:
    return _text(first_array)(c)


def chess_board(c: Column) -> Column:
    return _text(board)(c)


def program_result(c: Column) -> Column:
    @F.pandas_udf("value double, error string")
    def of(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([run_program(v) for v in x], columns=["value", "error"])

    return of(c)


def text_diff(a: Column, b: Column) -> Column:
    @F.pandas_udf("string")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([unified_diff(i, j) for i, j in zip(x, y)], dtype=object)

    return of(a, b)


def pieces(fen: Column) -> Column:
    """How many pieces stand on the board."""
    return F.regexp_count(F.split_part(fen, F.lit(" "), F.lit(1)), F.lit("[a-zA-Z]"))


def game_phase(fen: Column) -> Column:
    n = pieces(fen)
    return F.when(n >= 26, "opening").when(n >= 13, "middlegame").otherwise("endgame")


def named_option(text: Column, names: Column) -> Column:
    """The longest of names that the text holds, ignoring case; null where none."""
    low = F.lower(text)
    hits = F.filter(names, lambda n: F.contains(low, F.lower(n)))
    return F.get(F.transform(F.array_sort(F.transform(hits, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda s: s["n"]), F.lit(0))


def only_option(text: Column, names: Column) -> Column:
    """The one of names that the text holds, ignoring case; null where none or several."""
    low = F.lower(text)
    hits = F.filter(names, lambda n: F.contains(low, F.lower(n)))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def tagged_line(text: Column) -> Column:
    """kind (ask, final, malformed), body of a line 'ASK: ...' or 'FINAL: ...'."""
    m = lambda g: F.regexp_extract(text, r"^\s*(ASK|FINAL)\s*:\s*(\S.*?)\s*$", g)
    return F.struct(F.when(m(1) == "", "malformed").otherwise(F.lower(m(1))).alias("kind"), F.when(m(1) != "", m(2)).alias("body"))


def repeated_sentence(text: Column) -> Column:
    """Whether a sentence of the text occurs more than once."""
    s = F.filter(F.transform(F.split(text, r"[.!?]\s+"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.size(s) > F.size(F.array_distinct(s))
