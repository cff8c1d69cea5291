"""ASOF and POSITIONAL joins in query text.

Spark's parser has neither.  The two relations are joined by the operators of
``operators.joins`` and put in the text's place as one view: each relation is a struct
column named by its alias, so ``a.x`` means what it says, and names that only one of
them has stand beside the structs.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.operators.joins import asof_join, positional_join
from tarnlight.plans import dialect

_number = itertools.count()
_END = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "WINDOW", "QUALIFY", "UNION", "INTERSECT", "EXCEPT")
_COMPARE = re.compile(r"^`?(\w+)`?\s*\.\s*`?(\w+)`?\s*(=|>=|<=|>|<)\s*`?(\w+)`?\s*\.\s*`?(\w+)`?$")
_FLIP = {"=": "=", ">=": "<=", "<=": ">=", ">": "<", "<": ">"}


def rewrite(query: str, resolve: Callable[[list[str]], DataFrame]) -> str:
    """The query with its ASOF and POSITIONAL joins replaced by views; others come back as they are."""
    ts = dialect.tokens(query)
    while (at := next((i for i, t in enumerate(ts) if t.upper in ("ASOF", "POSITIONAL")), None)) is not None:
        ts = _one(ts, at, resolve)
    return dialect.text_of(ts)


def _relation(ts: list, i: int) -> tuple[list[str], str, int]:
    """Name, alias and the index after them, of a table reference at ``i``."""
    i = dialect._next(ts, i)
    if ts[i].kind not in ("word", "ident"):
        raise ValueError("ASOF and POSITIONAL joins take table names")
    plain = lambda t: t.text.strip('"`')
    name, i = [plain(ts[i])], i + 1
    if i + 1 < len(ts) and ts[i].text == ".":
        name.append(plain(ts[i + 1]))
        i += 2
    k = dialect._next(ts, i)
    if k < len(ts) and ts[k].upper == "AS":
        k = dialect._next(ts, k + 1)
        return name, plain(ts[k]), k + 1
    if k < len(ts) and (ts[k].kind == "ident" or ts[k].kind == "word" and ts[k].upper not in (*_END, "ASOF", "POSITIONAL", "ON", "USING", "LEFT", "JOIN")):
        return name, plain(ts[k]), k + 1
    return name, name[-1], i


def _one(ts: list, at: int, resolve) -> list:
    begin = max((i for i in range(at) if ts[i].upper == "FROM"), default=None)
    if begin is None:
        raise ValueError("ASOF and POSITIONAL joins follow FROM")
    left, a, _ = _relation(ts, begin + 1)
    join = next(i for i in range(at, len(ts)) if ts[i].upper == "JOIN")
    outer = any(t.upper == "LEFT" for t in ts[at:join])
    right, b, i = _relation(ts, join + 1)
    x, y = resolve(left), resolve(right)
    sides = [x.select(F.struct("*").alias(a), "*"), y.select(F.struct("*").alias(b), "*")]
    i = dialect._next(ts, i)
    if ts[at].upper == "POSITIONAL":
        joined, end = positional_join(sides[0].select(a), sides[1].select(b)), i
    else:
        depth, end = 0, i
        while end < len(ts) and not (depth == 0 and (ts[end].upper in _END or ts[end].text == ")")):
            depth += {"(": 1, ")": -1}.get(ts[end].text, 0)
            end += 1
        joined = _asof(sides, a, b, ts[i:end], outer)
    single = [(s, c) for s, own, other in ((a, x, y), (b, y, x)) for c in own.columns if c not in other.columns and c not in (a, b)]
    view = f"__joined_{next(_number)}"
    joined.select(a, b, *[F.col(f"`{s}`.`{c}`").alias(c) for s, c in single]).createOrReplaceTempView(view)
    head = list(ts[:begin])
    select = max(k for k in range(begin) if ts[k].upper == "SELECT")
    star = dialect._next(head, select + 1)
    if star < len(head) and head[star].text == "*":
        both = [f'"{s}"."{c}"' for s, own in ((a, x), (b, y)) for c in own.columns if (s, c) not in single]
        head[star] = dialect.Token("word", ", ".join([f'* EXCLUDE ("{a}", "{b}")', *both]))
    return dialect.tokens(dialect.text_of(head) + f' FROM "{view}" ' + dialect.text_of(ts[end:]))


def _asof(sides: list[DataFrame], a: str, b: str, condition: list, outer: bool) -> DataFrame:
    keys, bound = [], None
    if condition and condition[0].upper == "USING":
        names = [t.text.strip('"`') for t in condition if t.kind in ("word", "ident")][1:]
        keys, bound = [(n, n) for n in names[:-1]], (names[-1], ">=", names[-1])
    else:
        parts = re.split(r"(?i)\s+AND\s+", dialect.text_of(condition[1:]).replace('"', "`"))
        for p in parts:
            m = _COMPARE.match(p.strip().strip("()"))
            if not m or {m[1].lower(), m[4].lower()} != {a.lower(), b.lower()}:
                raise ValueError(f"not a comparison of the two sides: {p}")
            c, op, d = (m[2], m[3], m[5]) if m[1].lower() == a.lower() else (m[5], _FLIP[m[3]], m[2])
            if op == "=":
                keys.append((c, d))
            elif bound is None:
                bound = (c, op, d)
            else:
                raise ValueError("an ASOF join has one inequality")
    if bound is None:
        raise ValueError("an ASOF join needs an inequality")
    lt, op, rt = bound
    on = [f"__k{i}" for i in range(len(keys))] or ["__all"]
    pick = lambda df, s, names, t: df.select(s, *([F.col(f"`{n}`").alias(k) for k, n in zip(on, names)] if names else [F.lit(0).alias("__all")]), F.col(f"`{t}`").alias(f"__t_{s}"))
    return asof_join(pick(sides[0], a, [k[0] for k in keys], lt), pick(sides[1], b, [k[1] for k in keys], rt), on, f"__t_{a}", f"__t_{b}", how="left" if outer else "inner", direction="backward" if op[0] == ">" else "forward", exact="=" in op, split="1 day")
