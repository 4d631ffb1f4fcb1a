"""Check-side SQL: composes one DuckDB statement from shared CTEs and a query body."""

from __future__ import annotations

import re

from sitefit import fixed as fx
from sitefit.sources.bindings import BINDINGS, DUCK

CTES: dict[str, str] = {name: make(DUCK) for name, (make, _, _) in BINDINGS.items()}


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, int):
        return f"{v}::BIGINT"
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    names = columns.split(",")
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(names)})"


def cte(name: str, body: str) -> None:
    CTES[name] = body


def sql(body: str, recursive: str = "") -> str:
    """Prefix the body with every CTE it names, directly or through another CTE."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in CTES and word not in needed:
                needed.append(word)
                visit(CTES[word])

    def order(names: list[str]) -> list[str]:
        done: list[str] = []

        def place(n: str, path: tuple = ()) -> None:
            if n in done or n in path:
                return
            for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", CTES[n])):
                if word in names and word != n:
                    place(word, path + (n,))
            done.append(n)

        for n in names:
            place(n)
        return done

    visit(body + " " + recursive)
    parts = [f"{n} AS ({CTES[n]})" for n in order(needed)]
    if recursive:
        parts.append(recursive)
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) if parts else ""
    return f"{head}\n{body}"


def cte_over(names: tuple[str, ...], old: str, new: str, mark: str) -> dict[str, str]:
    """Copies of CTEs that read ``new`` where the originals read ``old``, directly or through others; original name -> copy."""
    copies: dict[str, str] = {}

    def reads(name: str) -> bool:
        return any(w == old or (w in CTES and w != name and reads(w)) for w in set(re.findall(r"[a-z_][a-z0-9_]*", CTES[name])))

    def copy(name: str) -> str:
        if name == old:
            return new
        if name not in CTES or not reads(name):
            return name
        if name not in copies:
            copies[name] = f"{name}_{mark}"
            cte(copies[name], re.sub(r"[a-z_][a-z0-9_]*", lambda m: copy(m[0]) if m[0] != name else m[0], CTES[name]))
        return copies[name]

    for name in names:
        copy(name)
    return copies


# --- arithmetic shared by many checks --------------------------------------------------------
def dist(ax, ay, bx, by) -> str:
    return f"sqrt((({ax}) - ({bx})) * (({ax}) - ({bx})) + (({ay}) - ({by})) * (({ay}) - ({by})))"


def seg(px: str, py: str, e: str = "e.") -> str:
    """Point-to-segment distance for an edge row."""
    x1, y1, x2, y2 = (f"{e}{c}" for c in ("x1", "y1", "x2", "y2"))
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = (f"(CASE WHEN {len2} > 0 THEN greatest(0e0, least(1e0, (({px} - {x1}) * {dx} + ({py} - {y1}) * {dy}) / {len2})) "
         f"ELSE 0e0 END)")
    return dist(px, py, f"{x1} + {t} * {dx}", f"{y1} + {t} * {dy}")


def cross(px: str, py: str, e: str = "e.") -> str:
    x1, y1, x2, y2 = (f"{e}{c}" for c in ("x1", "y1", "x2", "y2"))
    up = f"{y1} <= {y2}"
    xa, ya = f"(CASE WHEN {up} THEN {x1} ELSE {x2} END)", f"(CASE WHEN {up} THEN {y1} ELSE {y2} END)"
    xb, yb = f"(CASE WHEN {up} THEN {x2} ELSE {x1} END)", f"(CASE WHEN {up} THEN {y2} ELSE {y1} END)"
    return (f"(CASE WHEN {ya} <= {py} AND {py} < {yb} THEN "
            f"{px} < {xa} + ({py} - {ya}) * ({xb} - {xa}) / ({yb} - {ya}) ELSE FALSE END)")


def rnd(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}e0"
    return f"(floor(({expr}) * {scale} + 0.5e0) / {scale})"


def fmt2(expr: str) -> str:
    cents = f"CAST(floor(abs({expr}) * 100e0 + 0.5e0) AS BIGINT)"
    return (f"concat(CASE WHEN ({expr}) < 0 AND {cents} > 0 THEN '-' ELSE '' END, CAST({cents} // 100 AS VARCHAR), '.', "
            f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))")


def short(expr: str) -> str:
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


def re2(pattern: str) -> str:
    """Unicode word classes for an engine whose own are ASCII; meant for names with doubled spaces."""
    inside, out, i = False, "", 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\b":
            out += r"(?:^|$|[^\p{L}\p{N}_])"
            i += 2
        elif two == r"\w":
            out += r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]"
            i += 2
        elif two == r"\s":
            out += r"\s"
            i += 2
        else:
            c = pattern[i]
            inside = True if c == "[" else False if c == "]" else inside
            out += " +" if c == " " and not inside else c
            i += 1
    return out


def wide(expr: str) -> str:
    return f"replace({expr}, ' ', '  ')"
