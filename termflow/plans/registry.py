"""Query registry: each entry pairs a Spark job with the SQL that checks it."""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    job: Job
    sql: str | None


REGISTRY: dict[str, Entry] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Job], Job]:
    def deco(job: Job) -> Job:
        assert name not in REGISTRY, name
        REGISTRY[name] = Entry(name, tuple(ids.split()), job, sql)
        return job

    return deco


def compose(sql: str) -> str:
    """Prefix sql with the common table expressions it mentions, dependencies first."""
    need: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_][a-z0-9_]*", text))
        for n, body in CTES.items():
            if n in words and n not in need:
                mark = len(need)
                visit_body(n, body, mark)

    def visit_body(n: str, body: str, mark: int) -> None:
        if n in need:
            return
        seen.add(n)
        words = set(re.findall(r"[a-z_][a-z0-9_]*", body))
        for m, b in CTES.items():
            if m != n and m in words and m not in need and m not in seen:
                visit_body(m, b, mark)
        need.append(n)

    seen: set[str] = set()
    visit(sql)
    body = sql.strip()
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in need)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH'):]}"
    return f"WITH RECURSIVE {head}\n{body}"
