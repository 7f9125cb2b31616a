"""Comparing engines: nearest-rank percentiles, overlap of result lists, a timing report."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labelled queries of the comparison.
QUERIES = (
    ("frase pt", "linguagem de programação"), ("frase pt sem acento", "linguagem de programacao"), ("frase pt", "sistema operacional"), ("frase pt", "biblioteca de classes"),
    ("pt acentuada", "máquina virtual"), ("pt", "tutorial introdutório"), ("pergunta pt", "como instalar o dotnet"), ("en", "what is dotnet"), ("en", "cloud infrastructure"),
    ("en", "generative ai"), ("termo técnico", "C#"), ("termo técnico", ".NET"), ("termo técnico", "asp.net core"), ("termo único", "dotnet"), ("typo pt", "lingagem"), ("typo acento", "programaçao"),
)


def percentile_expr(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def percentile(values: list[float], p: float) -> float:
    own = sorted(values)
    return own[min(max(math.ceil(p * len(own)) - 1, 0), len(own) - 1)]


def jaccard(a: list[str], b: list[str]) -> float:
    """1 for two empty lists. Each list keeps one spelling of what differs in case; across them case counts."""
    x, y = ({s.lower(): s for s in reversed(v)} for v in (a, b))
    one, two = set(x.values()), set(y.values())
    return len(one & two) / len(one | two) if one | two else 1.0


def jaccard_expr(a, b) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def compare(engines: dict[str, Callable[[str], list[str]]], queries=QUERIES, iterations: int = 20, warmup: int = 3) -> dict:
    """Latencies of two engines in turn, in ms, and the overlap of their results."""
    (name_a, a), (name_b, b) = engines.items()
    rows, pooled = [], {name_a: [], name_b: []}
    for label, text in queries:
        for _ in range(warmup):
            a(text), b(text)
        times, last = {name_a: [], name_b: []}, {}
        for _ in range(iterations):
            for name, run in engines.items():
                t = time.perf_counter()
                last[name] = run(text)
                times[name].append((time.perf_counter() - t) * 1000)
        for name in engines:
            pooled[name] += times[name]
        rows.append({"label": label, "query": text, "overlap": jaccard(last[name_a], last[name_b]), **{f"{n}_{q}": percentile(times[n], p) for n in engines for q, p in (("p50", 0.5), ("p95", 0.95))}})
    return {"queries": rows, "overlap": sum(r["overlap"] for r in rows) / len(rows), **{f"{n}_{q}": percentile(pooled[n], p) for n in engines for q, p in (("p50", 0.5), ("p95", 0.95))}}


def report(result: dict) -> str:
    """The comparison as a Markdown table."""
    names = [k for k in result["queries"][0] if k.endswith(("_p50", "_p95"))]
    lines = ["| label | query | " + " | ".join(names) + " | overlap |", "|" + "---|" * (len(names) + 3)]
    lines += ["| " + " | ".join([r["label"], r["query"], *(f"{r[n]:.1f}" for n in names), f"{r['overlap']:.2f}"]) + " |" for r in result["queries"]]
    return "\n".join([*lines, f"\noverlap {result['overlap']:.2f}; " + ", ".join(f"{n} {result[n]:.1f} ms" for n in names)])
