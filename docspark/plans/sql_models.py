"""SQL models: references, compilation, a single-select check, and runs over DataFrames."""

from __future__ import annotations

import hashlib
import inspect
import itertools
import re
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

_REF = re.compile(r"\{\{\s*(ref\(\s*['\"](\w+)['\"]\s*\)|this|target|is_incremental\(\))\s*\}\}")
_IF = re.compile(r"\{%\s*if\s+is_incremental\(\)\s*%\}(.*?)\{%\s*endif\s*%\}", re.S)


def refs(sql: str) -> list[str]:
    return sorted({m.group(2) for m in _REF.finditer(sql) if m.group(2)})


def compile_sql(sql: str, names: dict[str, str], this: str = "this", target: str = "local", incremental: bool = False) -> str:
    sql = _IF.sub(lambda m: m.group(1) if incremental else "", sql)

    def put(m: re.Match) -> str:
        if m.group(2):
            return names[m.group(2)]
        return {"this": this, "target": target}.get(m.group(1), str(incremental).lower())

    return _REF.sub(put, sql)


def single_select(sql: str) -> str:
    """The statement without comments and final semicolon; raises unless it is one SELECT or WITH."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", lambda m: m.group() if m.group()[0] == "'" else " ", sql, flags=re.S).strip().rstrip(";").strip()
    if ";" in re.sub(r"'(?:[^']|'')*'", "", bare) or not re.match(r"(?is)(select|with)\b", bare):
        raise ValueError("a model is one SELECT")
    return bare


def run(spark: SparkSession, sql: str, inputs: dict[str, DataFrame], incremental: bool = False) -> DataFrame:
    """The model over named DataFrames; Catalyst plans it as a whole."""
    return spark.sql(compile_sql(single_select(sql), {n: "{" + n + "}" for n in refs(sql)}, incremental=incremental), **{n: inputs[n] for n in refs(sql)})


class ModelGraph:
    """Models by name with what they depend on: order, generations and selection."""

    def __init__(self, parents: dict[str, set[str]], tags: dict[str, set[str]] | None = None):
        self.parents = {n: set(p) for n, p in parents.items()}
        self.tags = tags or {}

    def order(self) -> list[str]:
        t = TopologicalSorter(self.parents)
        t.prepare()
        out = []
        while t.is_active():
            ready = sorted(t.get_ready())
            out += ready
            t.done(*ready)
        return out

    def generations(self) -> list[list[str]]:
        t = TopologicalSorter(self.parents)
        t.prepare()
        out = []
        while t.is_active():
            out.append(sorted(t.get_ready()))
            t.done(*out[-1])
        return out

    def _reach(self, start: set[str], edges: dict[str, set[str]]) -> set[str]:
        seen, todo = set(start), list(start)
        while todo:
            for x in edges.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def select(self, selectors: list[str], exclude: list[str] = (), modified: set[str] = frozenset()) -> list[str]:
        """Union of name, +name, name+, tag:x and state:modified selectors, less the excluded, in order."""
        children: dict[str, set[str]] = {}
        for n, ps in self.parents.items():
            for p in ps:
                children.setdefault(p, set()).add(n)

        def one(s: str) -> set[str]:
            core = s.strip("+")
            base = {n for n, t in self.tags.items() if core[4:] in t} if core.startswith("tag:") else set(modified) if core == "state:modified" else {core}
            out = set(base)
            if s.startswith("+"):
                out |= self._reach(base, self.parents)
            if s.endswith("+"):
                out |= self._reach(base, children)
            return out

        chosen = set().union(*map(one, selectors)) if selectors else set(self.parents)
        dropped = set().union(*map(one, exclude)) if exclude else set()
        return [n for n in self.order() if n in chosen - dropped]

    def mermaid(self) -> str:
        return "\n".join(["graph LR", *(f"  {p} --> {n}" for n in self.order() for p in sorted(self.parents.get(n, ())))])


def build(graph: ModelGraph, run_one) -> dict[str, str]:
    """Run models in order; run_one(name) returns whether it succeeded. Descendants of a failure are skipped."""
    status: dict[str, str] = {}
    for n in graph.order():
        if any(status.get(p) in ("error", "skipped") for p in graph.parents.get(n, ())):
            status[n] = "skipped"
            continue
        try:
            status[n] = "success" if run_one(n) is not False else "error"
        except Exception as e:  # noqa: BLE001 a model may fail in any way; its descendants must not run
            status[n] = "error"
            status[f"{n}:message"] = str(e)[:500]
    return status


def expand(name: str, sql: str, each: dict[str, list[str]]) -> dict[str, str]:
    """Models from a template: one for each combination of the values of `each`, with `{{ key }}` replaced in name and statement.
    Names must differ."""
    out: dict[str, str] = {}
    for values in itertools.product(*each.values()):
        made = [name, sql]
        for key, value in zip(each, values, strict=True):
            made = [re.sub(r"\{\{\s*" + re.escape(key) + r"\s*\}\}", lambda _, v=value: v, x) for x in made]
        if made[0] in out:
            raise ValueError(f"two models are named {made[0]}")
        out[made[0]] = made[1]
    return out


def dry_run(spark, sql: str, tables: dict) -> list[tuple[str, str]]:
    """(column, type) of what a model would return; nothing is executed."""
    return run(spark, sql, tables).dtypes


def manifest(models: dict[str, str], tags: dict[str, list[str]] | None = None) -> dict[str, dict]:
    """What a project is made of: for each model the digest of its statement, what it reads and its tags."""
    return {n: {"digest": hashlib.sha256(" ".join(q.split()).encode()).hexdigest(), "refs": sorted(refs(q)), "tags": sorted((tags or {}).get(n, []))} for n, q in sorted(models.items())}


def modified(before: dict[str, dict], after: dict[str, dict]) -> dict[str, list[str]]:
    """Models that are new, changed or removed between two manifests."""
    return {
        "new": sorted(set(after) - set(before)),
        "changed": sorted(n for n in set(after) & set(before) if after[n]["digest"] != before[n]["digest"]),
        "removed": sorted(set(before) - set(after)),
    }


def code_version(*functions) -> str:
    """A digest of the source of some functions: rows made by other code are made anew."""
    return hashlib.sha256("\n".join(inspect.getsource(f) for f in functions).encode()).hexdigest()[:16]
