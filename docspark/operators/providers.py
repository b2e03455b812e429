"""Models over texts with a provider: chunks, vectors and typed answers, and the budgets that bound a run.

The deterministic provider answers from digests of its input, so runs agree everywhere; a hosted provider is any object with the
same two methods. Texts reach a provider in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.text import split_recursive

#: Items of an array answer, and bytes of the digests of ids.
ITEMS, ID_BYTES = 2, 16


class Deterministic:
    """Vectors and answers from blake2b digests. Reproducible, without meaning."""

    def __init__(self, model: str = "deterministic-v1"):
        self.model = model

    def _digest(self, content: str, place: str, size: int) -> bytes:
        return hashlib.blake2b("\0".join((self.model, content, place)).encode(), digest_size=size).digest()

    def embed(self, texts: Iterable[str], dimensions: int) -> list[list[float]]:
        """Unit vectors: the bytes of as many 32-byte digests as are needed, scaled to [-1, 1]."""
        out = []
        for text in texts:
            raw = b"".join(self._digest(text, str(i), 32) for i in range(-(-dimensions // 32)))[:dimensions]
            v = [b / 127.5 - 1.0 for b in raw]
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    def complete(self, content: str, schema: dict, place: str = "") -> object:
        """A value of a JSON schema of objects, arrays, enums, integers, numbers, booleans and strings."""
        kind = schema.get("type", "string")
        if kind == "object":
            return {name: self.complete(content, part, f"{place}.{name}") for name, part in schema.get("properties", {}).items()}
        if kind == "array":
            return [self.complete(content, schema.get("items", {}), f"{place}[{i}]") for i in range(ITEMS)]
        digest = self._digest(content, place, 8)
        number = int.from_bytes(digest, "big")
        if schema.get("enum"):
            return schema["enum"][number % len(schema["enum"])]
        makers = {"integer": lambda: number % 1000, "number": lambda: round(number % 100000 / 100, 2), "boolean": lambda: number % 2 == 1}
        return makers[kind]() if kind in makers else "det-" + digest.hex()[:8]


def chunk_model(docs: DataFrame, size: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", metadata: str | None = None) -> DataFrame:
    """(chunk_id, document_id, chunk_index, start, text) of each chunk; `metadata` names a column whose text goes in front of every chunk
    and is taken from its size. Ids are digests of document, index and text."""

    @F.pandas_udf("array<struct<chunk_id:string,chunk_index:int,start:int,text:string>>")
    def cut(ids: pd.Series, texts: pd.Series, blocks: pd.Series) -> pd.Series:
        def one(i, text, block):
            room = size - len(block)
            if text and room < 1:
                raise ValueError(f"the metadata block of {i} leaves no room in chunks of {size}")
            rows = []
            for n, (a, b) in enumerate(split_recursive(text or "", max(room, 1), overlap)):
                body = block + text[a:b]
                rows.append({"chunk_id": hashlib.blake2b(f"{i}|{n}|{body}".encode(), digest_size=ID_BYTES).hexdigest(), "chunk_index": n, "start": a, "text": body})
            return rows

        return pd.Series([one(*x) for x in zip(ids, texts, blocks, strict=True)])

    block = F.lit("") if metadata is None else F.coalesce(metadata, F.lit(""))
    d = docs.select(F.col(id_col).cast("string").alias("document_id"), F.explode(cut(F.col(id_col).cast("string"), text_col, block)).alias("c"))
    return d.select("c.chunk_id", "document_id", "c.chunk_index", "c.start", "c.text")


def config_hash(**config: object) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def embed_model(rows: DataFrame, provider, dimensions: int, known: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, config_hash, embedding): vectors of rows whose text and configuration are in `known` are taken from there, the others are made."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.embed(texts.tolist(), dimensions))

    own = config_hash(provider=type(provider).__name__, model=provider.model, dimensions=dimensions)
    d = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("text_hash"), F.lit(own).alias("config_hash"), F.col(text_col).alias("text"))
    made = lambda x: x.withColumn("embedding", vectors("text")).drop("text")
    if known is None:
        return made(d)
    keys = ["id", "text_hash", "config_hash"]
    reused = known.select(*keys, "embedding").dropDuplicates(keys).join(d.drop("text"), keys)
    return reused.unionByName(made(d.join(known.select(*keys), keys, "left_anti")))


def one_space(*tables: DataFrame) -> str:
    """The one config_hash of tables of vectors that are to be compared; raises if there are several."""
    seen = {r[0] for t in tables for r in t.select("config_hash").distinct().limit(2).collect()}
    if len(seen) != 1:
        raise ValueError(f"vectors of {len(seen)} configurations can't be compared")
    return seen.pop()


def llm_model(rows: DataFrame, provider, schema: dict, id_col: str = "doc_id", text_col: str = "text", prompt: str = "", many: str | None = None) -> DataFrame:
    """Typed answers of a provider to prompt and text: (row_id, source_id, one column a field). `many` names an array field of
    objects whose items become rows with ids `id__ordinal`. Null texts give no row."""
    kinds = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string"}
    kind = lambda f: f"array<{kinds[f.get('items', {}).get('type', 'string')]}>" if f.get("type") == "array" else kinds[f.get("type", "string")]
    fields = schema["properties"][many]["items"]["properties"] if many else schema["properties"]
    item = ",".join(f"`{n}`:{kind(f)}" for n, f in fields.items())

    @F.pandas_udf(f"array<struct<{item}>>")
    def answer(texts: pd.Series) -> pd.Series:
        got = (provider.complete(prompt + t, schema) for t in texts)
        return pd.Series([a[many] if many else [a] for a in got])

    d = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("source_id"), F.posexplode(answer(text_col)).alias("n", "a"))
    row_id = F.concat_ws("__", "source_id", F.col("n").cast("string")) if many else F.col("source_id")
    return d.select(row_id.alias("row_id"), "source_id", *(F.col("a").getField(n).alias(n) for n in fields))


def check_budget(rows: DataFrame, text_col: str = "text", documents: int | None = None, size: int | None = None, tokens: int | None = None) -> dict[str, int]:
    """Documents, bytes and words that a run would send, before anything is sent; raises above a limit."""
    need = rows.agg(F.count(text_col).alias("documents"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.regexp_count(text_col, F.lit(r"\S+"))), F.lit(0)).alias("tokens")).first().asDict()
    for name, most in (("documents", documents), ("bytes", size), ("tokens", tokens)):
        if most is not None and need[name] > most:
            raise ValueError(f"the run needs {need[name]} {name}; the budget is {most}")
    return need
