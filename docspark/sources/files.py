"""Documents from folders and tables, and the extraction of JSON, Markdown, HTML and mail."""

from __future__ import annotations

import email
import email.policy
import email.utils
import fnmatch
import hashlib
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def document_id(source: str, path: str) -> str:
    return hashlib.blake2b(f"{source}:{path}".encode(), digest_size=16).hexdigest()


def scan_folder(spark: SparkSession, root: str, source: str, glob: str = "*", recursive: bool = True, keep: str | None = None) -> DataFrame:
    """(document_id, source_path, source_uri, content_hash, modified_at, content) of each file; `keep` filters relative paths."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")

    @F.pandas_udf(T.StringType())
    def ident(path: pd.Series) -> pd.Series:
        return path.map(lambda p: document_id(source, p))

    d = f.select(rel.alias("source_path"), F.col("path").alias("source_uri"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified_at"), "content")
    if keep:
        d = d.where(F.col("source_path").rlike(fnmatch.translate(keep).replace("\\Z", "$").replace("\\z", "$")))
    return d.withColumn("document_id", ident("source_path"))


def changed_since(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Rows of a scan (source_uri, content_hash) whose file now has other bytes, or none: what a verified fetch must refuse."""
    paths = [r[0] for r in found.select("source_uri").distinct().limit(100_001).collect()]
    if len(paths) > 100_000:
        raise ValueError("verify at most 100,000 files at once")
    if not paths:
        return found.limit(0)
    now = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("__path"), F.sha2("content", 256).alias("__hash"))
    return found.join(now, F.col("source_uri") == F.col("__path"), "left").where(~F.col("content_hash").eqNullSafe(F.col("__hash"))).drop("__path", "__hash")


def scan_table(df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows as documents: (document_id, content); null or repeated keys are an error when the plan runs, and so are more than `most` rows."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"the table has more than {most} rows")
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).agg(F.count("*")).scalar()
    return df.withColumn("__bad", bad).select(
        F.when(F.col("__bad") > 0, F.raise_error(F.lit(f"null or repeated {key}")).cast("string")).otherwise(F.col(key).cast("string")).alias("document_id"), F.to_json(F.struct(*df.columns)).alias("content")
    )


def newest(df: DataFrame, at: str = "modified_at") -> DataFrame:
    return df.agg(F.max(at).alias("newest"), F.count("*").alias("documents"))


def json_fields(content: Column, fields: list[str]) -> tuple[Column, Column]:
    """(struct of the fields as strings, array of the missing ones); anything but an object has all missing."""
    got = [F.get_json_object(content, f"$.{f}") for f in fields]
    missing = F.filter(F.array(*(F.when(g.isNull(), F.lit(f)) for f, g in zip(fields, got, strict=True))), lambda x: x.isNotNull())
    return F.struct(*(g.alias(f) for f, g in zip(fields, got, strict=True))), missing


class _Page(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    SKIP = {"script", "style", "noscript", "template"}
    BLOCK = {"p", "div", "section", "article", "li", "ul", "ol", "tr", "table", "br", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "blockquote", "pre", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title, self.links, self.meta = "", [], {}
        self.sections: list[tuple[int, str]] = []
        self.tables: list[list[list[str]]] = []
        self._skip, self._stack, self._cell, self._head = 0, [], None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self._skip += 1
        if tag in self.BLOCK:
            self.out.append("\n")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "meta" and (k := a.get("property") or a.get("name")):
            self.meta[k] = a.get("content") or ""
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self._cell = []
        if re.fullmatch("h[1-6]", tag):
            self._head = []
        if tag not in self.VOID:
            self._stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self._skip = max(0, self._skip - 1)
        if tag in self.BLOCK:
            self.out.append("\n")
        if tag in ("td", "th") and self._cell is not None and self.tables:
            self.tables[-1][-1].append(" ".join("".join(self._cell).split()))
            self.out.append(" ")
            self._cell = None
        if re.fullmatch("h[1-6]", tag) and self._head is not None:
            self.sections.append((int(tag[1]), " ".join("".join(self._head).split())))
            self._head = None
        if tag in self._stack:  # an end tag that nothing opened closes nothing
            while self._stack.pop() != tag:
                pass

    def handle_data(self, data):
        if self._skip:
            return
        if "title" in self._stack:
            self.title += data
            return
        for part in (self._cell, self._head):
            if part is not None:
                part.append(data)
        self.out.append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


HTML = _struct(
    text=_S, title=_S, links=T.ArrayType(_S), meta=T.MapType(_S, _S),
    sections=T.ArrayType(_struct(level=T.IntegerType(), heading=_S, start=T.IntegerType())), tables=T.ArrayType(T.ArrayType(T.ArrayType(_S))),
)


@F.pandas_udf(HTML)
def html_document(html: pd.Series) -> pd.DataFrame:
    """Visible text, title, links, meta and Open Graph values, headings with offsets, tables as matrices of cells."""
    rows = []
    for h in html:
        p = _Page()
        p.feed(h or "")
        p.close()
        text, at, sections = p.text(), 0, []
        for level, heading in p.sections:
            k = text.find(heading, at) if heading else -1
            sections.append({"level": level, "heading": heading, "start": k})
            at = max(at, k)
        rows.append({"text": text, "title": " ".join(p.title.split()), "links": p.links, "meta": p.meta, "sections": sections, "tables": p.tables})
    return pd.DataFrame(rows, columns=["text", "title", "links", "meta", "sections", "tables"])


@F.pandas_udf(_struct(subject=_S, sender=_S, recipients=_S, date=_S, body=_S))
def mail(content: pd.Series) -> pd.DataFrame:
    """Headers, the date as ISO 8601 and the text part (html stripped if there is no plain one)."""
    rows = []
    for c in content:
        m = email.message_from_bytes(bytes(c or b""), policy=email.policy.default)
        part = m.get_body(preferencelist=("plain", "html"))
        body = part.get_content() if part else ""
        if part and part.get_content_type() == "text/html":
            p = _Page()
            p.feed(body)
            body = p.text()
        try:
            date = email.utils.parsedate_to_datetime(str(m["date"])).isoformat() if m["date"] else None
        except (TypeError, ValueError):
            date = None
        rows.append({"subject": m["subject"], "sender": m["from"], "recipients": m["to"], "date": date, "body": body})
    return pd.DataFrame(rows, columns=["subject", "sender", "recipients", "date", "body"]).astype(object)


@F.pandas_udf(_struct(front=T.MapType(_S, _S), body=_S, word_count=T.IntegerType()))
def markdown(text: pd.Series) -> pd.DataFrame:
    """YAML front matter as strings, body and word count."""
    import json

    import yaml

    rows = []
    for t in text:
        m = re.match(r"\A---\s*\n(.*?)\n---\s*\n?(.*)\Z", t or "", re.S)
        front = yaml.safe_load(m.group(1)) if m else {}
        body = m.group(2) if m else (t or "")
        values = {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in (front if isinstance(front, dict) else {}).items()}
        rows.append({"front": values, "body": body, "word_count": len(body.split())})
    return pd.DataFrame(rows, columns=["front", "body", "word_count"])
