"""Files as documents: text, DOCX and HTML, found by directory and pattern, re-read only when they change."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, include: str = "*", exclude: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content): files whose name matches ``include`` and none of the ``exclude`` patterns; no dot-files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.substring_index("path", "/", -1)
    found = found.filter(~name.startswith("."))
    for pattern in exclude:
        found = found.filter(~name.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in pattern) + "$"))
    return found


def changed(found: DataFrame, state: DataFrame) -> DataFrame:
    """Files that ``state`` (path, modificationTime) lacks or has an older time of."""
    known = state.groupBy("path").agg(F.max("modificationTime").alias("_known"))
    return found.join(known, "path", "left").filter(F.col("_known").isNull() | (F.col("modificationTime") > F.col("_known"))).drop("_known")


def docx_text(data: bytes) -> str:
    """The paragraphs of a DOCX file, by line; tabs and breaks stay."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        lines.append("".join(parts))
    return "\n".join(lines)


@pandas_udf(T.StringType())
def _docx(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(data):
        try:
            return docx_text(data)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    for contents in parts:
        yield contents.map(one, na_action="ignore")


def html_text(html: str | Column) -> Column:
    """A page's text: without scripts, styles and tags, entities of the common kinds resolved, white space collapsed."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def documents(found: DataFrame) -> DataFrame:
    """(path, text) by file extension; a DOCX that can't be read has a NULL text."""
    ext = F.lower(F.substring_index("path", ".", -1))
    plain = F.decode(F.col("content"), "UTF-8")
    docx = found.filter(ext == "docx").select("path", _docx("content").alias("text"))
    rest = found.filter(ext != "docx").select("path", F.when(ext.isin("html", "htm"), html_text(plain)).otherwise(plain).alias("text"))
    return docx.unionByName(rest)
