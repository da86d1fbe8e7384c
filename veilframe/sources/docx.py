"""Text of DOCX files: every text run of the main part, each with a space after it."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"


def text_of(data: bytes | None) -> str | None:
    """Null where the bytes are no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
            return "".join((e.text or "") + " " for _, e in ET.iterparse(f) if e.tag == _RUN)
    except (TypeError, KeyError, zipfile.BadZipFile, ET.ParseError):
        return None


def read_docx(spark, path: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(data):
        return data.map(text_of)

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("text"))
