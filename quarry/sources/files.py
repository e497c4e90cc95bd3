"""Files to text: a ``binaryFile`` scan, SQL for text formats, Python for the others only."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import extension, plain_markdown, uploadable

WORD_SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What decoding puts for bytes that aren't UTF-8, and what stands in for a genuine one.
REPLACEMENT, STAND_IN = "\ufffd", "\U0010fffe"
EXTRACTED = "path string, name string, content binary, ext string, text string, status string"


def decoded(content: bytes) -> str:
    return content.decode("utf-8", errors="ignore")


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word document, with a blank line between."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    kinds = {f"{WORD_SPACE}t": lambda e: e.text or "", f"{WORD_SPACE}tab": lambda e: "\t", f"{WORD_SPACE}br": lambda e: "\n"}
    return "\n\n".join("".join(kinds[e.tag](e) for e in p.iter() if e.tag in kinds) for p in root.iter(f"{WORD_SPACE}p"))


def pdf_text(content: bytes) -> str:
    """Pages of a PDF; scanned ones through character recognition.  Needs optional libraries."""
    import pypdf

    text = "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)
    if text.strip():
        return text
    import pdf2image
    import pytesseract

    found = []
    for image in pdf2image.convert_from_bytes(content):
        try:
            found.append(pytesseract.image_to_string(image))
        except Exception as why:  # one page's failure leaves the others
            print(f"page not recognised: {why}")
        finally:
            image.close()
    return "\n".join(x for x in found if x)


#: Extractors of binary formats by extension; a failure falls back to the bytes as text.
EXTRACTORS = {".pdf": pdf_text, ".docx": docx_text, ".doc": docx_text}


def extract_binary(rows: DataFrame, extractors=None) -> DataFrame:
    """Text and status (``ok`` or the reason of the fallback) of PDF and Word files."""
    own = EXTRACTORS if extractors is None else extractors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, states = [], []
            for ext, content in zip(batch["ext"], batch["content"], strict=True):
                text, state = "", "ok"
                try:
                    text = own[ext](bytes(content))
                except Exception as why:  # a broken file, or a library that isn't there
                    state = f"fallback: {type(why).__name__}: {why}"
                if not text.strip() and (ext == ".pdf" or state != "ok"):
                    text = decoded(bytes(content))
                texts.append(text)
                states.append(state)
            yield batch.assign(text=texts, status=states)

    return rows.select("path", "name", "content", "ext", F.lit("").alias("text"), F.lit("").alias("status")).mapInPandas(run, EXTRACTED)


def plain_text(rows: DataFrame) -> DataFrame:
    """Text of the other files: Markdown loses its signs, the rest is decoded as it is.

    Bytes that aren't UTF-8 are left out.  SQL's decoding marks them by U+FFFD, so a
    genuine one is kept under a noncharacter meanwhile, in files that have both.
    """
    raw = F.col("content").cast("string")
    kept = F.replace(F.make_valid_utf8(F.replace(raw, F.lit(REPLACEMENT), F.lit(STAND_IN))), F.lit(REPLACEMENT), F.lit(""))
    exact = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(kept, F.lit(STAND_IN), F.lit(REPLACEMENT)))
    shown = F.when(F.col("ext").isin(".md", ".markdown"), plain_markdown(exact)).otherwise(exact)
    return rows.select("path", "name", "content", "ext", shown.alias("text"), F.lit("ok").alias("status"))


def extracted(files: DataFrame, extractors=None) -> DataFrame:
    """``path, name, content, ext, text, status`` of ``files(path, content)``."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    named = named.withColumn("ext", extension(F.col("name")))
    binary = F.col("ext").isin(*(EXTRACTORS if extractors is None else extractors))
    return plain_text(named.where(~binary)).unionByName(extract_binary(named.where(binary), extractors))


def read_files(spark: SparkSession, path: str, all_kinds: bool = False) -> DataFrame:
    """Files under a path or glob; by default those of the kinds that the upload form takes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files if all_kinds else files.where(uploadable(F.col("path")))
