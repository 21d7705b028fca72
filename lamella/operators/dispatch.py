"""Which decoder and which cleaner a representation goes to, by its media type and the capability asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import arrow

#: The capabilities of the cleaners.
PDF = ("clean.extract.pdf_llm", "clean.extract.pdf_text")
DOCUMENT = ("clean.ocr.local", "clean.extract.vision", "clean.extract.doc_llm")
WEB = ("clean.extract.web", "clean.extract.web_llm")
API, DETERMINISTIC = "clean.map.registered_api", "clean.deterministic"


def decoded(rows: DataFrame) -> DataFrame:
    """Rows (media, raw bytes) with ``decoded`` text and ``state``: decoded, invalid, or unsupported.

    PDFs give their text layer, images an empty text (none is made up for them), JSON its canonical form, other texts NFC with line feeds.
    """
    media, raw = F.col("media"), F.col("raw")
    text = F.try_validate_utf8(raw.cast("string"))
    kind = F.when(media == "application/pdf", "pdf").when(F.startswith(media, F.lit("image/")), "image").when(media == "application/json", "json").when(F.startswith(media, F.lit("text/")), "text")
    held = rows.withColumn("_kind", kind)
    out = F.when(F.col("_kind") == "image", "")
    # a decoder gets only what it decodes, as Spark runs it on every row
    for name, value in (("pdf", arrow.pdf_text(F.when(F.col("_kind") == "pdf", raw))), ("json", arrow.canonical_json(F.when(F.col("_kind") == "json", text))), ("text", arrow.canonical_text(F.when(F.col("_kind") == "text", text)))):
        out = out.when(F.col("_kind") == name, value)
    done = held.withColumn("decoded", out)
    return done.withColumn("state", F.when(F.col("_kind").isNull(), "unsupported").when(F.col("decoded").isNull(), "invalid").otherwise("decoded")).drop("_kind")


def clean_channel(capability: Column, media: Column, source_kind: Column) -> Column:
    """The channel (api, pdf, doc, web) that cleans a representation: its nature, PDF or image, wins over how it was fetched."""
    known = capability.isin(*PDF, *DOCUMENT, *WEB, API, DETERMINISTIC)
    return (
        F.when(~known, "unsupported").when(capability == API, "api").when(capability.isin(*PDF) | (media == "application/pdf"), "pdf")
        .when(capability.isin(*DOCUMENT) | F.startswith(media, F.lit("image/")), "doc").when(capability.isin(*WEB) | (source_kind == "http_resource"), "web").otherwise("doc")
    )


def cleaned(rows: DataFrame) -> DataFrame:
    """Rows (text, media) with ``clean`` and ``state``: images are refused, HTML is read without the sanitiser, other texts are tidied, and nothing left is empty."""
    media, text = F.col("media"), F.col("text")
    read = arrow.html_text(F.when(media == "text/html", text))["text"]
    tidy = arrow.plain_text(F.when((media != "text/html") & ~F.startswith(media, F.lit("image/")), text))
    out = rows.withColumn("clean", F.when(F.startswith(media, F.lit("image/")), F.lit(None).cast("string")).when(media == "text/html", read).otherwise(tidy))
    state = F.when(F.startswith(media, F.lit("image/")), "mismatch").when(F.coalesce("clean", F.lit("")) == "", "empty").otherwise("clean")
    return out.withColumn("state", state)
