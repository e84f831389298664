"""What the engine doesn't compute itself, behind interfaces: PDF decoding, recognition, embeddings and vision models.

Providers are pickled to the executors and set up there, once for each worker. The ones in this module are
deterministic stand-ins for tests; none of them pretends to recognise or understand anything.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirion.schema import DECODED_PAGE, DECODED_SPAN, SPAN

SPAN_COLUMNS = [c.split()[0] for c in SPAN.split(", ")]


@runtime_checkable
class PdfDecoder(Protocol):
    def pages(self, content: bytes) -> Iterator[dict]:
        """``page_number``, ``page_w``, ``page_h``, ``image_rects`` and ``spans`` (dicts of span columns) of each page."""


@runtime_checkable
class OcrEngine(Protocol):
    def text(self, image: bytes, language: str) -> str:
        """The text of an image."""

    def words(self, image: bytes, language: str) -> list[dict]:
        """The words of an image as rows of a recognition table."""


@runtime_checkable
class Embedder(Protocol):
    size: int

    def encode(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""


@runtime_checkable
class VisionProvider(Protocol):
    def describe(self, image_base64: str, mime: str, prompt: str) -> str:
        """A description of an image. Without this method, a provider has no vision."""


#: Registered providers of models, by name.
MODEL_PROVIDERS: dict[str, Callable[..., object]] = {}


def register_provider(name: str, factory: Callable[..., object]) -> None:
    MODEL_PROVIDERS[name] = factory


def list_providers() -> list[str]:
    return sorted(MODEL_PROVIDERS)


def health() -> dict[str, str]:
    return {"status": "HEALTH_SERVING", "message": "OCR Service running"}


class MissingProvider(RuntimeError):
    """A codec that isn't installed was asked for."""


def embedded(paras: DataFrame, embedder: Embedder) -> DataFrame:
    """Adds ``embedding`` to paragraphs, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(embedder.encode(part.tolist())), dtype=object)

    return paras.withColumn("embedding", encode("text"))


def recognised(images: DataFrame, engine: OcrEngine, language: str = "por", column: str = "image_data") -> DataFrame:
    """Adds ``text`` and ``ocr_error`` to page images; an error gives an empty text and doesn't stop the others."""
    schema = "text STRING, ocr_error STRING"

    @F.pandas_udf(schema)
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(image: bytes) -> tuple[str, str | None]:
            try:
                return engine.text(bytes(image), language), None
            except Exception as error:
                return "", str(error)

        for part in parts:
            yield pd.DataFrame([one(x) for x in part], columns=["text", "ocr_error"])

    return images.withColumn("__read", read(column)).select("*", "__read.*").drop("__read")


def decoded_spans(files: DataFrame, decoder: PdfDecoder) -> DataFrame:
    """Spans of the pages of files (``doc_id``, ``content``), one page at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc_id, content in zip(part["doc_id"], part["content"], strict=True):
                for page in decoder.pages(bytes(content)):
                    rows = [{"doc_id": doc_id, "page_number": page["page_number"], **s} for s in page["spans"]]
                    yield pd.DataFrame(rows, columns=SPAN_COLUMNS)

    return files.select("doc_id", "content").mapInPandas(run, SPAN)


def decoded_pages(files: DataFrame, decoder: PdfDecoder) -> DataFrame:
    """A row for each page of files (``doc_id``, ``content``): size, rectangles of images, spans, and its picture if the decoder has one.

    A file that can't be read gives one row with ``error`` and no page, and doesn't stop the others.
    """
    spans = [c.split(":")[0] for c in DECODED_SPAN.split(", ")]

    def pages(doc_id: int, content: bytes) -> list[tuple]:
        try:
            found = []
            for page in decoder.pages(bytes(content)):
                rows = [tuple(s.get(c) for c in spans) for s in page["spans"]]
                rects = [(float(r["w"]), float(r["h"])) for r in page.get("image_rects", [])]
                found.append((doc_id, page["page_number"], float(page["page_w"]), float(page["page_h"]), rects, rows, page.get("image_data"), None))
            return found
        except Exception as error:
            return [(doc_id, None, None, None, [], [], None, str(error))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc_id, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                columns = list(zip(*pages(doc_id, content or b""), strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(_named(c, t), t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = files.sparkSession.createDataFrame([], DECODED_PAGE).schema
    arrow = to_arrow_schema(schema)
    names, types = list(arrow.names), list(arrow.types)
    return files.select("doc_id", "content").mapInArrow(run, schema)


def _named(column: Iterable, kind: pa.DataType) -> list:
    """Lists of tuples as lists of named fields."""
    if not pa.types.is_list(kind):
        return list(column)
    fields = [kind.value_type.field(k).name for k in range(kind.value_type.num_fields)]
    return [[dict(zip(fields, row, strict=True)) for row in rows] for rows in column]


def described(images: DataFrame, provider: object, prompt: str, encode: Callable[[bytes], bytes] | None = None, retries: int = 1, delay: float = 1.0) -> DataFrame:
    """Adds ``outcome`` (success, no_vision_support or processing_error) and ``answer`` to images.

    The image is sent as base64 after ``encode``; if that fails, as it is. A failed call is tried once more.
    """
    schema = "outcome STRING, answer STRING"

    @F.pandas_udf(schema)
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import base64

        def one(image: bytes) -> tuple[str, str | None]:
            if not hasattr(provider, "describe"):
                return "no_vision_support", None
            data = bytes(image)
            if encode is not None:
                try:
                    data = encode(data)
                except Exception:
                    data = bytes(image)
            for k in range(retries + 1):
                try:
                    return "success", provider.describe(base64.b64encode(data).decode(), "image/jpeg", prompt)
                except Exception:
                    if k < retries:
                        time.sleep(delay)
            return "processing_error", None

        for part in parts:
            yield pd.DataFrame([one(x) for x in part], columns=["outcome", "answer"])

    return images.withColumn("__said", ask("image_data")).select("*", "__said.*").drop("__said")


# --- deterministic stand-ins ----------------------------------------------------------------------------------------


class HashEmbedder:
    """Vectors of hashed words: texts that share words are alike. A stand-in for tests."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            vector = [0.0] * self.size
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                vector[code % self.size] += 1.0 if code & 0x80000000 else -1.0
            out.append(vector)
        return out


class LetterEmbedder:
    """Counts of the letters a to z. A stand-in for tests that SQL can follow."""

    size = 26

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float(text.count(chr(97 + k))) for k in range(self.size)] for text in texts]


class JsonDecoder:
    """Reads files that are JSON lists of blocks of pages. A stand-in for tests; a page's picture says ``ocr`` and its number."""

    def pages(self, content: bytes) -> Iterator[dict]:
        import json

        found: dict[int, list[dict]] = {}
        for block in json.loads(content):
            found.setdefault(block["page_number"], []).append(block)
        for number, blocks in sorted(found.items()):
            spans = [
                {"block_no": b["block_idx"], "line_no": 0, "span_no": 0, "block_type": 0, "text": b["text"], "size": b["font_size"], "flags": 16 * b["is_bold"]} | {c: b[c] for c in ("x0", "x1", "y0", "y1")}
                for b in blocks
            ]
            yield {"page_number": number, "page_w": 595, "page_h": 842, "image_rects": [{"w": 100, "h": 50}], "spans": spans, "image_data": f"ocr {number}".encode()}


class EchoOcr:
    """Returns the bytes of the image as text. A stand-in for tests."""

    def text(self, image: bytes, language: str) -> str:
        return image.decode("utf-8")

    def words(self, image: bytes, language: str) -> list[dict]:
        return [{"text": w, "conf": "100", "level": 5} for w in self.text(image, language).split()]


class EchoVision:
    """Tells the size of what it was sent. A stand-in for tests."""

    def describe(self, image_base64: str, mime: str, prompt: str) -> str:
        return f"{mime} {len(image_base64)}"
