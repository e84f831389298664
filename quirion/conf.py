"""Settings of the engine and options of a request.

Settings come from the environment, and a Spark conf key ``quirion.<name>`` in lower case overrides each.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConf:
    # Defaults that callers rely on.
    storage_endpoint: str | None = None
    storage_access_key: str | None = None
    storage_secret_key: str | None = None
    storage_region: str = "auto"
    llm_provider: str = "openai"
    llm_model: str = "gpt-4o-mini"
    llm_api_key: str = ""
    llm_temperature: float = 0.1
    llm_max_tokens: int = 8192
    llm_system_prompt: str | None = None
    llm_vision_prompt: str | None = None
    chunk_size: int = 4000
    min_chunk_size: int = 200
    chunk_overlap: int = 0
    similarity_threshold: float = 0.7
    embedding_model: str = "paraphrase-multilingual-MiniLM-L12-v2"
    vision_max_width: int = 1024
    vision_max_height: int = 1024
    vision_jpeg_quality: int = 85

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> EngineConf:
        base = cls()
        found: dict[str, Any] = {}
        for f in fields(cls):
            raw = os.environ.get(f.name.upper())
            if spark is not None:
                raw = spark.conf.get(f"quirion.{f.name}", raw)
            if raw:
                kind = type(getattr(base, f.name))
                found[f.name] = kind(raw) if kind in (int, float) else raw
        return replace(base, **found)


@dataclass(frozen=True)
class ChunkOptions:
    strategy: str = "page"
    chunk_size: int = 4000
    min_chunk_size: int = 200
    chunk_overlap: int = 0
    similarity_threshold: float = 0.7
    embedding_model: str = ""
    detect_images: bool = True

    @property
    def min_paragraph(self) -> int:
        """Characters that a paragraph needs to be kept."""
        return max(1, self.min_chunk_size // 4)

    @classmethod
    def resolve(cls, options: dict[str, Any] | None = None, conf: EngineConf | None = None) -> ChunkOptions:
        """Options of a request over the settings. Zero or empty means unset for sizes and names.

        A threshold of zero counts; one that is given as None is an error.
        """
        given, conf = options or {}, conf or EngineConf()
        threshold = given.get("similarity_threshold", conf.similarity_threshold)
        if threshold is None:
            raise ValueError("similarity_threshold can't be None")
        return cls(
            strategy=(given.get("chunk_strategy") or "page").lower(),
            chunk_size=given.get("chunk_size") or conf.chunk_size,
            min_chunk_size=given.get("min_chunk_size") or conf.min_chunk_size,
            chunk_overlap=given.get("chunk_overlap") or conf.chunk_overlap,
            similarity_threshold=threshold,
            embedding_model=given.get("embedding_model") or conf.embedding_model,
            detect_images=bool(given.get("detect_images", True)),
        )


# Prompts in use where none is configured.
SYSTEM_PROMPT = "Você é um assistente especializado em análise de documentos. Forneça análises claras e objetivas."
VISION_PROMPT = (
    "Analise esta imagem e descreva objetivamente o que você vê. Foque em: "
    "- Tipo de conteúdo (texto, gráfico, tabela, foto, diagrama, etc.) "
    "- Elementos visuais principais - Texto presente na imagem - Estrutura e layout "
    "Forneça uma descrição clara e direta em português."
)


@dataclass(frozen=True)
class VisionOptions:
    provider: str
    model: str
    api_key: str
    temperature: float
    max_tokens: int
    system_prompt: str
    vision_prompt: str
    max_width: int
    max_height: int
    jpeg_quality: int

    @classmethod
    def resolve(cls, options: dict[str, Any] | None = None, conf: EngineConf | None = None) -> VisionOptions:
        """Arguments over settings over defaults. Zero counts for the temperature and the image sizes, not for the rest."""
        given, conf = options or {}, conf or EngineConf()

        def kept(name: str, setting: Any) -> Any:
            value = given.get(name)
            return setting if value is None else value

        return cls(
            provider=given.get("llm_provider") or conf.llm_provider,
            model=given.get("llm_model") or conf.llm_model,
            api_key=given.get("llm_api_key") or conf.llm_api_key,
            temperature=kept("llm_temperature", conf.llm_temperature),
            max_tokens=given.get("llm_max_tokens") or conf.llm_max_tokens,
            system_prompt=given.get("llm_system_prompt") or conf.llm_system_prompt or SYSTEM_PROMPT,
            vision_prompt=given.get("llm_vision_prompt") or conf.llm_vision_prompt or VISION_PROMPT,
            max_width=kept("vision_max_width", conf.vision_max_width),
            max_height=kept("vision_max_height", conf.vision_max_height),
            jpeg_quality=kept("vision_jpeg_quality", conf.vision_jpeg_quality),
        )
