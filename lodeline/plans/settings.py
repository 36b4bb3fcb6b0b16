"""Settings of the engine, read from the session's configuration (lodeline.*), else the defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    project_id: str = "default"
    llm_model: str = "gpt-5.4-mini"
    prices: str = ""  # a JSON object {model: [input, output, cached]} over the price table
    embedding_model: str = "text-embedding-3-small"
    kind_confidence: float = 0.80
    max_output_tokens: int = 4000
    max_repairs: int = 2
    confirmation_ttl: int = 86_400
    storage: str = ""  # where runs, versions and metadata are kept
    ignore_file: str = ".engineignore"
    embeddings: str = ""  # optional inputs: paths of vectors and of call graphs
    call_graphs: str = ""

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The settings of a session; a value that is not of its field's kind is an error."""
        got = {}
        for f in fields(cls):
            value = spark.conf.get(f"lodeline.{f.name}", None)
            if value is not None:
                got[f.name] = type(f.default)(value)
        return cls(**got)


def project_id(given: str | None, root: str | None, settings: Settings) -> str:
    """A project's id: as given, else the last part of its folder, else the default."""
    last = (root or "").rstrip("/").rsplit("/", 1)[-1]
    return given or last or settings.project_id
