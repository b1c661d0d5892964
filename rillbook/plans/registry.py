"""Named questions: each pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from rillbook.sources.fixtures import Tables, with_views


@dataclass(frozen=True)
class Question:
    name: str
    job: Callable[[Tables], DataFrame]
    views: tuple[str, ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.job(Tables(spark, sf_dir))

    def oracle(self) -> str | None:
        return None if self.sql is None else with_views(list(self.views), self.sql, "duckdb")


QUESTIONS: dict[str, Question] = {}


def question(name: str, views: str, sql: str | None = None):
    """Register a job under ``name``; ``sql`` reads the derived tables named in ``views``."""

    def register(job: Callable[[Tables], DataFrame]):
        if name in QUESTIONS:
            raise ValueError(f"{name} is registered twice")
        QUESTIONS[name] = Question(name, job, tuple(views.split()), sql)
        return job

    return register


def load_all() -> dict[str, Question]:
    from rillbook.plans import ingest_questions, monitor_questions, state_questions, stream_questions  # noqa: F401

    return dict(sorted(QUESTIONS.items()))
