"""Named queries over the given tables, each with the SQL that says what it must return."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ferrylog.plans import event_model
from ferrylog.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(2024, 1, 15, tzinfo=timezone.utc)


#: Values of the stored event format, which SQL names like parameters (``:run_started``).
STORED = {
    "run_started": event_model.RUN_STARTED,
    "run_completed": event_model.RUN_COMPLETED,
    "run_failed": event_model.RUN_FAILED,
    "user_moved": event_model.USER_MOVED,
    "admin_moved": event_model.ADMIN_MOVED,
    "run": event_model.RUN,
    "topic_prefix": event_model.TOPIC_PREFIX,
    "completed_title": event_model.TITLES[event_model.RUN_COMPLETED],
    "failed_title": event_model.TITLES[event_model.RUN_FAILED],
    "completed_text": event_model.COMPLETED_TEXT,
    "failed_text": event_model.FAILED_TEXT,
    "initiated_text": event_model.INITIATED_TEXT,
    "undone_text": event_model.UNDONE_TEXT,
}


def with_stored_values(sql: str) -> str:
    return re.sub(r":([a-z_]+)\b", lambda m: f"'{STORED[m[1]]}'" if m[1] in STORED else m[0], sql)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_stored_values(sql)
        return function

    return register
