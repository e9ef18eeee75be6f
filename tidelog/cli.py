"""Catalog commands: python -m tidelog.cli PATH create NAME COUNT | list | describe NAME | partition NAME NUMBER. Answers are JSON."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .engine import LogEngine
from .errors import LogError


def run(engine: LogEngine, words: list[str]) -> dict:
    """The answer to one command."""
    try:
        match words:
            case ["create", name, count]:
                engine.create_topic(name, int(count))
                return {"created": name, "partition_count": int(count)}
            case ["list"]:
                return {"topics": [r.asDict() for r in engine.list_topics().collect()]}
            case ["describe", name]:
                return {"topic": name, "partitions": [r.asDict() for r in engine.describe_topic(name).orderBy("partition").collect()]}
            case ["partition", name, number]:
                return engine.describe_partition(name, int(number)).first().asDict()
        return {"usage": __doc__}
    except LogError as e:
        return {"error": str(e), "code": e.code}


if __name__ == "__main__":
    print(json.dumps(run(LogEngine(SparkSession.builder.getOrCreate(), sys.argv[1]), sys.argv[2:]), indent=2) if len(sys.argv) > 2 else __doc__)
