"""Totals of a load that come from its own writes: no second pass over the rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from promptlens.session import write_text


def _sum_if(condition: Column | str) -> Column:
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0).cast("long"))


#: Of rows that are stored.
STORED = {"stored": "true", "flagged": "dlp_detected", "ssn": "contains_ssn", "toxic": "is_toxic_combination"}
#: Of deliveries, before duplicates go.
DELIVERED = {"delivered": "true", "malformed": "reason = 'malformed'", "rejected": "reason is not null and reason != 'malformed'"}


def observe(df: DataFrame, counts: dict[str, str], to: Observation | str) -> DataFrame:
    """The frame, counted as it is written: into an Observation, or on a stream under a name."""
    return df.observe(to, *(_sum_if(c).alias(name) for name, c in counts.items()))


@dataclass(frozen=True)
class Loaded:
    """What a load did; ``judged_invalid`` are rows whose judge's answers stayed invalid."""

    delivered: int = 0
    malformed: int = 0
    rejected: int = 0
    judged_invalid: int = 0
    stored: int = 0
    flagged: int = 0
    ssn: int = 0
    toxic: int = 0


FIELDS = ", ".join(f"{name} long" for name in Loaded.__dataclass_fields__)


def keep(spark: SparkSession, path: str, origin: str, batch: str, loaded: Loaded) -> None:
    """Keep a load's totals beside the table; a repeated load replaces its own."""
    write_text(spark, f"{path}/_counters/{origin}.{batch}.json", json.dumps({"origin": origin, "batch": batch} | asdict(loaded)))


def kept(spark: SparkSession, path: str) -> DataFrame:
    """(origin, batch, totals...) of all loads of a table."""
    return spark.read.schema(f"origin string, batch string, {FIELDS}").json(f"{path}/_counters")


class Totals(StreamingQueryListener):
    """Sums what streams observed under a name, batch by batch; a batch that is repeated counts once."""

    def __init__(self, name: str):
        self.name = name
        self._batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self._batches[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for counts in self._batches.values():
            for name, n in counts.items():
                out[name] = out.get(name, 0) + n
        return out
