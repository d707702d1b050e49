"""Row counts of a job's stages, taken from the rows as they pass to the write: no stage is counted by a scan of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Progress:
    """Watches frames of one job, made with ``session``. What a stage has counted is known once an action has run through it.

    ``session`` stands beside the given one, with its tables and files: a session that has observed anything cannot send out models that
    were just fitted in it, for their training summaries hold the session. A task that Spark runs again inside the shuffle of a lost executor is counted again; results that must be exact are
    aggregates of their own.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.session = spark.newSession()
        self.stages: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, *more: Column) -> DataFrame:
        """``df``, whose ``rows`` (and the aggregates ``more``) are recorded by the first action that it is part of."""
        if stage in self.stages:
            raise ValueError(f"stage {stage} is watched twice")
        if df.sparkSession is self.spark:
            raise ValueError("watched frames are made with Progress.session")
        seen = self.stages[stage] = Observation(stage)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more)

    def facts(self, stage: str) -> dict[str, int]:
        """What the stage has counted; waits for its action. A plan that was found empty before it ran has counted nothing: 0 rows."""
        return {"rows": 0, **self.stages[stage].get}

    def table(self) -> DataFrame:
        """(place, stage, metric, value) in the order in which the stages were set up."""
        found = [(i, stage, metric, value) for i, stage in enumerate(self.stages) for metric, value in self.facts(stage).items()]
        return self.spark.createDataFrame(found, "place int, stage string, metric string, value long")
