"""Progress and cancellation of the jobs of one analysis."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import SparkSession


class Progress:
    """What is known of the jobs that were started under a tag."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag

    def counts(self) -> dict[str, int]:
        """Tasks of the jobs' stages that are still known: all of them, done, under way and failed."""
        tracker = self.spark.sparkContext.statusTracker()
        out = {"tasks": 0, "done": 0, "active": 0, "failed": 0}
        for job in tracker.getJobIdsForGroup(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    for name, n in zip(out, (s.numTasks, s.numCompletedTasks, s.numActiveTasks, s.numFailedTasks)):
                        out[name] += n
        return out

    def cancel(self) -> None:
        """Ends the jobs, and those that the same actions would start next; the actions fail."""
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.tag)


@contextlib.contextmanager
def tracked(spark: SparkSession, what: str = "analysis"):
    """Actions of this thread within the block can be watched, and cancelled from another thread."""
    context, tag = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(tag, what, interruptOnCancel=True)
    try:
        yield Progress(spark, tag)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
