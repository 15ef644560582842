"""Helpers for side tables that other operators join to."""

import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.util import inheritable_thread_target

#: Independent jobs that a driver has in flight at once.
AT_ONCE = 8


def ensure_checkpoint_dir(spark) -> str:
    """The shared checkpoint folder the cluster names. Where none is configured, a session
    that runs in one process gets a folder of its own; on a cluster that is an error, since
    executors don't see each other's local folders."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="steadfast-ckpt-")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def pinned(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back, so that later uses see the very same
    rows and the optimizer knows their bytes: it broadcasts what is small and shuffles the
    rest."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def concurrently(jobs: Mapping, at_once: int = AT_ONCE) -> dict:
    """The results of independent driver-side jobs, run from a bounded pool of threads that inherit the
    caller's job group and local properties: their small stages fill each other's idle cores. The
    first error is raised; results keep the order of the jobs."""
    if not jobs:
        return {}
    with ThreadPoolExecutor(min(at_once, len(jobs))) as pool:
        started = {name: pool.submit(inheritable_thread_target(job)) for name, job in jobs.items()}
        return {name: one.result() for name, one in started.items()}


def job(fn: Callable, *args, **options) -> Callable:
    return lambda: fn(*args, **options)
