"""lodeline: a Spark-first retrieval, delta and versioning engine over text corpora."""

from __future__ import annotations

from pathlib import Path


def on_workers(spark) -> None:
    """Puts the folder of this package on the path of Python workers that start from now on, where they can see that folder.

    On a cluster that doesn't share it, ship the package with --py-files instead.
    """
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])
