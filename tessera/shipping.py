"""Makes this package importable on executors that do not have it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def _ship(spark) -> None:
    """Send the package's sources once per application, unless workers start with its folder on PYTHONPATH."""
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _sent or str(ROOT.parent) in on_path:
        return
    path = os.path.join(tempfile.mkdtemp(), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in ROOT.rglob("*.py"):
            z.write(f, f"tessera/{f.relative_to(ROOT)}")
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        _ship(spark)
        return query(spark, sf_dir)

    return run
