"""Making this package importable by Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: name the package's folder to local workers, or send remote ones a zip of it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if sc.master.startswith("local"):
        paths = [str(_ROOT), *filter(None, [sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")])]
        sc.environment["PYTHONPATH"] = os.pathsep.join(paths)
        return
    target = Path(tempfile.mkdtemp()) / "terracell.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in [*(_ROOT / "terracell").rglob("*.py"), *_ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(str(target))
