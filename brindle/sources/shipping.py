"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from brindle.sources.tables import checkpoint_dir

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of this package, written to the shared checkpoint folder, to the application's Python files; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    target = context._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{context.applicationId}/{root.name}.zip")
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target.toString())
    _shipped.add(context.applicationId)
