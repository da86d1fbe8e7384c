"""Sending this package's sources to Python workers, once a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_veilframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="veilframe-src-"), "veilframe_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(out)
    sc._veilframe_shipped = True
