"""Make the package importable on Python workers of a local session.

Pandas UDFs and ``mapInPandas`` functions defined in this package are
pickled by module reference; workers import them. In local mode the
package is zipped once per process and added with ``addPyFile``, so it
works whatever the working directory. On a cluster the package is
deployed with the job (``--py-files`` / ``spark.submit.pyFiles``) and
nothing is staged here.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

_SHIPPED = set()


def ensure_shipped(spark) -> None:
    sc = spark.sparkContext
    key = id(sc)
    if key in _SHIPPED or not sc.master.startswith("local"):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    folder = tempfile.mkdtemp(prefix="evenkeel-pkg-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "evenkeel.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
