"""The registry must import with PySpark loaded from its zip archive (as a
cluster ships it) and without starting a JVM or reading any file."""
import glob
import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_import_from_pyspark_zip():
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = [os.path.join(lib, "pyspark.zip"), *glob.glob(os.path.join(lib, "py4j-*.zip"))]
    if not all(map(os.path.exists, zips)):
        return      # already running from an archive layout
    code = ("import pyspark, __spark_entry__ as e; assert '.zip' in pyspark.__file__, pyspark.__file__; "
            "q, s = e.queries(), e.oracle_sql(); assert len(q) >= 67 and set(s) <= set(q)")
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([*zips, ROOT])}
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, check=True, timeout=120)
