"""Print the formatted physical plan of analyses over stored tables.

Usage: python tools/explain.py sf_dir name [name ...]
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import bench  # noqa: E402
from wardrank.session import build_session, scratch_path  # noqa: E402
from wardrank.sources import files  # noqa: E402
from wardrank.sources.fixture import cms_fixture  # noqa: E402

sf_dir, names = sys.argv[1], sys.argv[2:]
spark = build_session()
root = scratch_path(spark, "explain")
files.save_tables(*cms_fixture(spark, sf_dir), root)
c, h = files.load_tables(spark, root)
for name in names:
    fn, params = bench.ANALYSES[name]
    df = fn(c, h, **params)
    df.write.format("noop").mode("overwrite").save()
    print(f"===== {name}")
    df.explain("formatted")
