"""Command line: python tests/check.py [sf] [name prefix ...]"""

import importlib
import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from answerloom import catalog  # noqa: E402
from answerloom.session import build_session  # noqa: E402
from oracle import ROOT, compare  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    for module in catalog.MODULES:
        try:
            importlib.import_module(f"answerloom.catalog.{module}")
        except ModuleNotFoundError as err:
            print("missing", err)
    bad = 0
    for name, entry in catalog.REGISTRY.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if entry.sql is None:
                out = f"rows only: {len(entry.run(spark, f'{ROOT}/sf{sf}').collect())}"
                ok = True
            else:
                out = compare(spark, entry, f"{ROOT}/sf{sf}")
                ok = out is None
        except Exception as err:  # noqa: BLE001
            out = "".join(traceback.format_exception_only(err))[:1500]
            ok = False
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {out or ''}", flush=True)
    print("failures:", bad)


main()
