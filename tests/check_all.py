"""Command line: python tests/check_all.py FOLDER [name ...] - compare queries with their SQL, print seconds and rows."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_points  # noqa: E402
from abundix.session import build_session  # noqa: E402
from compare import connect, difference  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = "sql"
            else:
                problem, note = None, f"rows only, {df.count()}"
        except Exception as error:  # report every query
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", "error"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s [{note}] {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
