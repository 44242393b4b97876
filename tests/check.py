"""Compare named queries with their SQL: python tests/check.py [sf] [name ...]"""

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, duck  # noqa: E402
from tidewell.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, db = local_session(), duck(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, folder).toArrow()
            took = time.time() - start
            if name in sql:
                problem = compare(got, db.sql(sql[name]).to_arrow_table())
            else:
                problem = None if got.num_rows else "no rows"
            verdict = problem or ("ok" if name in sql else "rows only")
        except Exception as error:  # report and go on
            problem, took = "error", time.time() - start
            verdict = f"error: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problem)
        print(f"{name:26} {took:6.2f}s {got.num_rows if not str(verdict).startswith('error') else '-':>8} {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
