"""python -m adit QUERY FOLDER [TARGET]: run a registered query over a folder of tables, and show or write its rows."""

from __future__ import annotations

import sys

from adit.plans import domain, problems
from adit.runtime import clear, local_session


def main(args: list[str]) -> int:
    queries = {**domain.QUERIES, **problems.QUERIES}
    if not 2 <= len(args) <= 3 or args[0] not in queries:
        print(__doc__)
        print("queries:", *sorted(queries))
        return 2
    spark = local_session(app=args[0])
    rows = queries[args[0]](spark, args[1])
    if len(args) == 3:
        rows.write.mode("overwrite").parquet(args[2])
    else:
        rows.show(50, truncate=80)
    clear(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
