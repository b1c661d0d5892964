"""Compare column types of every question with those of its SQL, without running the batch jobs."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tools.oracle_check import connect  # noqa: E402

SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def main() -> None:
    from rillbook.plans.registry import load_all
    from rillbook.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session(8), connect(sf_dir)
    for name, q in load_all().items():
        if (prefixes and not name.startswith(prefixes)) or q.sql is None:
            continue
        got = dict(q.run(spark, sf_dir).dtypes)
        want = {r[0]: r[1] for r in con.execute("DESCRIBE " + q.oracle()).fetchall()}
        bad = {c: (t, want.get(c)) for c, t in got.items() if SAME.get(t, t) != want.get(c)}
        if bad:
            print(name, bad, flush=True)
    print("done")


if __name__ == "__main__":
    main()
