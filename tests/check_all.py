"""Run queries against their SQL checks: ``python -m tests.check_all <folder> [name ...]``."""

from __future__ import annotations

import sys
import time

import __spark_entry__ as contract
from tests.compare import connect, difference
from tests.session import local_session


def main(sf_dir: str, wanted: list[str]) -> int:
    spark = local_session()
    db = connect(sf_dir)
    checks = contract.oracle_sql()
    failures = 0
    for name, build in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.perf_counter()
        try:
            df = build(spark, sf_dir)
            if name in checks:
                verdict = difference(df, db, checks[name])
            else:
                n = len(df.collect())
                verdict = None if n else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failures += verdict is not None
        seconds = time.perf_counter() - start
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {seconds:.2f}s {verdict or ''}",
              flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
