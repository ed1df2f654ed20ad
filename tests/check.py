"""Command-line check: python tests/check.py [sf] [name-regex]"""
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import compare  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    spark = local_session()
    sql = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if not re.search(pattern, name):
            continue
        try:
            ok, note, sec = compare(spark, f"/root/testdata/sf{sf}", fn, sql.get(name))
        except BaseException as exc:  # noqa: BLE001
            ok, note, sec = False, f"{type(exc).__name__}: {str(exc)[:500]}", -1
        if not ok:
            failed.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} {sec:.1f}s {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
