"""Command line: python -m quillspark.cli COMMAND ROOT [...]"""

from __future__ import annotations

import argparse
import json

from .functions.analysis import standard_analyser
from .session import session, ship
from .sources.store import Store


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspark", description="Care for a store.")
    p.add_argument("command", choices=["check", "inspect", "backup", "restore", "size", "compact", "rollback", "compat", "migrate"])
    p.add_argument("root")
    p.add_argument("--at", help="folder of a backup")
    p.add_argument("--fields", default="text", help="analysed fields, separated by commas")
    p.add_argument("--shallow", action="store_true", help="check manifests and file sizes only")
    p.add_argument("--partitions", type=int, default=8)
    a = p.parse_args(args)
    spark = ship(session("quillspark-cli"))
    store = Store(spark, a.root, {f: standard_analyser() for f in a.fields.split(",")})
    match a.command:
        case "check":
            found = store.check(deep=not a.shallow)
            print(json.dumps([{"code": c, "message": m} for c, m in found]))
            return int(bool(found))
        case "inspect":
            print(json.dumps(store.inspect()))
        case "backup":
            print(store.backup(a.at))
        case "restore":
            print(store.restore(a.at))
        case "size":
            print(json.dumps([r.asDict() for r in store.size().collect()]))
        case "compact":
            print(store.compact(a.partitions))
        case "rollback":
            print(json.dumps(store.rollback()))
        case "compat":
            print(json.dumps(store.compat()))
        case "migrate":
            print(store.migrate())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
