"""python -m sparkfold upload|download|reports STORE ...: files in and out of a reduction store."""

from __future__ import annotations

import argparse
import json


def main() -> None:
    from pyspark.sql import SparkSession

    from .plans.backup import download, upload
    from .plans.reports import write_logs
    from .plans.store import POLICIES, Options, Store

    parser = argparse.ArgumentParser(prog="sparkfold", description=__doc__)
    parser.add_argument("--policy", choices=POLICIES, default="adaptive")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {"upload": ("store", "path"), "download": ("store", "backup", "target"), "reports": ("store", "target")}.items():
        command = commands.add_parser(name)
        for a in arguments:
            command.add_argument(a)
        if name == "upload":
            command.add_argument("--no-offline", action="store_true")
    args = parser.parse_args()
    store = Store(SparkSession.builder.appName("sparkfold").getOrCreate(), args.store, Options(policy=args.policy))
    if args.command == "upload":
        print(json.dumps(upload(store, args.path, offline=not args.no_offline)))
    elif args.command == "download":
        print(json.dumps(download(store, args.backup, args.target)))
    else:
        write_logs(store, args.target)


if __name__ == "__main__":
    main()
