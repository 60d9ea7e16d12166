"""python -m lakecairn PATH init | map get KEY | map put [-c] KEY VALUE | map ls [-s START] [-e END] | bytes put FILE | bytes get CID..."""

from __future__ import annotations

import argparse
import sys

from lakecairn.functions.values import path_of
from lakecairn.plans.engine import Engine
from lakecairn.session import build_session


def main(argv: list[str] | None = None, spark=None) -> int:
    top = argparse.ArgumentParser(prog="lakecairn")
    top.add_argument("path")
    top.add_argument("--repo", default="default")
    sub = top.add_subparsers(dest="what", required=True)
    sub.add_parser("init")
    m = sub.add_parser("map").add_subparsers(dest="how", required=True)
    m.add_parser("get").add_argument("key")
    put = m.add_parser("put")
    put.add_argument("-c", "--commit", action="store_true")
    put.add_argument("key")
    put.add_argument("value")
    ls = m.add_parser("ls")
    ls.add_argument("-s", "--start")
    ls.add_argument("-e", "--end")
    b = sub.add_parser("bytes").add_subparsers(dest="how", required=True)
    b.add_parser("put").add_argument("file")
    b.add_parser("get").add_argument("cids", nargs="+")
    args = top.parse_args(argv)
    spark = spark or build_session(master="local[*]")
    if args.what == "init":
        Engine.init(spark, args.path)
        return 0
    engine = Engine.open(spark, args.path)
    if args.what == "map":
        repo = engine.repo(args.repo)
        key = "/".join(map(str, path_of(args.key))) if args.how != "ls" else ""
        if args.how == "get":
            value = repo.get(key)
            print("" if value is None else value)
            return int(value is None)
        if args.how == "put":
            repo.insert(key, args.value)
            print(repo.stage())
            if args.commit:
                repo.commit()
            return 0
        for row in repo.range(args.start, args.end).toLocalIterator():
            print(row.k, row.v)
    elif args.how == "put":
        data = sys.stdin.buffer.read() if args.file == "-" else open(args.file, "rb").read()
        frame = spark.createDataFrame([(0, bytearray(data))], "key bigint, data binary")
        for row in engine.put_bytes(frame, "key", "data").orderBy("pos").collect():
            print(row.cid)
    else:
        for cid in args.cids:
            sys.stdout.buffer.write(engine.blobs.get(cid))
    return 0


if __name__ == "__main__":
    sys.exit(main())
