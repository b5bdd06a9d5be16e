"""python -m siltlog --path FOLDER: a store with its HTTP front, until interrupted."""

from __future__ import annotations

import argparse
import sys
import threading

from siltlog.store import Store, StoreConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltlog", description="A store of one keyspace with an HTTP front.")
    p.add_argument("--path", required=True, help="folder of the store, on any file system that Spark reads")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--sync", choices=("always", "group", "manual"), default="group")
    p.add_argument("--group-size", type=int, default=100)
    p.add_argument("--memtable-bytes", type=int, default=4 * 1024 * 1024)
    p.add_argument("--compaction-threshold", type=int, default=4)
    p.add_argument("--no-compaction", action="store_true")
    p.add_argument("--tcp-port", type=int, help="also take streaming puts there")
    p.add_argument("--replica", action="store_true", help="refuse writes that don't come from a primary")
    p.add_argument("--follow", metavar="FOLDER", help="be a replica of the store in that folder")
    p.add_argument("--name", default="replica", help="the name that the primary knows this replica by")
    p.add_argument("--every", type=float, default=3.0, help="seconds between two looks at the primary's log")
    return p


def config(args: argparse.Namespace) -> StoreConfig:
    return StoreConfig(
        memtable_bytes=args.memtable_bytes,
        sync=args.sync,
        group_size=args.group_size,
        compaction_threshold=args.compaction_threshold,
        compact=not args.no_compaction,
        read_only=args.replica or args.follow is not None,
    )


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from siltlog.sources import http, tcp
    from siltlog.streaming.ingest import catch_up

    spark = SparkSession.builder.appName("siltlog").getOrCreate()
    stop = threading.Event()
    with Store(spark, args.path, config(args)) as store:

        def look() -> None:
            """Until the end: opens the primary for reading and catches up; a fault is tried again."""
            while not stop.wait(args.every):
                try:
                    with Store(spark, args.follow, StoreConfig(read_only=True, compact=False)) as primary:
                        catch_up(primary, store, args.name)
                except Exception as e:  # noqa: BLE001  the primary may be away
                    print(f"replication: {e}", file=sys.stderr)

        servers = [http.serve(store, args.port, store.replication_status)]
        if args.tcp_port is not None:
            servers.append(tcp.serve(store, args.tcp_port))
        threads = [threading.Thread(target=s.serve_forever, daemon=True) for s in servers]
        if args.follow:
            threads.append(threading.Thread(target=look, daemon=True))
        for t in threads:
            t.start()
        try:
            stop.wait()
        except KeyboardInterrupt:
            pass
        # no more requests first, then replication, then the store
        for s in servers:
            s.shutdown()
            s.server_close()
        stop.set()
        for t in threads:
            t.join()


if __name__ == "__main__":
    main()
