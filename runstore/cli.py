"""A small shell: get, put, delete, scan, fill, quit."""

from __future__ import annotations

import argparse
import cmd
import shlex

from runstore.functions.bounds import Bound
from runstore.schema import StoreOptions
from runstore.store import KVStore


class Shell(cmd.Cmd):
    prompt = "$ "

    def __init__(self, store: KVStore, **options):
        super().__init__(**options)
        self.store = store

    def onecmd(self, line: str) -> bool:
        try:
            return bool(super().onecmd(line))
        except Exception as e:  # errors are shown, the shell goes on
            self.stdout.write(f"error: {e}\n")
            return False

    def emptyline(self) -> bool:
        return False

    def _args(self, line: str, least: int, most: int) -> list[str]:
        args = shlex.split(line)
        if not least <= len(args) <= most:
            raise ValueError(f"{least} to {most} arguments expected")
        return args

    def do_get(self, line: str) -> None:
        """get KEY"""
        (key,) = self._args(line, 1, 1)
        if (value := self.store.get(key)) is not None:
            self.stdout.write(f"{key}={value.decode(errors='replace')}\n")

    def do_put(self, line: str) -> None:
        """put KEY VALUE"""
        self.store.put(*self._args(line, 2, 2))

    def do_delete(self, line: str) -> None:
        """delete KEY"""
        self.store.delete(*self._args(line, 1, 1))

    def do_scan(self, line: str) -> None:
        """scan [LOWER] [UPPER] [--versions]: both bounds included"""
        args = shlex.split(line)
        versions = "--versions" in args
        args = self._args(shlex.join(a for a in args if a != "--versions"), 0, 2)
        bounds = [Bound.included(a) for a in args] + [Bound.unbounded()] * (2 - len(args))
        rows = self.store.scan_versions(*bounds) if versions else self.store.scan(*bounds)
        for r in rows.toLocalIterator():
            self.stdout.write(f"{bytes(r['key']).decode(errors='replace')}={bytes(r['value']).decode(errors='replace')}\n")

    def do_fill(self, line: str) -> None:
        """fill LOWER UPPER"""
        self.store.fill(*map(int, self._args(line, 2, 2)))

    def do_quit(self, line: str) -> bool:
        """quit"""
        self.store.close()
        return True

    do_EOF = do_quit


def main() -> None:
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("path", nargs="?", default=StoreOptions.path)
    spark = SparkSession.builder.appName("runstore").getOrCreate()
    Shell(KVStore.open(spark, StoreOptions(path=parser.parse_args().path))).cmdloop()


if __name__ == "__main__":
    main()
