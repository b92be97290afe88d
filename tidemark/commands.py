"""Commands by name: functions from a session and a folder of tables to a DataFrame, for scripts and notebooks."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import registry

#: Command -> the registered query that answers it.
COMMANDS = {
    "fs list": "x01_list_filesystems",
    "fs describe": "a06_statfs",
    "fs create": "x02_create_slot",
    "fs check": "x03_fsck",
    "fs repair": "x03_repairs",
    "fs resize": "x02_master_changes",
    "fs archive": "x02_master_changes",
    "fs prune": "x02_master_changes",
    "fs dedupe": "a02_dedupe_report",
    "names list": "o07_names_order",
    "names create": "m07_named_versions",
    "names delete": "m07_name_removal",
    "trash list": "o04_trash_page",
    "trash restore": "m05_restore_batch",
    "trash undo": "m14_undo_pass",
    "history list": "w01_as_of_pick",
    "history versions": "w04_version_list",
    "sync plan": "j07_sync_plan_two_way",
}


def command(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The command's function; a name that isn't known raises KeyError with those that are."""
    if name not in COMMANDS:
        raise KeyError(f"no command {name!r}; there are: {', '.join(sorted(COMMANDS))}")
    return registry.queries()[COMMANDS[name]]


def run(spark: SparkSession, argv: list[str]) -> Iterator[str]:
    """JSON lines of a command: its words, --data FOLDER, and perhaps --where CONDITION, --columns A,B and --limit N."""
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("words", nargs="+", help="; ".join(sorted(COMMANDS)))
    parser.add_argument("--data", required=True)
    parser.add_argument("--where")
    parser.add_argument("--columns")
    parser.add_argument("--limit", type=int)
    got = parser.parse_args(argv)
    rows = command(" ".join(got.words))(spark, got.data)
    if got.where:
        rows = rows.where(got.where)
    if got.columns:
        rows = rows.select(*got.columns.split(","))
    if got.limit is not None:
        rows = rows.limit(got.limit)
    return (row[0] for row in rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator())
