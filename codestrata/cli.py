"""Command line: analyse a source tree into chunks and, with a store, into the code graph."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codestrata import __version__, api, settings
from codestrata.operators import importing
from codestrata.schema import NODE, REL
from codestrata.session import build_session
from codestrata.sources import files, store


def analyze(spark: SparkSession, root: str, project_id: str, branch: str = "main", targets: list[str] | None = None, language: str = "java", configurations: bool = False):
    """Chunks of the language's files below `root`, and of whole configuration files where asked."""
    chosen = api.analyzer(language)
    found = files.only_targets(files.source_files(spark, root, chosen.pattern), targets or [], parse_all=not targets).withColumn("file_id", F.xxhash64("file_path"))
    out = chosen.chunks(found, project_id, branch)
    if configurations:
        whole = files.only_targets(files.source_files(spark, root, "*.{" + ",".join(files.CONFIGURATIONS) + "}"), targets or [], parse_all=not targets)
        out = out.unionByName(files.configuration_chunks(whole, project_id, branch))
    return out


def parser(given: settings.Settings = settings.Settings()) -> argparse.ArgumentParser:
    """The options of `analyze`; settings are their defaults."""
    p = argparse.ArgumentParser("codestrata")
    p.add_argument("--version", action="version", version=__version__)
    a = p.add_subparsers(dest="command", required=True).add_parser("analyze")
    a.add_argument("project_path")
    a.add_argument("-l", "--language", choices=sorted(api.ANALYZERS), default="java")
    a.add_argument("-p", "--project-id", required=True)
    a.add_argument("-b", "--branch", default="main")
    a.add_argument("-o", "--output", help="folder for chunks as JSON lines")
    a.add_argument("--store", default=given.store, help="folder of the graph's snapshots")
    a.add_argument("--skip-store", action="store_true", help="leave the graph alone, even if settings name a store")
    a.add_argument("--batch-size", type=int, default=given.batch_size, help="chunks of a file, at most")
    a.add_argument("--main-branch", default=given.main_branch)
    a.add_argument("--base-branch", default=given.base_branch)
    for name in ("--pull-request-id", "--version", "--base-version"):
        a.add_argument(name)
    a.add_argument("--configurations", action="store_true", help="make chunks of SQL, YAML and XML files too")
    a.add_argument("--targets", nargs="*", help="only files whose path ends with one of these")
    a.add_argument("-v", "--verbose", action="store_true")
    return p


def faults(given: argparse.Namespace) -> list[str]:
    """What keeps the command from running."""
    out = []
    if "://" not in given.project_path and not os.path.isdir(given.project_path):
        out.append(f"{given.project_path} is no folder")
    if not given.output and (given.skip_store or not given.store):
        out.append("neither an output nor a store is given")
    if given.batch_size < 0:
        out.append("the batch size is below 0")
    return out


def main(arguments: list[str] | None = None) -> int:
    """Runs the command; 0 if it went well."""
    given = parser(settings.read()).parse_args(arguments)
    wrong = faults(given)
    if wrong:
        print("; ".join(wrong), file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.INFO if given.verbose else logging.WARNING)
    spark = SparkSession.getActiveSession() or build_session()
    found = analyze(spark, given.project_path, given.project_id, given.branch, given.targets, given.language, given.configurations).persist()
    if given.output:
        files.write_chunks(found, given.output, given.batch_size)
    if given.store and not given.skip_store:
        try:
            old = store.load(spark, given.store)
        except Exception as fault:
            if "PATH_NOT_FOUND" not in str(fault):
                raise
            old = importing.Store(spark.createDataFrame([], NODE), spark.createDataFrame([], REL))
        options = importing.Options(given.main_branch, given.base_branch, given.pull_request_id, given.version, given.base_version)
        made = importing.import_incremental(old, found, options)
        print("snapshot", store.save(spark, made, given.store))
        logging.getLogger("codestrata").info("import: %s", {r.what: r.rows for r in made.counts.collect()} if given.verbose else "")
    print("chunks", found.count())
    return 0
