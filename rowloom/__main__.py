"""``python -m rowloom``: runs a program file, a text, or lines as they are typed."""

from __future__ import annotations

import argparse
import sys

from .reporter import Reporter


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rowloom", description="Runs statistical step programs on Spark.")
    p.add_argument("file", nargs="?", help="program file")
    p.add_argument("-e", "--execute", metavar="TEXT", help="run this text")
    p.add_argument("-i", "--interactive", action="store_true", help="read programs from the terminal; a line with 'run;' or 'quit;' runs what was typed")
    p.add_argument("--workdir", help="folder of the USER library and of relative paths")
    p.add_argument("--format", choices=("parquet", "csv", "xport"), default="parquet", help="how the USER library keeps its datasets")
    p.add_argument("--encoding", default="utf-8")
    p.add_argument("--quiet", action="store_true", help="warnings and errors only")
    p.add_argument("--fail-fast", action="store_true", help="stop after the first step with an error or warning")
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    p.add_argument("--profile-file", help="Python file with functions in PROFILES that change a program's text")
    p.add_argument("--master", help="Spark master, if none is configured")
    p.add_argument("--version", action="store_true")
    return p


def profiles_of(path: str | None) -> list:
    if not path:
        return []
    import runpy

    return list(runpy.run_path(path)["PROFILES"])


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: all steps ran; 1: a step failed, or (with --fail-fast) warned."""
    a = arguments().parse_args(argv)
    if a.version:
        from . import __version__

        print(f"rowloom {__version__}")
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        builder = SparkSession.builder.appName("rowloom")
        spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    from .plans.session import Engine

    reporter = Reporter(color={"always": True, "never": False}.get(a.color), quiet=a.quiet, stop_on=("error", "warning") if a.fail_fast else ())
    engine = Engine(spark, a.workdir, fail_fast=False, profiles=profiles_of(a.profile_file), reporter=reporter)
    if a.workdir:
        engine.execute(f"libname user {'' if a.format == 'parquet' else a.format} '{a.workdir}';")
    try:
        if a.execute is not None:
            ok = engine.execute(a.execute).ok
        elif a.file and not a.interactive:
            ok = engine.execute_file(a.file, a.encoding).ok
        else:
            if a.file:
                engine.execute_file(a.file, a.encoding)
            ok = _typed(engine)
    except OSError as e:
        reporter.say("error", str(e))
        ok = False
    reporter.say("note", reporter.summary())
    return 0 if ok and not reporter.stops else 1


def _typed(engine) -> bool:
    held: list[str] = []
    for line in sys.stdin:
        held.append(line)
        if line.strip().lower().endswith(("run;", "quit;")):
            engine.execute("".join(held))
            held = []
    return engine.execute("".join(held)).ok if held else True


if __name__ == "__main__":
    sys.exit(main())
