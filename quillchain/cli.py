"""Command line: build a model from text files, generate from a model, serve both."""

from __future__ import annotations

import argparse
import math
import os
import sys

from . import __version__
from .errors import QuillError


def temperature(text: str) -> float:
    value = float(text)
    if not math.isfinite(value) or value < 0:
        raise argparse.ArgumentTypeError("temperature is finite and not negative")
    return value


def at_least(least: int):
    def parse(text: str) -> int:
        if int(text) < least:
            raise argparse.ArgumentTypeError(f"must be at least {least}")
        return int(text)

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillchain", description="Markov text models on Spark")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--debug", action="store_true", help="show a traceback on errors")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build-db", help="text files to a model folder")
    b.add_argument("--input-dir", required=True)
    b.add_argument("--db", default="markov.db", help="model folder")
    b.add_argument("--order", type=at_least(1), default=2)
    b.add_argument("--mode", "--level", dest="mode", choices=("word", "char", "both"), default="word")
    b.add_argument("--workers", type=at_least(0), default=0, help="local cores; 0: all")
    b.add_argument("--chunk-size-mb", type=at_least(1), default=256, help="largest input split")
    b.add_argument("--batch-size", type=at_least(1000), default=100_000, help="accepted; Spark sizes its own aggregation buffers")
    b.add_argument("--encoding-errors", choices=("strict", "replace", "ignore"), default="strict")
    b.add_argument("--max-paragraph-mb", type=at_least(1), default=16, help="a longer paragraph is cut at the end of a line")
    b.add_argument("--temp-dir", help="Spark's local folder")
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--quiet", action="store_true")
    g = sub.add_parser("generate", help="text from a model")
    g.add_argument("--db", default="markov.db")
    g.add_argument("--mode", "--level", dest="mode", choices=("word", "char"), default="word")
    g.add_argument("--prompt", required=True)
    g.add_argument("--length", type=at_least(1), required=True)
    g.add_argument("--temperature", type=temperature, default=1.0)
    g.add_argument("--seed", type=int)
    w = sub.add_parser("serve", help="the HTTP interface on 127.0.0.1")
    w.add_argument("--port", type=int, default=0)
    w.add_argument("--db", default="markov.db")
    return p


def session(cores: int = 0, split_mb: int = 128, folder: str | None = None):
    """The running session, or a local one (``SPARK_MASTER`` names another)."""
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{cores or '*'}]")).config("spark.sql.files.maxPartitionBytes", f"{split_mb}m").config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false")
    spark = (b.config("spark.local.dir", folder) if folder else b).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Progress:
    """Prints a phase's share done: in place on a terminal, else a line for each tenth."""

    def __init__(self, stream=None):
        self.stream = stream or sys.stderr
        self.terminal, self.last = self.stream.isatty(), None

    def __call__(self, phase: str, done: int, of: int, message: str) -> None:
        share = min(1.0, done / of) if of > 0 else 1.0
        if self.terminal:
            self.stream.write(f"\r{phase:>6} {share:6.1%} {message[:50]:50}" + ("\n" if phase == "done" else ""))
        elif (now := (phase, int(share * 10), message)) != self.last:
            self.last = now
            self.stream.write(f"{phase}: {share:.0%} {message}\n")
        self.stream.flush()


def report_lines(report) -> list[str]:
    from .functions.text import human_bytes

    s = report.stats
    rows = ", ".join(f"{mode}={n:,}" for mode, n in report.transition_rows.items())
    lines = [f"built {report.model_path} from {s['source_files']} files, {human_bytes(s['source_bytes'])}; transition rows: {rows}", f"{s['paragraphs']:,} paragraphs, {s['observations']:,} observations"]
    if s["replacements"]:
        lines.append(f"{s['replacements']:,} replaced UTF-8 sequences")
    return [*report.warnings, *lines]


def run(args: argparse.Namespace) -> None:
    from .operators.generate import Generator
    from .sources.store import BuildConfig, Model, build_model

    if args.command == "serve":
        from .web import serve

        return serve(session(), args.db, args.port)
    if args.command == "build-db":
        spark = session(args.workers, args.chunk_size_mb, args.temp_dir)
        config = BuildConfig(args.input_dir, args.db, args.order, args.mode, args.encoding_errors, args.overwrite, args.max_paragraph_mb << 20)
        report = build_model(spark, config, (lambda *_: None) if args.quiet else Progress())
        if not args.quiet:
            print("\n".join(report_lines(report)), file=sys.stderr)
    else:
        print(Generator(Model(session(), args.db), args.seed).generate(args.mode, args.prompt, args.length, args.temperature))


def serve_main() -> int:
    """The HTTP interface alone, as a console script."""
    return main(["serve", *sys.argv[1:]])


def main(argv: list[str] | None = None) -> int:
    """0 done, 1 a known error, 2 bad arguments, 130 interrupted."""
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8")
    args = parser().parse_args(argv)
    try:
        run(args)
        return 0
    except BrokenPipeError:
        return 0
    except KeyboardInterrupt:
        return 130
    except QuillError as bad:
        if args.debug:
            raise
        print(f"error: {bad}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
