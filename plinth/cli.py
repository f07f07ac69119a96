"""python -m plinth.cli ingest|ask|sources|serve"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from plinth.plans.engine import Engine
from plinth.runtime import ship_package
from plinth.service import serve
from plinth.settings import Settings


#: Settings that options take the place of.
OPTIONS = {"index_path": "index_path", "pdf_workers": "pdf_workers", "embedding_batch_size": "embed_batch_size", "ocr_scanned": "ocr_scanned"}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plinth")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("--path")
    ingest.add_argument("--force", action="store_true")
    ingest.add_argument("--no-resume", action="store_true")
    ingest.add_argument("--failed-only", action="store_true")
    ingest.add_argument("--max-files", type=int)
    ingest.add_argument("--pdf-workers", type=int)
    ingest.add_argument("--embed-batch-size", type=int)
    ingest.add_argument("--ocr-scanned", action="store_true", default=None, help="accepted and unused")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--answer-mode")
    ask.add_argument("--filter", action="append", default=[], metavar="KEY=VALUE")
    commands.add_parser("sources")
    serving = commands.add_parser("serve")
    serving.add_argument("--host", default="127.0.0.1")
    serving.add_argument("--port", type=int, default=8000)
    serving.add_argument("--ingest", action="store_true", help="build a missing index in the background")
    for one in commands.choices.values():
        one.add_argument("--index-path")
    given = parser.parse_args(args)
    ship_package()
    engine = Engine(SparkSession.builder.appName("plinth").getOrCreate(), Settings.from_env().but(**{k: getattr(given, v, None) for k, v in OPTIONS.items()}))
    if given.command == "ingest":
        out = engine.ingest(given.path, given.force, not given.no_resume, given.failed_only, given.max_files)
    elif given.command == "ask":
        out = engine.ask(given.question, given.top_k, dict(f.split("=", 1) for f in given.filter), given.answer_mode)
    elif given.command == "serve":
        serve(engine, given.host, given.port, given.ingest)
        return 0
    else:
        out = [r.asDict() for r in engine.sources().collect()]
    print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
