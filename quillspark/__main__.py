"""``python -m quillspark``: status, coverage, query and import on a project folder."""

from __future__ import annotations

import argparse
import json

from quillspark.api import import_documents, open_project
from quillspark.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    parser.add_argument("--master", default="local[*]")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("status", "coverage", "networks"):
        commands.add_parser(name).add_argument("project")
    q = commands.add_parser("query")
    q.add_argument("project")
    q.add_argument("sql")
    i = commands.add_parser("import")
    i.add_argument("file")
    args = parser.parse_args(argv)
    spark = session(master=args.master)
    if args.command == "import":
        out = [r.asDict() for r in import_documents(spark, args.file).collect()]
    else:
        project = open_project(spark, args.project)
        out = {"status": project.stages, "coverage": project.coverage, "networks": project.networks, "query": lambda: project.query(args.sql)}[args.command]()
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
