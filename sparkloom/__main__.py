"""python -m sparkloom index PATH DIRECTORY | search PATH WORDS... | info PATH | status PATH | folders PATH | doctor PATH | compact PATH"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from .plans.engine import Engine
from .schemas import DONE
from .session import session


def doctor(engine: Engine) -> int:
    """Checks that the tables are there and agree; prints what is wrong and says so by its result."""
    wrong = []
    if engine.health() == "unhealthy":
        wrong.append("there is no index")
    else:
        chunks, embeddings = engine.table("chunks"), engine.table("embeddings")
        if missing := chunks.join(embeddings, "chunk_id", "left_anti").count():
            wrong.append(f"{missing} chunks have no vector")
        if lost := chunks.join(engine.table("documents").select("id"), chunks["doc_id"] == F.col("id"), "left_anti").count():
            wrong.append(f"{lost} chunks have no document")
        unfinished = {k: v for k, v in engine.status()["states"].items() if k != DONE}
        if unfinished:
            wrong.append(f"files not indexed: {unfinished}")
    print(json.dumps({"ok": not wrong, "problems": wrong}))
    return 1 if wrong else 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "info", "remove", "status", "folders", "doctor", "compact", "import-mail"):
        sub = commands.add_parser(name)
        sub.add_argument("path", help="folder of the index")
        if name in ("index", "remove", "import-mail"):
            sub.add_argument("directory")
        if name == "search":
            sub.add_argument("words", nargs="+")
            sub.add_argument("--limit", type=int, default=10)
            sub.add_argument("--type")
            sub.add_argument("--folder")
            sub.add_argument("--sort", default="relevance")
    given = parser.parse_args(arguments)
    engine = Engine(session(), given.path)
    if given.command == "index":
        print(json.dumps(engine.index_path(given.directory, time.time())))
    elif given.command == "import-mail":
        print(json.dumps(engine.import_mail(given.directory, time.time())))
    elif given.command == "remove":
        print(json.dumps({"version": engine.remove(folder=given.directory)}))
    elif given.command == "info":
        print(json.dumps({"health": engine.health(), **engine.info()}))
    elif given.command == "status":
        print(json.dumps(engine.status()))
    elif given.command == "folders":
        print(json.dumps(engine.folders()))
    elif given.command == "compact":
        engine.compact()
        print(json.dumps({"bytes": engine.store.size()}))
    elif given.command == "doctor":
        return doctor(engine)
    else:
        found = engine.search(" ".join(given.words), given.limit, now=time.time(), types=given.type, folder=given.folder, sort=given.sort)
        for row in found.select("path", "score", "snippets").collect():
            snippet = row["snippets"][0]["text"] if row["snippets"] else ""
            print(json.dumps({"path": row["path"], "score": row["score"], "snippet": snippet}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
