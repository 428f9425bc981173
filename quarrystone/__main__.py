"""python -m quarrystone COMMAND FOLDER [ARGUMENT]: one analysis of a source tree as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from quarrystone.operators import graph
from quarrystone.project import Project
from quarrystone.session import build_session
from quarrystone.sinks import render

COMMANDS = {
    "files": lambda p, _: p.files, "symbols": lambda p, _: p.symbols, "imports": lambda p, _: p.resolved, "graph": lambda p, _: p.edges, "dead": lambda p, _: p.dead_exports(), "orphan-types": lambda p, _: graph.orphan_types(p.symbols, p.edges),
    "surface": lambda p, _: graph.api_surface(p.symbols), "duplicates": lambda p, _: graph.duplicates(p.symbols), "cycles": lambda p, _: p.cycles(), "coupling": lambda p, _: p.coupling(), "modules": lambda p, _: p.module_coupling(), "layers": lambda p, _: p.layer_violations(),
    "deps": lambda p, _: graph.file_deps(p.edges, p.symbols), "top": lambda p, _: graph.top_symbols(p.edges, p.symbols), "impact": lambda p, a: p.impact(a), "calls": lambda p, _: p.call_graph(), "complexity": lambda p, _: p.complexity(), "smells": lambda p, _: p.smells(),
    "security": lambda p, _: p.security(), "unused-params": lambda p, _: p.unused_params(), "similar": lambda p, _: p.similar(), "find": lambda p, a: p.find(a), "tests": lambda p, _: p.test_map(), "report": lambda p, _: p.metrics(), "fix": lambda p, _: p.fixes(),
    "explain": lambda p, a: p.explain(a), "pack": lambda p, a: p.pack(a), "doc": lambda p, _: render.api_docs(p.symbols), "testgen": lambda p, a: render.test_stubs(p.symbols, a or "pytest"), "trace-type": lambda p, a: p.relations.type_refs.where(f"type_name = '{(a or '').replace(chr(39), '')}'"),
    "check": lambda p, a: p.gate(json.loads(a or "{}")),
}


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser("quarrystone", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("folder")
    parser.add_argument("argument", nargs="?")
    args = parser.parse_args(argv)
    spark = build_session()
    rows = COMMANDS[args.command](Project(spark, args.folder), args.argument)
    for r in render.json_rows(rows).toLocalIterator():
        print(r["json"])
    return int(args.command == "check" and not rows.isEmpty())


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
