"""Command line: validate, view, metrics, render, export, latex, parse, describe, convert, solve. Files in, text or JSON out."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from modelloom.operators import grouped, metrics, review, taxonomy, templates, views
from modelloom.sources import emit, formats, formulations, instances, latex, latex_rules


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def _text(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8")


def _row(spark, path: str):
    """A document's row: of JSON, or of canonical LaTeX."""
    text = _text(path)
    text = json.dumps(latex.read(text)) if path.endswith(".tex") else text
    return formulations.parse(spark.createDataFrame([(text,)], "value string"))


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def _given(args) -> tuple[dict, dict]:
    cards, params = instances.load(args.instance) if args.instance else ({}, {})
    return cards | {k: int(v) for k, v in (x.split("=", 1) for x in args.card)}, params


def _view(args) -> dict:
    spark = _spark()
    f = _row(spark, args.file)
    if args.view == "ground":
        g = templates.Grounder(spark, f.first(), *_given(args))
        return {"nodes": _rows(g.view()), "edges": _rows(g.edges())}
    edges = views.schema_edges(f) if args.view == "schema" else views.hybrid_edges(f)
    return {"nodes": _rows(views.schema_nodes(f)), "edges": _rows(edges)}


def _model(args):
    fmt = args.source or formats.EXTENSIONS.get(args.file.rpartition(".")[2], "")
    if fmt not in formats.READERS:
        spark = _spark()
        return templates.Grounder(spark, _row(spark, args.file).first(), *_given(args)).model()
    return formats.READERS[fmt](_text(args.file))


def run(args) -> str:
    match args.command:
        case "validate":
            data = sys.stdin.buffer.read() if args.file == "-" else Path(args.file).read_bytes()
            checks = review.review(data, args.source or formats.EXTENSIONS.get(args.file.rpartition(".")[2]))[0]
            return json.dumps({"valid": all(c[1] != "error" for c in checks), "checks": [dict(zip(("stage", "level", "code", "message"), c)) for c in checks]}, indent=1)
        case "view":
            return json.dumps(_view(args), indent=1)
        case "metrics":
            f = _row(_spark(), args.file)
            nodes, edges = views.schema_nodes(f), views.schema_edges(f)
            return json.dumps({"summary": _rows(metrics.summary(nodes, edges)), "counts": _rows(metrics.node_counts(nodes)), "flags": _rows(views.flags(f)), "types": _rows(views.type_counts(f))}, indent=1)
        case "render":
            f = _row(_spark(), args.file)
            return taxonomy.svg(views.schema_nodes(f), views.schema_edges(f)).first()["svg"]
        case "latex":
            return latex.write(_row(_spark(), args.file).first())
        case "parse":
            doc, rewrites, bad = latex_rules.ingest(_text(args.file))
            return json.dumps({"document": doc, "rewrites": [vars(r) for r in rewrites], "failures": bad}, indent=1)
        case "describe":
            return latex.describe(_row(_spark(), args.file).first())
        case "export":
            f = _row(_spark(), args.file).first()
            return {"pyomo-stub": emit.pyomo_stub, "algebra": emit.algebra}[args.target](f) if args.target in ("pyomo-stub", "algebra") else emit.CODE[args.target](_model(args))
        case "convert":
            m = _model(args)
            return json.dumps(instances.to_formulation(m), indent=1) if args.target == "json" else (formats.WRITERS | emit.CODE)[args.target](m)
        case "solve":
            status, value, of = grouped.solve(_model(args), args.seconds)
            return json.dumps({"status": status, "objective": value if status == "optimal" else None, "values": of}, indent=1)
    raise ValueError(args.command)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="modelloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("validate", "view", "metrics", "render", "latex", "parse", "describe", "export", "convert", "solve"):
        p = commands.add_parser(name)
        p.add_argument("file", help="a path, or - for standard input")
        p.add_argument("--source", help="format of the file, if its name doesn't tell")
        p.add_argument("--out", help="a file to write")
        if name in ("view", "export", "convert", "solve"):
            p.add_argument("--card", action="append", default=[], metavar="I=4", help="size of an index")
            p.add_argument("--instance", help="JSON with cardinalities and parameters")
        if name == "view":
            p.add_argument("--view", choices=("schema", "hybrid", "ground"), default="schema")
        if name == "export":
            p.add_argument("--target", choices=("pyomo-stub", "algebra", *emit.CODE), default="algebra")
        if name == "convert":
            p.add_argument("--target", choices=("json", *formats.WRITERS, *emit.CODE), required=True)
        if name == "solve":
            p.add_argument("--seconds", type=float, default=60.0)
    args = top.parse_args(argv)
    try:
        text = run(args)
    except (ValueError, KeyError, OSError, grouped.Unfinished) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if args.out:
        Path(args.out).write_text(text, encoding="utf-8")
    else:
        print(text)
    return 0 if args.command != "validate" or json.loads(text)["valid"] else 1


if __name__ == "__main__":
    sys.exit(main())
