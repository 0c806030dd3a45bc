"""The command line: introspect, propose, validate-mapping, dry-run, migrate, validate and reshape.

Collections are files in a folder (--source), the target a versioned store (--target) whose tables a DDL file describes (--ddl).
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.keys import NAMESPACE
from docweave.plans.catalog import Catalog, CatalogError, parse_ddl
from docweave.plans.mapping import MappingError, collection_issues, dump_mapping, field_issues, load_mapping, structure_issues
from docweave.sources.collections import Collections, external_id_maps, from_folder, redacted


def session() -> SparkSession:
    return SparkSession.builder.appName("docweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def catalog(args: argparse.Namespace) -> Catalog | None:
    return parse_ddl(Path(args.ddl).read_text(encoding="utf-8")) if args.ddl else None


def variants(df: DataFrame) -> DataFrame:
    """Documents as variants, for profiles."""
    return df if "doc" in df.columns and len(df.columns) == 2 else df.select(F.to_variant_object(F.struct("*")).alias("doc"))


def profiles(sources: Collections, names: list[str] | None, size: int | None) -> list:
    from docweave.operators.profile import profile

    return [profile(n, variants(sources.read(n)), size=size) for n in names or sources.names()]


def entity_profiles(sources: Collections, mapping, size: int | None) -> dict:
    """A profile of each entity's own documents, its filter applied."""
    from docweave.operators.compile import as_document, matches
    from docweave.operators.profile import profile

    out = {}
    for name, e in mapping.entities.items():
        docs = as_document(sources.read(e.source))
        kind = docs.schema["_doc"].dataType
        docs = docs.filter(matches(F.col("_doc"), kind, e.filter.field, e.filter.equals)) if e.filter else docs
        doc = F.col("_doc") if kind.typeName() == "variant" else F.to_variant_object("_doc")
        out[name] = profile(name, docs.select(doc.alias("doc")), size=size)
    return out


def introspect(args: argparse.Namespace, sources: Collections) -> int:
    found = {"collections": [asdict(p) for p in profiles(sources, args.collection, args.sample)]}
    if args.ddl:
        c = catalog(args)
        found["tables"] = {n: asdict(t) for n, t in c.tables.items()}
        found["load_order"] = c.load_order()
    text = json.dumps(found, indent=2, default=str)
    Path(args.out).write_text(text, encoding="utf-8") if args.out else print(text)
    return 0


def propose(args: argparse.Namespace, sources: Collections) -> int:
    from docweave.plans.propose import propose as proposed

    made = proposed(profiles(sources, args.collection, args.sample), catalog(args))
    dump_mapping(made.mapping, args.out)
    for n in made.notes:
        print(f"{n.entity}.{n.field}: {n.message}" if n.field else f"{n.entity}: {n.message}")
    return 0


def validate_mapping(args: argparse.Namespace, sources: Collections | None) -> int:
    mapping = load_mapping(args.mapping)
    issues = structure_issues(mapping)
    if sources is not None:
        issues += collection_issues(mapping, sources.names())
        for name, p in entity_profiles(sources, mapping, args.sample).items():
            issues += field_issues(name, mapping.entities[name], [f["path"] for f in p.fields])
    for i in issues:
        print(f"{i.severity}: {i.where}: {i.message}")
    return int(any(i.severity == "error" for i in issues))


def dry_run(args: argparse.Namespace, sources: Collections) -> int:
    from docweave.operators.dryrun import dry_run as run

    mapping = load_mapping(args.mapping)
    external = external_id_maps(sources.spark, mapping.external_databases) if mapping.external_databases else None
    report = run(mapping, sources, catalog(args), args.scratch, external, args.namespace, args.sample, args.force)
    for v in report.violations:
        print(f"{v.severity}: {v.entity} {v.source_id or ''} {v.field}: {v.message}")
    print(f"layers {report.layers}: {'clean' if report.ok else 'not clean'}{' (cut short)' if report.truncated else ''}")
    return int(not report.ok)


def migrate(args: argparse.Namespace, sources: Collections, ask: Callable[[str], str] = input) -> int:
    from docweave.sources.store import Store
    from docweave.streaming.load import Progress, chosen, load

    mapping = load_mapping(args.mapping)
    order = chosen(mapping, args.only)
    if args.mode == "truncate" and not args.yes:
        tables = sorted({t for e in order for t in mapping.entities[e].tables()})
        if ask(f"This empties {', '.join(tables)}. Type yes to go on: ").strip() != "yes":
            print("nothing was changed")
            return 1
    store = Store(sources.spark, args.target, catalog(args))
    summary = load(mapping, sources, store, args.mode, args.only, args.namespace, args.batch_size, Progress(print))
    for name, r in summary.entities.items():
        print(f"{name}: {r.status}; rows {r.rows}; nulled {r.nulled}; skipped {r.skipped}")
    return 0


def validate(args: argparse.Namespace, sources: Collections) -> int:
    from docweave.operators.reconcile import reconcile
    from docweave.sources.store import Store

    report = reconcile(load_mapping(args.mapping), sources, Store(sources.spark, args.target, catalog(args)), args.namespace, args.sample or None)
    for c in report.counts:
        print(f"{'ok  ' if c.matches else 'DIFF'} {c.entity} {c.table}: source {c.source}, left out {c.expected_skip}, target {c.target}")
    for v in report.values:
        print(f"DIFF {v.entity} {v.source_id} {v.field}: {v.source!r} became {v.target!r}")
    for f in report.fields:
        print(f"DIFF {f.entity} {f.field}: {f.n} in all{', of which only the first are listed' if f.truncated else ''}")
    for d in report.dangling:
        print(f"info {d.entity} {d.field}: {d.n_values} values without a row, on {d.n_rows} documents")
    return int(not report.ok)


def reshape(args: argparse.Namespace, sources: Collections) -> int:
    from docweave.operators.fanin import pick_one
    from docweave.operators.fanin import reshape as reshaped

    spark, df = sources.spark, sources.read(args.collection)
    if args.sql:
        df.createOrReplaceTempView("source")
        made = lambda x: spark.sql(args.sql)
    elif not (args.by and args.order):
        raise ValueError("reshape needs --by and --order, or --sql")
    else:
        made = lambda x: pick_one(x, args.by.split(","), args.order, not args.earliest, args.where)
    if args.preview:
        made(df).limit(args.preview).show(truncate=False)
        return 0
    old = spark.read.parquet(args.dest) if args.output == "merge" and args.dest else None
    out = reshaped(df, made, old, args.output, args.on.split(",") if args.on else None)
    # A merge reads what it replaces, so the result goes to a new folder first. What was there is moved aside until the new one is in its place.
    draft, aside = f"{args.dest}.new", f"{args.dest}.old"
    out.write.mode("overwrite").parquet(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(args.dest).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(path(args.dest))
    if had:
        fs.delete(path(aside), True)
        if not fs.rename(path(args.dest), path(aside)):
            raise OSError(f"{args.dest} can't be replaced; the result is in {draft}")
    if not fs.rename(path(draft), path(args.dest)):
        raise OSError(f"the result is in {draft}" + (f", and what was there in {aside}" if had else ""))
    if had:
        fs.delete(path(aside), True)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docweave", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *flags: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--source", required="optional source" not in flags)
        c.add_argument("--ddl", required="ddl" in flags)
        c.add_argument("--sample", type=int)
        c.add_argument("--namespace", default=NAMESPACE)
        if "mapping" in flags:
            c.add_argument("--mapping", required=True)
        if "target" in flags:
            c.add_argument("--target", required=True)
        return c

    for name, run, need in (("introspect", introspect, ""), ("propose", propose, "ddl")):
        c = command(name, run, need)
        c.add_argument("--collection", action="append")
        c.add_argument("--out", required=name == "propose")
    command("validate-mapping", validate_mapping, "mapping", "optional source")
    c = command("dry-run", dry_run, "mapping")
    c.add_argument("--scratch")
    c.add_argument("--force", action="store_true")
    c = command("migrate", migrate, "mapping", "target", "ddl")
    c.add_argument("--mode", required=True, choices=("truncate", "append", "upsert"))
    c.add_argument("--only", action="append")
    c.add_argument("--batch-size", type=int)
    c.add_argument("--yes", action="store_true")
    command("validate", validate, "mapping", "target")
    c = command("reshape", reshape)
    for flag in ("--collection", "--dest"):
        c.add_argument(flag, required=True)
    for flag in ("--by", "--order", "--where", "--on", "--sql"):
        c.add_argument(flag)
    c.add_argument("--earliest", action="store_true")
    c.add_argument("--output", choices=("out", "merge"), default="out")
    c.add_argument("--preview", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        sources = from_folder(session(), args.source) if args.source else None
        return args.run(args, sources)
    except (MappingError, CatalogError, ValueError, KeyError, RuntimeError, FileNotFoundError) as e:
        print(f"error: {redacted(str(e).splitlines()[0] if str(e) else repr(e))}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
