"""Commands: validate, preview, build and verify. One JSON line on standard output; 0 good, 2 bad input, 3 refused."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.canonical import canonical
from .lineage import cut
from .operators import packaging as K
from .operators import planning as P
from .operators import verify as V
from .sources import files
from .sources.config import ConfigurationError, Project, load_config
from .sources.inventory import Inventory, load

GOOD, BAD_INPUT, REFUSED = 0, 2, 3


def _emit(**record) -> None:
    sys.stdout.write(canonical(record).decode() + "\n")


def _checked(spark: SparkSession, project: Project, inventory: Inventory) -> tuple[int, dict]:
    """The plan's figures, or what stands against it."""
    target = P.Target(str(project.output_dir), project.path_limit, K.MASTER if project.create_master else None)
    planned = cut(P.planned_members(inventory.accounts, inventory.attachments, target))
    pairs = cut(P.named_archives(P.indexed(P.archives(inventory.accounts, planned))))
    free = files.free_bytes(str(project.output_dir))
    there = any((project.output_dir / r.filename).exists() for r in pairs.select("filename").toLocalIterator()) or project.create_master and (project.output_dir / K.MASTER).exists()
    if there or P.preflight_violations(planned, pairs, target, free).head(1):
        return REFUSED, {"status": "PREFLIGHT_FAILURE"}
    bound = P.plan_bound(pairs, project.create_master).first()
    return GOOD, {"archive_count": bound.archive_count, "member_count": bound.member_count, "required_bytes": bound.required_bytes, "free_bytes": free, "max_path_chars": P.max_path_units(planned, pairs, target).first()[0]}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "preview", "build", "verify"):
        command = commands.add_parser(name)
        command.add_argument("config")
        if name == "build":
            command.add_argument("--resume", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("foliospark").getOrCreate()
    try:
        project = load_config(args.config)
        inventory = load(spark, str(project.inventory))
        first = inventory.violations.orderBy("priority", "line_no").first()
    except (ConfigurationError, OSError):
        first = True
    except Exception as e:  # Spark's own errors for files that cannot be read
        if "PATH_NOT_FOUND" not in str(e):
            raise
        first = True
    if first:
        known = {} if first is True else {"rule": first.rule, "line": first.line_no}
        _emit(status="INVALID_INPUT", **known)
        return BAD_INPUT
    if args.command in ("validate", "preview"):
        code, found = _checked(spark, project, inventory)
        if code == GOOD and args.command == "validate":
            target = P.Target(str(project.output_dir), project.path_limit, K.MASTER if project.create_master else None)
            planned = cut(P.planned_members(inventory.accounts, inventory.attachments, target))
            issues = files.inspect(planned, str(project.source_root), project.max_workers).filter("issue IS NOT NULL")
            if issues.filter("issue <> 'pdf_unchecked'").head(1):
                code, found = REFUSED, {"status": "INTEGRITY_FAILURE"}
            elif unchecked := issues.count():
                found["pdf_unchecked"] = unchecked
        _emit(**{"status": "VALID" if args.command == "validate" else "READY", **found})
        return code
    if args.command == "build":
        try:
            summary = K.build(spark, project, inventory, args.resume)
        except (K.BuildError, OSError):
            _emit(status="BUILD_FAILURE")
            return REFUSED
        _emit(**{k: summary[k] for k in ("status", "archive_count", "member_count", "output_bytes")})
        return GOOD
    found = V.verify_job(spark, str(project.output_dir), inventory)
    _emit(**found)
    return GOOD if found["valid"] else REFUSED


if __name__ == "__main__":
    sys.exit(main())
