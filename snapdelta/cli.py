"""Command line: compare two inputs, write a starter policy. Exit codes 0 passed, 1 violations, 2 bad input, 3 internal error."""

from __future__ import annotations

import argparse
import os
import sys

from . import reports, rules
from .errors import InputError
from .operators import policy as P


def positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"not a positive integer: {text!r}")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=reports.NAME)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare")
    c.add_argument("before")
    c.add_argument("after")
    for sink in ("json", "markdown", "sarif", "output", "write-baseline"):
        c.add_argument(f"--{sink}", metavar="FILE")
    c.add_argument("--policy")
    c.add_argument("--baseline")
    c.add_argument("--fail-on", choices=[*rules.SEVERITIES, "never"])
    c.add_argument("--ignore", action="append", default=[])
    c.add_argument("--workspace", default=os.getcwd())
    c.add_argument("--stdout", choices=["summary", "json", "markdown", "sarif"], default="summary")
    for flag in ("ci", "quiet", "deterministic", "offline"):
        c.add_argument(f"--{flag}", action="store_true")
    c.add_argument("--no-fail", dest="fail", action="store_false")
    for name in ("files", "total-bytes", "file-bytes", "archive-bytes", "text-bytes", "ratio"):
        c.add_argument(f"--max-{name}", type=positive, default=getattr(rules.Limits(), "max_" + name.replace("-", "_")))
    c.add_argument("--timeout-ms", type=positive, default=rules.Limits().timeout_ms)
    i = sub.add_parser("init")
    i.add_argument("file", nargs="?", default=f".{reports.NAME}.yml")
    i.add_argument("--force", action="store_true")
    return p


def distinct_outputs(paths: list[str | None]) -> None:
    real = [os.path.realpath(p) for p in paths if p]
    if len(set(real)) < len(real):
        raise InputError("two outputs name the same file")


def compare(o: argparse.Namespace, spark=None) -> int:
    from pyspark.sql import SparkSession

    from .plans import audit as A

    distinct_outputs([o.json, o.markdown, o.sarif, o.output, o.write_baseline])
    chosen, warnings = P.load(o.policy, o.fail_on, o.ci)
    spark = spark or SparkSession.builder.appName(reports.NAME).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    limits = rules.Limits(**{k: getattr(o, k) for k in rules.Limits.__dataclass_fields__})
    baseline = reports.read_baseline(spark, o.baseline) if o.baseline else None
    for source in (o.before, o.after):
        if not os.path.exists(source):
            raise InputError(f"no such input: {source}")
    report, errors = A.audit_pairs(spark, [{"pair_id": "pair", "before": o.before, "after": o.after}], limits, tuple(o.ignore), chosen, baseline, False, warnings)
    if bad := errors.first():
        raise InputError(bad["error_message"])
    at = A.timestamp(o.deterministic or o.offline)
    doc = reports.as_document(report.documents(at).first())
    made = {"json": reports.render_json, "markdown": reports.render_markdown, "sarif": lambda d: reports.render_sarif(d, o.workspace), "output": reports.render_html}
    for sink, render in made.items():
        if path := getattr(o, sink):
            reports.write_file(path, render(doc))
    if o.write_baseline:
        reports.write_baseline(report.findings, o.write_baseline, at)
    if o.ci:
        print("\n".join(reports.annotations(doc, o.workspace)))
    if not o.quiet:
        sys.stdout.write({"summary": reports.summary, **made}[o.stdout](doc))
    return 1 if o.fail and not doc["passed"] else 0


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        o = parser().parse_args(argv)
        if o.command == "init":
            reports.write_file(o.file, P.TEMPLATE, overwrite=o.force)
            return 0
        return compare(o, spark)
    except InputError as e:
        print(f"{reports.NAME}: {reports.terminal_text(str(e))}", file=sys.stderr)
        return e.exit_code
    except SystemExit as e:
        return int(e.code or 0)
    except Exception as e:  # noqa: BLE001 the last resort of a command
        print(f"{reports.NAME}: internal error: {reports.terminal_text(str(e))[:2000]}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
