"""Declarative policies over findings: loading, checks, verdicts."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..errors import InputError
from ..functions import text as T


@dataclass(frozen=True)
class Policy:
    version: int = 1
    failOn: str = "never"
    maxRiskScore: int = 100
    denyCapabilities: tuple[str, ...] = ()
    denyDomains: tuple[str, ...] = ()
    allowDomains: tuple[str, ...] = ()
    allowInstallScripts: bool = True
    maxAddedDependencies: int = 1_000_000
    maxAddedFiles: int = 1_000_000
    ignoreFindings: tuple[str, ...] = ()
    includeBaseline: bool = False


def validate(document: object) -> Policy:
    """A policy from plain data; anything unknown or of a wrong kind is an input error."""
    if not isinstance(document, dict):
        raise InputError("a policy is a mapping")
    known = {f.name: getattr(Policy(), f.name) for f in fields(Policy)}
    if unknown := sorted(set(document) - set(known)):
        raise InputError(f"unknown policy keys: {', '.join(unknown)}")
    out = {}
    for key, value in document.items():
        like = known[key]
        if key == "version" and (isinstance(value, bool) or value != 1):
            raise InputError("the policy version is 1")
        if key == "failOn" and value not in (*rules.SEVERITIES, "never"):
            raise InputError(f"failOn is a severity or never, not {value!r}")
        if isinstance(like, bool):
            good = isinstance(value, bool)
        elif isinstance(like, int):
            good = isinstance(value, int) and not isinstance(value, bool) and value >= 0 and (key != "maxRiskScore" or value <= 100)
        elif isinstance(like, tuple):
            good = isinstance(value, (list, tuple)) and all(isinstance(v, str) and v for v in value)
        else:
            good = isinstance(value, str)
        if not good:
            raise InputError(f"policy key {key} can't be {value!r}")
        out[key] = tuple(value) if isinstance(like, tuple) else value
    return Policy(**out)


def load(path: str | None = None, fail_on: str | None = None, ci: bool = False) -> tuple[Policy, list[dict[str, str]]]:
    """The policy of a JSON (or, where a YAML reader is installed, YAML) file, and warnings. In CI without a file, failOn is high."""
    policy, warnings = Policy(), []
    if path:
        try:
            raw = Path(path).read_text("utf-8")
            if path.lower().endswith(".json"):
                document = json.loads(raw)
            else:
                try:
                    import yaml
                except ImportError:
                    document = parse_simple_yaml(raw)
                else:
                    document = yaml.safe_load(raw)
        except (OSError, ValueError) as e:
            raise InputError(f"cannot read policy {path}: {e}") from e
        policy = validate(document)
        if "maxRiskScore" in document and "failOn" not in document and fail_on is None:
            warnings.append({"rule": "maxRiskScore-without-failOn", "message": "maxRiskScore stands without failOn: one severe finding can stay below a sum of scores."})
    elif ci:
        policy = replace(policy, failOn="high")
    if fail_on is not None:
        policy = validate({"failOn": fail_on} | {f.name: getattr(policy, f.name) for f in fields(policy) if f.name != "failOn"})
    return policy, warnings


def parse_simple_yaml(raw: str) -> dict:
    """Flat mappings of scalars and lists, as policies are; anything else is an error."""

    def scalar(s: str):
        s = s.strip()
        if s[:1] in "'\"" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.startswith("["):
            if not s.endswith("]"):
                raise ValueError(f"unclosed list: {s}")
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if s in ("true", "false"):
            return s == "true"
        return int(s) if s.lstrip("-").isdigit() else s

    out: dict = {}
    key = None
    for n, line in enumerate(raw.splitlines(), 1):
        text = line.split(" #")[0].rstrip()
        if not text.strip() or text.lstrip().startswith("#"):
            continue
        if text.lstrip().startswith("- ") and key is not None and out.get(key) in (None, []) or text.lstrip().startswith("- ") and isinstance(out.get(key), list):
            out[key] = (out[key] or []) + [scalar(text.lstrip()[2:])]
        elif ":" in text and text == text.lstrip():
            key, _, value = text.partition(":")
            key = key.strip()
            out[key] = scalar(value) if value.strip() else None
        else:
            raise ValueError(f"line {n}: {line!r}")
    return {k: [] if v is None else v for k, v in out.items()}


def visible(found: DataFrame, policy: Policy) -> DataFrame:
    """Findings that count: not accepted, unless the policy includes those, and not ignored by id or fingerprint."""
    ignored = T.matches_any("id", policy.ignoreFindings) | T.matches_any("fingerprint", policy.ignoreFindings)
    return found.filter((F.lit(policy.includeBaseline) | (F.col("status") != "baseline")) & ~ignored)


def violations(found: DataFrame, dependencies: DataFrame, inventory: DataFrame, policy: Policy) -> DataFrame:
    """pair_id, rule_ord, rule, message and fingerprints of what breaks the policy.

    Limits on added dependencies and files ignore baseline and ignore lists.
    """
    seen = visible(found, policy)
    prints = F.transform(F.array_sort(F.collect_list(F.struct("ord", "fingerprint"))), lambda x: x["fingerprint"]) if "ord" in found.columns else F.array_sort(F.collect_list("fingerprint"))

    def rule(order: int, name: Column | str, message: Column, where: Column, by: tuple[str, ...] = ("pair_id",), df: DataFrame = seen) -> DataFrame:
        got = df.filter(where).groupBy(*by).agg(F.count("*").alias("n"), F.least(F.lit(100), F.sum("score")).alias("total"), prints.alias("fingerprints"))
        return got.select("pair_id", F.lit(order).alias("rule_ord"), (F.lit(name) if isinstance(name, str) else name).alias("rule"), message.alias("message"), "total", "fingerprints")

    out = []
    if policy.failOn != "never":
        out.append(rule(0, "failOn", F.concat(F.col("n").cast("string"), F.lit(f" findings are of severity {policy.failOn} or above")), T.rank("severity") >= rules.RANK[policy.failOn]))
    out.append(rule(1, "maxRiskScore", F.concat(F.lit("risk score "), F.col("total").cast("string"), F.lit(f" is above {policy.maxRiskScore}")), F.lit(True)).filter(F.col("total") > policy.maxRiskScore))
    for k, capability in enumerate(policy.denyCapabilities):
        out.append(rule(100 + k, f"denyCapabilities:{capability}", F.lit(f"capability {capability} is denied"), F.array_contains("tags", capability) | F.endswith("id", F.lit(f".{capability}"))))
    if policy.denyDomains:
        hosts = seen.withColumn("tag", F.explode("tags")).filter(F.startswith("tag", F.lit("domain:"))).withColumn("host", F.substring("tag", 8, 1 << 20))
        denied = T.matches_any("host", policy.denyDomains, True) & ~T.matches_any("host", policy.allowDomains, True)
        out.append(rule(10_000, F.concat(F.lit("denyDomains:"), "host"), F.concat(F.lit("host is denied: "), "host"), denied, ("pair_id", "host"), hosts))
    if not policy.allowInstallScripts:
        out.append(rule(20_000, "allowInstallScripts", F.lit("new or changed install scripts are not allowed"), F.startswith("id", F.lit("install-script."))))

    def limit(order: int, name: str, counted: DataFrame, most: int, linked: Column, what: str) -> DataFrame:
        over = counted.groupBy("pair_id").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        links = seen.filter(linked).groupBy("pair_id").agg(prints.alias("fingerprints"))
        empty = F.array().cast("array<string>")
        return over.join(links, "pair_id", "left").select("pair_id", F.lit(order).alias("rule_ord"), F.lit(name).alias("rule"), F.concat(F.col("n").cast("string"), F.lit(f" {what}; the limit is {most}")).alias("message"), F.lit(None).cast("long").alias("total"), F.coalesce("fingerprints", empty).alias("fingerprints"))

    out.append(limit(30_000, "maxAddedDependencies", dependencies.filter("change = 'added' and scope <> 'development'"), policy.maxAddedDependencies, F.col("id") == "dependencies.runtime.added", "shipped dependencies were added"))
    out.append(limit(30_001, "maxAddedFiles", inventory.filter("status = 'added'"), policy.maxAddedFiles, F.col("category").isin("inventory", "binary"), "files were added"))
    return reduce(DataFrame.unionByName, out).drop("total")


def verdicts(broken: DataFrame, pairs: DataFrame) -> DataFrame:
    """passed for every pair; without violations it is true."""
    got = broken.groupBy("pair_id").agg(F.count("*").alias("violations"))
    return pairs.select("pair_id").distinct().join(got, "pair_id", "left").fillna(0).withColumn("passed", F.col("violations") == 0)


def ordered(broken: DataFrame) -> DataFrame:
    return broken.withColumn("ord", F.row_number().over(Window.partitionBy("pair_id").orderBy("rule_ord", "rule")))


TEMPLATE = """# Policy for comparing two snapshots of a package.
version: 1
failOn: high
maxRiskScore: 100
denyCapabilities: []
denyDomains: []
allowDomains: []
allowInstallScripts: true
ignoreFindings: []
includeBaseline: false
"""
