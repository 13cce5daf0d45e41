"""The audit of one pair, of a batch of pairs and of a labelled corpus; one plan for all."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import detectors, inventory, metadata, policy as P, scoring
from ..operators.detectors import Audit
from ..sources import packages as S


@dataclass
class Report:
    """Lazy relations of all audited pairs."""

    audit: Audit
    policy: P.Policy = field(default_factory=P.Policy)
    baseline: DataFrame | None = None
    warnings: list[dict[str, str]] = field(default_factory=list)
    detectors: Sequence[detectors.Detector] = detectors.DETECTORS

    @cached_property
    def findings(self) -> DataFrame:
        names = self.audit.packages.filter("side = 'after'").select("pair_id", "name")
        found = scoring.findings(detectors.drafts(self.audit, tuple(self.detectors)), names)
        if self.baseline is not None:
            found = scoring.apply_baseline(found, self.baseline)
        return scoring.ordered(found).persist()

    @property
    def inventory(self) -> DataFrame:
        return self.audit.inventory

    @property
    def risk(self) -> DataFrame:
        return scoring.risk(self.findings, self.audit.pairs)

    @property
    def violations(self) -> DataFrame:
        return P.ordered(P.violations(self.findings, self.audit.dependencies, self.inventory, self.policy))

    @property
    def verdicts(self) -> DataFrame:
        return P.verdicts(self.violations, self.audit.pairs)

    def summaries(self) -> DataFrame:
        """One row for each pair: risk, inventory counts and verdict. Left joins, so no pair is lost."""
        counts = inventory.counts(self.inventory).join(inventory.totals(self.audit.files), "pair_id")
        return self.audit.pairs.select("pair_id").join(self.risk, "pair_id", "left").join(counts, "pair_id", "left").join(self.verdicts, "pair_id", "left").fillna(0, ["added", "removed", "modified", "unchanged", "before_bytes", "after_bytes"])

    def documents(self, generated_at: str | None = None) -> DataFrame:
        """One nested report row for each pair. Lists are bounded by the limits on one package."""
        plain = lambda x, *names: F.struct(*[x[n].alias(n) for n in names])
        found = self.findings.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "fingerprint", "category", "severity", "score", "evidence", "tags", "status"))).alias("findings"))
        broken = self.violations.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("ord", "rule", "message", "fingerprints"))).alias("violations"))
        files = self.inventory.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("path", "before", "after")))).alias(s) for s in ("added", "removed", "modified")], F.count_if(F.col("status") == "unchanged").alias("unchanged"))
        deps = self.audit.dependencies.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("scope", "name", "before", "after", "change"))).alias("dependencies"))
        scripts = metadata.script_changes(self.audit.pairs).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("name", "before", "after"))).alias("scripts"))
        side = lambda s: plain(F.col(s), "name", "version", "source_kind", "resolved").alias(s)
        head = self.audit.pairs.select("pair_id", side("before"), side("after")).join(self.summaries().drop("added", "removed", "modified", "unchanged"), "pair_id")
        for part in (found, broken, files, deps, scripts):
            head = head.join(part, "pair_id", "left")
        warnings = F.array(*[F.struct(F.lit(w["rule"]).alias("rule"), F.lit(w["message"]).alias("message")) for w in self.warnings]).cast("array<struct<rule:string,message:string>>")
        return head.withColumns({"schema_version": F.lit("1.0.0"), "generated_at": F.lit(generated_at or timestamp()), "warnings": warnings})


def timestamp(deterministic: bool = False) -> str:
    """Now, or the epoch that SOURCE_DATE_EPOCH names (0 when a repeatable result is asked for)."""
    fixed = os.environ.get("SOURCE_DATE_EPOCH")
    at = datetime.fromtimestamp(int(fixed or 0), UTC) if fixed or deterministic else datetime.now(UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def audit_pairs(spark: SparkSession, pairs: list[dict], limits: rules.Limits = rules.Limits(), ignore: tuple[str, ...] = (), policy: P.Policy | None = None, baseline: DataFrame | None = None, strict: bool = True, warnings: list | None = None) -> tuple[Report, DataFrame]:
    """Report of many pairs (pair_id, before, after: paths), and the inputs that were errors.

    Where `strict` is off, a pair with a bad input is kept out of the report and named among the
    errors; it never counts as clean.
    """
    inputs = [{"pair_id": p["pair_id"], "side": s, "input": p[s]} for p in pairs for s in ("before", "after")]
    read = lambda relation: S.read(spark, inputs, relation, limits, ignore, strict)
    errors = read("errors").persist()
    bad = errors.select("pair_id").distinct()
    files, packages = (read(r).join(F.broadcast(bad), "pair_id", "left_anti").persist() for r in ("files", "packages"))
    return Report(Audit(files, packages, limits), policy or P.Policy(), baseline, warnings or []), errors


def audit(spark: SparkSession, before: str, after: str, **options) -> Report:
    """Report of one pair of folders or archives; a bad input raises."""
    return audit_pairs(spark, [{"pair_id": "pair", "before": before, "after": after}], **options)[0]


def evaluate_corpus(spark: SparkSession, cases: list[dict], least_precision: float = 0.8, least_recall: float = 1.0, most_false: float = 0.2, **options) -> tuple[DataFrame, DataFrame]:
    """Per labelled case (pair_id, before, after, label clean or alert, expected rules) the outcome; and the gate over all."""
    report, _ = audit_pairs(spark, cases, **options)
    wanted = spark.createDataFrame([(c["pair_id"], c["label"] == "alert", list(c.get("expected", []))) for c in cases], "pair_id string, label boolean, expected array<string>")
    new = F.col("status") == "new"
    got = report.findings.groupBy("pair_id").agg(F.bool_or(new & F.col("severity").isin("high", "critical")).alias("predicted"), F.collect_set("id").alias("ids"))
    outcome = wanted.join(got, "pair_id", "left").withColumns({"predicted": F.coalesce("predicted", F.lit(False)), "missing": F.array_sort(F.array_except("expected", F.coalesce("ids", F.array().cast("array<string>"))))})
    outcome = outcome.select("pair_id", "label", "predicted", "missing")
    gate = scoring.confusion(outcome).crossJoin(outcome.agg(F.sum(F.size("missing")).alias("missing_rules")))
    return outcome, gate.withColumn("passed", (F.col("precision") >= least_precision) & (F.col("recall") >= least_recall) & (F.col("false_positive_rate") <= most_false) & (F.col("missing_rules") == 0))


def predecessor_pairs(releases: DataFrame) -> DataFrame:
    """Each release (package, version, published_at, input) beside the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("package").orderBy("published_at", "version")
    return releases.withColumns({"before_version": F.lag("version").over(w), "before": F.lag("input").over(w)}).filter("before is not null").withColumnRenamed("input", "after")


def rollup(findings: DataFrame) -> DataFrame:
    """Finding counts and scores over every grouping of pair, category and severity."""
    return findings.cube("pair_id", "category", "severity").agg(F.count("*").alias("findings"), F.sum("score").alias("score"))
