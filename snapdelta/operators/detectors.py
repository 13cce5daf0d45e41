"""Detectors: each turns the differences of a pair into drafts of findings.

A detector is a function of an Audit (the relations of all pairs) and gives rows of DRAFTS.
`DETECTORS` lists them in the order that breaks ties; a caller may pass more of its own.
Lists within a draft are bounded by the limits on one package, and always explicitly ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..schemas import EVIDENCE
from . import inventory, metadata, profile


@dataclass
class Audit:
    files: DataFrame
    packages: DataFrame
    limits: rules.Limits = rules.Limits()

    @cached_property
    def inventory(self) -> DataFrame:
        return inventory.diff(self.files).persist()

    @cached_property
    def changed(self) -> DataFrame:
        return inventory.changed(self.inventory)

    @cached_property
    def pairs(self) -> DataFrame:
        return metadata.sides(self.packages).persist()

    @cached_property
    def profiles(self) -> DataFrame:
        return profile.profiled(profile.code_files(self.files, self.packages)).persist()

    @cached_property
    def dependencies(self) -> DataFrame:
        return metadata.dependency_changes(self.pairs)


def evidence(message: Column, file: Column | None = None, line: Column | None = None, snippet: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct((none if file is None else file).cast("string").alias("file"), (none if line is None else line).cast("int").alias("line"), message.alias("message"), (none if snippet is None else snippet).cast("string").alias("snippet"))


def draft(df: DataFrame, order: int, rule: Column | str, identity: Column, category: Column | str, severity: Column | str, score: Column | int, shown: Column, tags: Column, sub: Column | str = "") -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, (str, int)) else v
    return df.select(
        "pair_id", F.lit(order).alias("draft_ord"), lit(sub).alias("draft_sub"), lit(rule).alias("id"), identity.alias("identity"), lit(category).alias("category"),
        lit(severity).alias("severity"), lit(score).cast("int").alias("score"), shown.cast(f"array<{EVIDENCE}>").alias("evidence"), tags.cast("array<string>").alias("tags"),
    )


def tags(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def listed(df: DataFrame, order: list[Column], part: Column, shown: Column, *more: Column) -> DataFrame:
    """One row for each pair: n, parts and shown in `order`, and the further aggregates."""
    one = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], part.alias("part"), shown.alias("shown"))
    got = df.groupBy("pair_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(one)).alias("items"), *more)
    return got.withColumn("parts", F.transform("items", lambda x: x["part"])).withColumn("shown", F.transform("items", lambda x: x["shown"])).drop("items")


def joined(parts: Column | str) -> Column:
    return F.array_join(T.col(parts), ",")


def distinct_joined(parts: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(T.col(parts))), ",")


def first(cap: int, shown: Column | str = "shown") -> Column:
    return F.slice(T.col(shown), 1, cap)


def capabilities(a: Audit) -> DataFrame:
    found = profile.signals(a.profiles)
    old = found.filter("side = 'before'").select("pair_id", "capability").distinct()
    new = found.filter("side = 'after'").join(old, ["pair_id", "capability"], "left_anti")
    key = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in rules.CAPABILITIES.items() for x in (c, v[k])]), F.col("capability")), F.lit(rules.OTHER_CAPABILITY[k]))
    one = F.struct("path", "line", "message", evidence(F.col("message"), F.col("path"), F.col("line"), F.col("snippet")).alias("shown"))
    got = new.groupBy("pair_id", "capability").agg(F.sort_array(F.collect_list(one)).alias("items"), F.collect_set(F.concat_ws(":", "path", "sha256")).alias("parts"))
    category = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.CAPABILITY_CATEGORY.items() for x in kv]), F.col("capability")), F.lit("execution"))
    return draft(got, 0, F.concat(F.lit("capability.added."), "capability"), F.concat(F.lit("capability:"), F.col("capability"), F.lit(":"), distinct_joined("parts")), category, key(0), key(1), F.transform(first(rules.CAPS["capability"], "items"), lambda x: x["shown"]), F.array(F.lit("capability"), F.col("capability")), sub=F.col("capability"))


def domains(a: Audit) -> DataFrame:
    found = profile.host_mentions(a.profiles)
    old = found.filter("side = 'before'").select("pair_id", "host").distinct()
    new = found.filter("side = 'after'").join(old, ["pair_id", "host"], "left_anti")
    shown = evidence(F.concat(F.lit("names the host "), F.col("host")), F.col("path"), F.col("line"), F.col("snippet"))
    by_host = new.groupBy("pair_id", "host").agg(F.slice(F.sort_array(F.collect_list(F.struct("path", "ord", shown.alias("shown")))), 1, rules.CAPS["host_side"]).alias("items"))
    got = by_host.groupBy("pair_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("host", "items"))).alias("all"), F.bool_or(T.private_host("host") | T.disposable_host("host")).alias("odd"))
    names = F.transform("all", lambda x: x["host"])
    shown = F.flatten(F.transform("all", lambda x: F.transform(x["items"], lambda y: y["shown"])))
    return draft(got, 10, "network.domains.added", F.concat(F.lit("domains:"), joined(names)), "network", F.when(F.col("odd"), "high").otherwise("medium"), F.when(F.col("odd"), 20).otherwise(F.least(F.lit(16), 8 + F.col("n"))), first(rules.CAPS["domain"], shown), F.concat(tags("network", "domain"), F.transform(names, lambda x: F.concat(F.lit("domain:"), x))))


def install_scripts(a: Audit) -> DataFrame:
    got = metadata.script_changes(a.pairs).filter(F.col("name").isin(*rules.LIFECYCLE) & F.col("after").isNotNull())
    new, danger = F.col("before").isNull(), T.dangerous_command("after")
    return draft(got, 20, F.when(new, "install-script.added").otherwise("install-script.changed"), F.concat(F.lit("install-script:"), F.col("name"), F.lit(":"), F.col("after")), "install", F.when(danger, "critical").when(new, "high").otherwise("medium"), F.when(danger, 34).when(new, 22).otherwise(10), F.array(evidence(F.concat(F.col("name"), F.lit(": "), T.truncate("after", 240)), F.lit("package.json"))), F.array(F.lit("lifecycle"), F.col("name")), sub=F.col("name"))


def dependencies(a: Audit) -> DataFrame:
    shipped = a.dependencies.filter("scope <> 'development'").withColumn("direct", T.non_registry("after"))
    order = [F.col("scope"), F.col("name")]
    name = F.concat(F.col("scope"), F.lit(":"), F.col("name"), F.lit("@"))
    label = F.concat(F.col("scope"), F.lit(": "), F.col("name"), F.lit("@"))
    at, cap = F.lit("package.json"), rules.CAPS["dependency"]
    out = []
    added = shipped.filter("change = 'added'")
    got = listed(added.filter("direct"), order, F.concat(name, "after"), evidence(F.concat(label, "after"), at))
    out.append(draft(got, 30, "dependencies.non-registry.added", F.concat(F.lit("non-registry-dependencies:"), joined("parts")), "dependency", "high", F.least(F.lit(24), 17 + F.col("n")), first(cap), tags("dependency", "non-registry")))
    got = listed(shipped.filter("change = 'changed' and direct"), order, F.concat(name, F.col("before"), F.lit("->"), F.col("after")), evidence(F.concat(label, F.col("before"), F.lit(" → "), F.col("after")), at))
    out.append(draft(got, 31, "dependencies.non-registry.changed", F.concat(F.lit("non-registry-dependency-changes:"), joined("parts")), "dependency", "high", F.least(F.lit(24), 17 + F.col("n")), first(cap), tags("dependency", "non-registry", "changed")))
    got = listed(added.filter("not direct"), order, F.concat(name, "after"), evidence(F.concat(label, "after"), at))
    out.append(draft(got, 32, "dependencies.runtime.added", F.concat(F.lit("dependencies:"), joined("parts")), "dependency", F.when(F.col("n") > 10, "medium").otherwise("low"), F.least(F.lit(14), 3 + F.col("n")), first(cap), tags("dependency")))
    return reduce(DataFrame.unionByName, out)


def files(a: Audit) -> DataFrame:
    old, new, cap = F.col("before"), F.col("after"), rules.CAPS["file"]
    added, modified = a.inventory.filter("status = 'added'"), a.inventory.filter("status = 'modified'")
    order, path = [F.col("path")], F.col("path")
    colon = lambda *c: F.concat_ws(":", *[x.cast("string") for x in c])
    short = lambda c: F.concat(F.substring(c, 1, 16), F.lit("…"))
    change = F.concat(short(old["sha256"]), F.lit(" → "), short(new["sha256"]))
    native, is_bin = F.bool_or(T.is_native_file("path")).alias("native"), T.is_binary_file(new["kind"], path)
    out = []

    def binaries(rows: DataFrame, k: int, word: str, prefix: str, part: Column, message: Column, *more: str) -> None:
        got = listed(rows.filter(is_bin), order, part, evidence(message, path), native)
        n = F.col("native")
        out.append(draft(got, k, F.when(n, f"binary.native.{word}").otherwise(f"binary.{word}"), F.concat(F.lit(prefix), joined("parts")), "binary", F.when(n, "high").otherwise("medium"), F.when(n, 22).otherwise(10), first(cap), F.when(n, tags("binary", *more, "native")).otherwise(tags("binary", *more))))

    binaries(added, 40, "added", "binaries:", colon(path, new["sha256"]), F.concat(new["size"].cast("string"), F.lit(" bytes, sha256 "), short(new["sha256"])))
    binaries(modified, 41, "changed", "changed-binaries:", colon(path, old["sha256"], new["sha256"]), F.concat(F.lit("sha256 "), change), "changed")
    runs = T.is_executable(new["kind"], new["mode"], new["mode_known"])
    score = F.least(F.lit(15), 8 + F.col("n"))
    got = listed(added.filter(runs), order, colon(path, new["sha256"], new["mode"]), evidence(F.concat(F.lit("mode "), T.octal(new["mode"])), path))
    out.append(draft(got, 42, "files.executable.added", F.concat(F.lit("executables:"), joined("parts")), "execution", "medium", score, first(cap), tags("executable", "inventory")))
    turned = runs & old["mode_known"] & (old["mode"].bitwiseAND(0o111) == 0)
    got = listed(modified.filter(turned), order, colon(path, old["mode"], new["mode"], new["sha256"]), evidence(F.concat(F.lit("mode "), T.octal(old["mode"]), F.lit(" → "), T.octal(new["mode"])), path))
    out.append(draft(got, 43, "files.executable.changed", F.concat(F.lit("changed-executables:"), joined("parts")), "execution", "medium", score, first(cap), tags("executable", "inventory", "changed")))
    link = new["kind"] == "symlink"
    got = listed(added.filter(link), order, colon(path, new["sha256"]), evidence(F.concat(F.lit("link target "), short(new["sha256"])), path))
    out.append(draft(got, 44, "files.symlink.added", F.concat(F.lit("symlinks:"), joined("parts")), "inventory", "medium", 8, first(cap), tags("symlink")))
    got = listed(modified.filter(link & ((old["kind"] != "symlink") | (old["sha256"] != new["sha256"]))), order, colon(path, old["sha256"], new["sha256"]), evidence(F.concat(F.lit("link target "), change), path))
    out.append(draft(got, 45, "files.symlink.changed", F.concat(F.lit("changed-symlinks:"), joined("parts")), "inventory", "medium", 8, first(cap), tags("symlink", "changed")))
    b, n = F.col("before_bytes"), F.col("after_bytes")
    got = inventory.totals(a.files).filter(inventory.is_spike(b, n))
    out.append(draft(got, 46, "inventory.size.spike", F.concat(F.lit("size-spike:"), colon(b, n)), "inventory", "medium", 8, F.array(evidence(F.concat(T.thousands(b), F.lit(" → "), T.thousands(n), F.lit(" bytes")))), tags("size", "inventory")))
    return reduce(DataFrame.unionByName, out)


def _identity(path: Column, sha: Column) -> Column:
    return F.concat_ws(":", path, sha)


def obfuscation(a: Audit, entropy_floor: float = 5.2, entropy_rise: float = 0.8, least_bytes: int = 1024) -> DataFrame:
    side = lambda s: a.files.filter((F.col("side") == s) & (F.col("kind") == "text")).select("pair_id", "path", *[F.col(c).alias(f"{s}_{c}") for c in ("size", "sha256", "content")])
    rows = side("after").join(a.changed.select("pair_id", "path"), ["pair_id", "path"], "left_semi").join(side("before"), ["pair_id", "path"], "left")
    text, path, sha, size = F.col("text"), F.col("path"), F.col("after_sha256"), F.col("after_size")
    rows = rows.withColumn("text", T.valid_text("after_content"))
    out = []
    token = rows.withColumn("token", T.encoded_token("text")).filter("token is not null")
    at = F.instr(text, F.col("token.token")) - 1
    message = F.concat(F.col("token.kind"), F.lit(" run of "), T.thousands(F.length("token.token")), F.lit(" characters, entropy "), F.format_number("token.entropy", 2))
    got = listed(token, [path], _identity(path, sha), evidence(message, path, T.line_number(text, at), T.truncate(T.line_at(text, at))))
    out.append(draft(got, 50, "obfuscation.encoded-payload", F.concat(F.lit("encoded:"), distinct_joined("parts")), "obfuscation", "high", 20, first(rules.CAPS["text"]), tags("entropy", "encoded")))
    rise = rows.filter(F.col("before_content").isNotNull() & (F.octet_length("after_content") >= least_bytes)).withColumn("new", T.entropy("after_content")).filter(F.col("new") > entropy_floor).withColumn("old", T.entropy("before_content")).filter(F.col("new") - F.col("old") > entropy_rise)
    got = listed(rise, [path], _identity(path, sha), evidence(F.concat(F.lit("entropy rose from "), F.format_number("old", 2), F.lit(" to "), F.format_number("new", 2)), path))
    out.append(draft(got, 51, "obfuscation.entropy-spike", F.concat(F.lit("entropy:"), distinct_joined("parts")), "obfuscation", "medium", 10, first(rules.CAPS["text"]), tags("entropy")))
    suffix = reduce(lambda x, y: x | y, [F.endswith("path", F.lit(s)) for s in rules.GENERATED_SUFFIXES])
    bulky = rows.filter((size > 1_000_000) | ((size > 100_000) & suffix)).select("pair_id", "path", "after_sha256", F.lit(1).alias("kind"), F.concat(T.thousands(size), F.lit(" bytes of generated or dense text")).alias("message"))
    lines = rows.filter(T.extension("path").isin(*rules.CODE_EXTENSIONS) & text.isNotNull()).withColumn("l", T.line_stats("text")).withColumn("chars", T.unit_length("text"))
    dense = lines.filter(((F.col("l.longest") > 500) & (F.col("l.average") > 250)) | ((F.col("chars") > 40_000) & (F.col("l.lines") < 12)))
    dense = dense.select("pair_id", "path", "after_sha256", F.lit(0).alias("kind"), F.concat(T.thousands("chars"), F.lit(" characters in "), F.col("l.lines").cast("string"), F.lit(" lines, the longest "), T.thousands("l.longest")).alias("message"))
    got = listed(dense.unionByName(bulky), [F.col("kind"), path], _identity(path, sha), evidence(F.col("message"), path), F.bool_or(F.col("kind") == 1).alias("bulky"))
    out.append(draft(got, 52, "payload.generated.added", F.concat(F.lit("generated:"), distinct_joined("parts")), "obfuscation", F.when(F.col("bulky"), "medium").otherwise("low"), F.when(F.col("bulky"), 10).otherwise(4), first(rules.CAPS["file"]), tags("minified", "generated")))
    return reduce(DataFrame.unionByName, out)


def ownership(a: Audit) -> DataFrame:
    got = metadata.maintainer_changes(a.pairs)
    said = lambda c, w: F.transform(c, lambda x: evidence(F.concat(F.lit(w), x)))
    people = draft(got, 60, "metadata.maintainers.changed", F.concat(F.lit("maintainers:"), joined("added"), F.lit(":"), joined("removed")), "metadata", "high", 20, F.concat(said("added", "added: "), said("removed", "removed: ")), tags("maintainer", "ownership"))
    got = metadata.field_changes(a.pairs).filter("field in ('name', 'repository')")
    name, none = F.col("field") == "name", lambda c, w="": F.coalesce(F.col(c), F.lit(w))
    fields = draft(got, 61, F.concat(F.lit("metadata."), F.col("field"), F.lit(".changed")), F.concat_ws(":", F.lit("metadata"), F.col("field"), none("before"), none("after")), "metadata", F.when(name, "high").otherwise("medium"), F.when(name, 20).otherwise(8), F.array(evidence(F.concat(none("before", "(missing)"), F.lit(" → "), none("after", "(missing)")), F.lit("package.json"))), F.array(F.lit("metadata"), F.col("field")), sub=F.col("field"))
    return people.unionByName(fields)


def provenance(a: Audit) -> DataFrame:
    both = a.pairs.filter("before.source_kind = 'registry' and after.source_kind = 'registry'")
    lost = lambda flag: both.filter(F.coalesce(F.col(f"before.{flag}"), F.lit(False)) & ~F.coalesce(F.col(f"after.{flag}"), F.lit(False)))
    one = lambda m: F.array(evidence(m))
    return (
        draft(lost("attestations"), 70, "provenance.attestations.removed", F.lit("provenance:attestations-removed"), "provenance", "high", 20, one(F.lit("attestations: present → absent")), tags("provenance", "attestation"))
        .unionByName(draft(lost("signatures"), 71, "provenance.signatures.removed", F.lit("provenance:signatures-removed"), "provenance", "high", 18, one(F.lit("signatures: present → absent")), tags("provenance", "signature")))
        .unionByName(draft(both.filter(F.coalesce(F.col("after.integrity"), F.lit("")) == ""), 72, "provenance.integrity.missing", F.lit("provenance:integrity-missing"), "provenance", "high", 20, one(F.concat(F.coalesce(F.col("after.resolved"), F.lit("?")), F.lit(" has no integrity value"))), tags("provenance", "integrity")))
    )


def coverage(a: Audit) -> DataFrame:
    new = a.profiles.filter("side = 'after'").join(a.changed.select("pair_id", "path"), ["pair_id", "path"], "left_semi")
    gap = profile.gaps(new, a.limits.max_text_bytes)
    path, order, cap = F.col("path"), [F.col("path"), F.col("reason")], rules.CAPS["coverage"]
    shown, part = evidence(F.col("detail"), path), F.concat_ws(":", path, F.col("reason"), F.col("sha256"))
    got = listed(gap.filter("reason = 'size-limit'"), order, part, shown)
    out = [draft(got, 80, "analysis.unanalyzed-code", F.concat(F.lit("unanalyzed:"), distinct_joined("parts")), "obfuscation", "high", 25, first(cap), tags("coverage", "review-gap", "unanalyzed"))]
    got = listed(gap.filter("reason in ('parse-failure', 'partial-parse')"), order, part, shown)
    out.append(draft(got, 81, "analysis.parse-failure", F.concat(F.lit("parse-failure:"), distinct_joined("parts")), "obfuscation", "high", 25, first(cap), tags("coverage", "review-gap", "parser")))
    got = listed(profile.control_bytes(new), [path], _identity(path, F.col("sha256")), evidence(F.col("message"), path))
    out.append(draft(got, 82, "obfuscation.control-bytes", F.concat(F.lit("control-bytes:"), distinct_joined("parts")), "obfuscation", "high", 20, first(rules.CAPS["control"]), tags("obfuscation", "control-bytes")))
    return reduce(DataFrame.unionByName, out)


Detector = Callable[[Audit], DataFrame]
DETECTORS: tuple[Detector, ...] = (capabilities, domains, install_scripts, dependencies, files, obfuscation, ownership, provenance, coverage)


def drafts(a: Audit, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    return reduce(DataFrame.unionByName, [d(a) for d in detectors])
