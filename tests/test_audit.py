"""Sources, the audit of pairs, policy, reports and the command line, on packages written here."""

import gzip
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from snapdelta import cli, reports, rules
from snapdelta.errors import InputError
from snapdelta.operators import detectors, inventory, policy as P, scoring
from snapdelta.plans import audit as A
from snapdelta.schemas import FILES
from snapdelta.sources import packages as S


def put(root, files):
    for path, content in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def manifest(**more):
    return json.dumps({"name": "pkg", "version": "1.0.0"} | more)


@pytest.fixture(scope="module")
def pairs(tmp_path_factory):
    t = tmp_path_factory.mktemp("packages")
    calm = put(t / "calm", {"package.json": manifest(repository="r1", maintainers=["ann"], dependencies={"keep": "1"}), "index.js": "module.exports = require('./x')\n", "x.js": "exports.a = 1\n", "old.txt": "gone\n"})
    dense = ";".join(f"v{i}={i}" for i in range(9000))
    wild = put(
        t / "wild",
        {
            "package.json": manifest(version="2.0.0", repository={"url": "r2"}, author={"name": "Bob", "email": "B@X.org"}, main="lib/run", scripts={"postinstall": "node tools/go && curl http://h", "test": "x"}, dependencies={"keep": "git+https://h/x", "more": "^1", "far": "github:a/b"}, devDependencies={"dev": "a/b"}),
            "index.js": "const c = require('child_process'); eval('1'); process.env.A; fetch('https://a.ngrok')\n",
            "x.js": "exports.a = 1\n", "lib/run.js": "require('node:fs')\n", "tools/go": "#!/usr/bin/env node\nrequire('dns')\n", "broken.js": "f('\n", "native.node": b"\x00\x01\x02",
            "ctrl.js": b"a = 1" + b"\x01" * 20 + b"\n", "dense.js": dense, "blob.txt": "".join(chr(65 + (i * i + i // 7) % 26) + str(i % 10) for i in range(200)), ".hid/note.md": "text",
        },
    )
    os.chmod(t / "wild" / "x.js", 0o755)
    os.symlink("x.js", t / "wild" / "link")
    bigcode = put(t / "bigcode", {"package.json": manifest(), "index.js": "a = 1\n" * 200})
    return {"calm": calm, "wild": wild, "bigcode": bigcode}


@pytest.fixture(scope="module")
def report(spark, pairs):
    cases = [{"pair_id": "risky", "before": pairs["calm"], "after": pairs["wild"]}, {"pair_id": "same", "before": pairs["calm"], "after": pairs["calm"]}]
    got, errors = A.audit_pairs(spark, cases, policy=P.Policy(failOn="high", maxRiskScore=49, denyCapabilities=("network",), denyDomains=("*",), allowInstallScripts=False, maxAddedDependencies=1, maxAddedFiles=2))
    assert errors.count() == 0
    return got


def test_findings(report):
    got = {r["id"]: r for r in report.findings.filter("pair_id = 'risky'").collect()}
    want = {
        "capability.added.child_process": ("critical", 34), "capability.added.dynamic-code": ("critical", 32), "capability.added.network": ("high", 20), "capability.added.filesystem": ("medium", 10),
        "capability.added.environment": ("low", 4), "capability.added.dns": ("medium", 10), "network.domains.added": ("high", 20), "install-script.added": ("critical", 34),
        "dependencies.non-registry.added": ("high", 18), "dependencies.non-registry.changed": ("high", 18), "dependencies.runtime.added": ("low", 4), "binary.native.added": ("high", 22),
        "files.executable.added": ("medium", 9), "files.executable.changed": ("medium", 9), "files.symlink.added": ("medium", 8), "metadata.maintainers.changed": ("high", 20), "metadata.repository.changed": ("medium", 8),
        "analysis.parse-failure": ("high", 25), "obfuscation.control-bytes": ("high", 20), "payload.generated.added": ("low", 4), "obfuscation.encoded-payload": ("high", 20),
    }
    assert {k: (r["severity"], r["score"]) for k, r in got.items()} == want
    assert all(r["evidence"] and len(r["fingerprint"]) == 32 for r in got.values())
    assert got["network.domains.added"]["tags"] == ["network", "domain", "domain:a.ngrok"]
    assert [r["id"] for r in report.findings.filter("pair_id = 'risky'").orderBy("ord").collect()][:3] == ["capability.added.child_process", "install-script.added", "capability.added.dynamic-code"]


def test_same_pair_is_clean(report):
    assert report.findings.filter("pair_id = 'same'").count() == 0
    rows = {r["pair_id"]: r for r in report.summaries().collect()}
    assert (rows["same"]["score"], rows["same"]["level"], rows["same"]["passed"], rows["same"]["unchanged"]) == (0, "none", True, 4)
    assert (rows["risky"]["score"], rows["risky"]["level"], rows["risky"]["passed"], rows["risky"]["removed"]) == (100, "critical", False, 1)


def test_violations(report):
    got = [r["rule"] for r in report.violations.filter("pair_id = 'risky'").orderBy("ord").collect()]
    assert got == ["failOn", "maxRiskScore", "denyCapabilities:network", "denyDomains:a.ngrok", "allowInstallScripts", "maxAddedDependencies", "maxAddedFiles"]


def test_renderers(report, tmp_path):
    doc = reports.as_document(report.documents("1970-01-01T00:00:00.000Z").filter("pair_id = 'risky'").first())
    assert json.loads(reports.render_json(doc))["schema_version"] == "1.0.0" and reports.render_json(doc) == reports.render_json(doc)
    sarif = json.loads(reports.render_sarif(doc, os.path.dirname(doc["after"]["resolved"])))["runs"][0]
    assert len(sarif["results"]) == 21 and sarif["invocations"][0]["exitCode"] == 1
    first = sarif["results"][0]
    assert first["level"] == "error" and first["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "wild/index.js" and first["baselineState"] == "new"
    doc["after"]["version"] = "<b>|`x`\n# y\x1b[31m"
    assert "<b>" not in reports.render_html(doc).split("<script")[0] and "</script><b>" not in reports.render_html(doc)
    assert "\n# y" not in reports.render_markdown(doc) and "\x1b" not in reports.summary(doc)
    assert any(a.startswith("::error file=") for a in reports.annotations(doc, os.path.dirname(doc["after"]["resolved"])))
    reports.write_baseline(report.findings, str(tmp_path / "b.json"), "t")
    with pytest.raises(InputError):
        reports.write_file(str(tmp_path / "b.json"), "x", overwrite=False)


def test_baseline_hides_accepted(spark, report, tmp_path):
    path = str(tmp_path / "b.json")
    reports.write_baseline(report.findings.filter("severity = 'critical'"), path, "t")
    marked = scoring.apply_baseline(report.findings, reports.read_baseline(spark, path))
    risk = scoring.risk(marked.filter("pair_id = 'risky'")).first()
    assert risk["critical"] == 0 and risk["baseline_findings"] == 3 and risk["new_findings"] == 18
    (tmp_path / "bad.json").write_text('{"schemaVersion": 2, "findings": []}')
    with pytest.raises(InputError):
        reports.read_baseline(spark, str(tmp_path / "bad.json"))


def test_unread_code_is_a_finding(spark, pairs):
    got = A.audit(spark, pairs["calm"], pairs["bigcode"], limits=rules.Limits(max_text_bytes=600))
    assert "analysis.unanalyzed-code" in {r["id"] for r in got.findings.collect()}


def test_synthetic_snapshots(spark):
    rows = []
    for side, mode, sha, kind in (("before", 420, "a", "text"), ("after", 493, "a", "text")):
        rows.append(("p", side, "x", 1, sha, mode, True, kind, None, None))
        rows.append(("p", side, "u", 1, sha, mode, False, kind, None, None))
    rows += [("p", "before", "b.bin", 5, "a", 420, True, "binary", None, None), ("p", "after", "b.bin", 5_000_000, "b", 420, True, "binary", None, None), ("p", "before", "l", 1, "a", 511, True, "symlink", None, None), ("p", "after", "l", 1, "b", 511, True, "symlink", None, None)]
    files = spark.createDataFrame(rows, FILES)
    got = {r["path"]: r["status"] for r in inventory.diff(files).collect()}
    assert got == {"x": "modified", "u": "unchanged", "b.bin": "modified", "l": "modified"}
    a = detectors.Audit(files, None)
    assert {r["id"] for r in detectors.files(a).collect()} == {"binary.changed", "files.executable.changed", "files.symlink.changed", "inventory.size.spike"}


def test_provenance(spark):
    from snapdelta.schemas import PACKAGES

    base = S.parse_manifest(manifest().encode()) | {"pair_id": "p", "source_kind": "registry", "resolved": "u", "source_maintainers": []}
    rows = [base | {"side": "before", "attestations": True, "signatures": True, "integrity": "x"}, base | {"side": "after", "attestations": False, "signatures": None, "integrity": None}]
    df = spark.createDataFrame(rows, PACKAGES)
    got = {r["id"] for r in detectors.provenance(detectors.Audit(None, df)).collect()}
    assert got == {"provenance.attestations.removed", "provenance.signatures.removed", "provenance.integrity.missing"}


def test_result_does_not_depend_on_partitions(spark, pairs):
    a = A.audit(spark, pairs["calm"], pairs["wild"])
    fingerprints = lambda x: sorted((r["fingerprint"], str(r["evidence"])) for r in scoring.findings(detectors.drafts(x), x.packages.filter("side = 'after'")).collect())
    assert fingerprints(detectors.Audit(a.audit.files.repartition(7), a.audit.packages)) == fingerprints(detectors.Audit(a.audit.files.coalesce(1), a.audit.packages))


# --- sources -----------------------------------------------------------------


def tar(*members, compress=True):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, content, mode, kind in members:
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.type = len(content), mode, kind
            info.linkname = "x" if kind == tarfile.SYMTYPE else ""
            t.addfile(info, io.BytesIO(content))
    return gzip.compress(raw.getvalue()) if compress else raw.getvalue()


REG = tarfile.REGTYPE


def test_archives():
    data = tar(("package/package.json", b"{}", 0o644, REG), ("package/bin/x", b"#!", 0o755, REG), ("package/bin", b"", 0o755, tarfile.DIRTYPE))
    got = {f["path"]: f["mode"] for f in S.scan_archive(data)}
    assert got == {"package.json": 420, "bin/x": 493}
    assert [f["path"] for f in S.scan_archive(tar(("a/b.js", b"1", 0o644, REG), compress=False))] == ["b.js"]


@pytest.mark.parametrize(
    "data",
    [
        tar(("package/x", b"", 0o644, tarfile.SYMTYPE)), tar(("../x", b"1", 0o644, REG)), tar(("/x", b"1", 0o644, REG)), tar(("C:x", b"1", 0o644, REG)),
        tar(("package/package.json", b"{}", 0o644, REG), ("other/x", b"1", 0o644, REG)), tar(("p/A.js", b"1", 0o644, REG), ("p/a.js", b"2", 0o644, REG)),
        tar(("p/zeros", b"\0" * 3_000_000, 0o644, REG)), b"no archive at all", gzip.compress(b"x" * 600), tar(("p/big", b"1" * 2000, 0o644, REG)), tar(("package/package.json", b" " * 1500, 0o644, REG)),
    ],
)
def test_hostile_archives(data):
    with pytest.raises(InputError):
        list(S.scan_archive(data, rules.Limits(max_file_bytes=1800 if len(data) < 5000 else 32 << 20, max_text_bytes=1000)))


def test_zip_archives():
    import zipfile

    def pack(*members):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in members:
                z.writestr(name, content)
        return raw.getvalue()

    assert [f["path"] for f in S.scan_zip(pack(("p/a.js", "1"), ("p/b/c.js", "2")))] == ["a.js", "b/c.js"]
    for bad in (pack(("../x", "1")), pack(("p/zeros", b"\0" * 3_000_000)), pack(("p/A", "1"), ("p/a", "2")), b"no archive"):
        with pytest.raises(InputError):
            list(S.scan_zip(bad))


def test_directory_limits_and_ignores(tmp_path):
    put(tmp_path, {"a/b.js": "1", "node_modules/x/y.js": "1", ".npmrc": "k", "a/_u.js": "2"})
    assert [f["path"] for f in S.scan_directory(str(tmp_path))] == [".npmrc", "a/_u.js", "a/b.js"]
    assert [f["path"] for f in S.scan_directory(str(tmp_path), ignore=("**/*.js",))] == [".npmrc"]
    for limits in (rules.Limits(max_files=2), rules.Limits(max_file_bytes=0), rules.Limits(max_total_bytes=2)):
        with pytest.raises(InputError):
            list(S.scan_directory(str(tmp_path), limits))


def test_manifest():
    got = S.parse_manifest(json.dumps({"name": 3, "scripts": {"a": "x", "b": 1}, "maintainers": [{"name": "N", "email": "E@x"}, {}, "p", {"email": "Q@x"}], "exports": {".": {"import": "./m.mjs", "x": "./*"}}, "bin": {"b": "cli.js"}, "files": ["a", 1]}).encode())
    assert got["name"] == S.UNKNOWN_NAME and got["scripts"] == {"a": "x"} and got["maintainers"] == ["N <e@x>", "p", "(unknown) <q@x>"]
    assert got["entry_points"] == ["./m.mjs", "cli.js"] and got["files"] == ["a"]
    assert S.parse_manifest(b'{"name":"a","name":"b"}')["name"] == "b" and S.parse_manifest(b"[]")["name"] == S.UNKNOWN_NAME
    for bad in (b"{", b"", b'{"a": NaN}'):
        with pytest.raises(InputError):
            S.parse_manifest(bad)


def test_digests_and_registry():
    import base64
    import hashlib

    sri = lambda n, d=b"data": f"{n}-{base64.b64encode(hashlib.new(n, d).digest()).decode()}"
    S.verify_digest(b"data", sri("sha512"))
    S.verify_digest(b"data", sri("sha256", b"other") + " " + sri("sha512"))
    S.verify_digest(b"data", None, hashlib.sha1(b"data").hexdigest())
    for bad in (sri("sha512", b"x"), "sha512-***", "", "md5-abc", sri("sha512", b"x") + " " + sri("sha256")):
        with pytest.raises(InputError):
            S.verify_digest(b"data", bad)
    assert S.parse_specifier("@a/b@1.x") == ("@a/b", "1.x") and S.parse_specifier("n") == ("n", "latest")
    assert S.normal_registry("https://user:pw@h.org/r") == "https://h.org/r/"
    for call in (lambda: S.parse_specifier("../x"), lambda: S.normal_registry("http://h"), lambda: S.registry_entry({"versions": {}}, "1")):
        with pytest.raises(InputError):
            call()
    entry = S.registry_entry({"dist-tags": {"latest": "1"}, "versions": {"1": {"dist": {"tarball": "t", "signatures": [1]}, "maintainers": ["m"]}}}, "latest")
    assert entry["signatures"] and not entry["attestations"] and entry["source_maintainers"] == ["m"]


def test_archive_relation(spark):
    good, bad = tar(("package/package.json", manifest().encode(), 0o644, REG)), tar(("../x", b"", 0o644, REG))
    df = spark.createDataFrame([("p", "before", bytearray(good)), ("q", "after", bytearray(bad))], "pair_id string, side string, content binary")
    files, packages, errors = S.read_archives(df)
    assert [r["path"] for r in files.collect()] == ["package.json"] and packages.first()["name"] == "pkg" and [r["pair_id"] for r in errors.collect()] == ["q"]


def test_bad_pairs_are_set_apart(spark, pairs):
    cases = [{"pair_id": "ok", "before": pairs["calm"], "after": pairs["calm"]}, {"pair_id": "bad", "before": pairs["calm"], "after": pairs["calm"] + "/none"}]
    report, errors = A.audit_pairs(spark, cases, strict=False)
    assert [r["pair_id"] for r in errors.collect()] == ["bad"] and [r["pair_id"] for r in report.summaries().collect()] == ["ok"]


# --- policy, corpus, command line ------------------------------------------------


def test_policy_files(tmp_path):
    for bad in ({"version": 2}, {"x": 1}, {"failOn": "worst"}, {"maxRiskScore": 101}, {"maxRiskScore": True}, {"denyDomains": "a"}, {"denyDomains": [1]}, {"allowInstallScripts": 1}, []):
        with pytest.raises(InputError):
            P.validate(bad)
    assert P.load()[0].failOn == "never" and P.load(ci=True)[0].failOn == "high" and P.load(fail_on="low", ci=True)[0].failOn == "low"
    (tmp_path / "p.json").write_text('{"maxRiskScore": 10}')
    policy, warnings = P.load(str(tmp_path / "p.json"), ci=True)
    assert policy.failOn == "never" and policy.maxRiskScore == 10 and len(warnings) == 1
    assert P.validate(P.parse_simple_yaml(P.TEMPLATE)).failOn == "high"
    assert P.parse_simple_yaml("a: [x, 'y']\nb:\n  - \"*\"\n  - z # c\nc: true\nd: 3\n") == {"a": ["x", "y"], "b": ["*", "z"], "c": True, "d": 3}


def test_allowed_domains_win(spark):
    found = spark.createDataFrame([("p", "network.domains.added", "f", "network", "high", 20, ["domain:a.com", "domain:b.org"], "new")], "pair_id string, id string, fingerprint string, category string, severity string, score int, tags array<string>, status string")
    nothing = lambda ddl: spark.createDataFrame([], ddl)
    got = P.violations(found, nothing("pair_id string, change string, scope string"), nothing("pair_id string, status string"), P.Policy(denyDomains=("*",), allowDomains=("*.com",)))
    assert [r["rule"] for r in got.collect()] == ["denyDomains:b.org"]


def test_corpus_gate(spark, pairs):
    cases = [{"pair_id": "a", "before": pairs["calm"], "after": pairs["wild"], "label": "alert", "expected": ["install-script.added"]}, {"pair_id": "b", "before": pairs["calm"], "after": pairs["calm"], "label": "clean"}]
    outcome, gate = A.evaluate_corpus(spark, cases)
    row = gate.first()
    assert (row["tp"], row["tn"], row["precision"], row["recall"], row["passed"]) == (1, 1, 1.0, 1.0, True)
    assert {r["pair_id"]: r["missing"] for r in outcome.collect()} == {"a": [], "b": []}


def test_predecessors(spark):
    df = spark.createDataFrame([("p", "1", 1, "i1"), ("p", "3", 3, "i3"), ("p", "2", 2, "i2"), ("q", "1", 1, "j")], "package string, version string, published_at int, input string")
    assert sorted((r["before"], r["after"]) for r in A.predecessor_pairs(df).collect()) == [("i1", "i2"), ("i2", "i3")]


def test_command_line(spark, pairs, tmp_path, capsys):
    out = str(tmp_path / "r.json")
    assert cli.main(["compare", pairs["calm"], pairs["wild"], "--fail-on", "high", "--json", out, "--deterministic", "--quiet"], spark) == 1
    assert json.load(open(out))["generated_at"] == "1970-01-01T00:00:00.000Z"
    assert cli.main(["compare", pairs["calm"], "/none", "--quiet"], spark) == 2
    assert cli.main(["compare", pairs["calm"], pairs["wild"], "--json", out, "--sarif", out], spark) == 2
    target = str(tmp_path / "policy.yml")
    assert cli.main(["init", target]) == 0 and cli.main(["init", target]) == 2 and cli.main(["init", target, "--force"]) == 0
    assert cli.main(["compare", "a"]) == 2


def test_rollup(spark, report):
    top = A.rollup(report.findings).filter(F.col("pair_id").isNull() & F.col("category").isNull() & F.col("severity").isNull()).first()
    assert top["findings"] == 21
