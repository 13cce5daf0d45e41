"""Sinks: reports of one pair as JSON, Markdown, SARIF, HTML and terminal text; baselines and atomic files.

Renderers take one row of Report.documents() as plain data (`as_document`).
"""

from __future__ import annotations

import html
import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .errors import InputError

NAME = "snapdelta"

#: Title and advice by the beginning of a rule id; the longest that fits.
TEXTS = {
    "capability.added.": ("New capability", "Find what needs it and read every file that the evidence names."),
    "network.domains.added": ("New network hosts", "Check who owns each host and what could be sent there."),
    "install-script.": ("Lifecycle script", "Read the command and the files it runs before any install."),
    "dependencies.non-registry.": ("Dependency from outside the registry", "Pin a release with an integrity value, or review that source."),
    "dependencies.runtime.added": ("New dependencies", "Review owners, age and scripts of each."),
    "binary.": ("Binary files", "Rebuild them from source and compare digests."),
    "files.executable.": ("Executable files", "Check that each is meant to run."),
    "files.symlink.": ("Symbolic links", "Check where each link leads."),
    "inventory.size.spike": ("Sharp growth", "Find what accounts for the growth."),
    "obfuscation.encoded-payload": ("Long encoded text", "Decode it in isolation."),
    "obfuscation.entropy-spike": ("Entropy rose", "Compare with the source it was built from."),
    "obfuscation.control-bytes": ("Control bytes in code", "Look at the raw bytes."),
    "payload.generated.added": ("Dense or generated code", "Reproduce it from source."),
    "metadata.maintainers.changed": ("Maintainers changed", "Confirm it with the project."),
    "metadata.": ("Package metadata changed", "Compare with the project's own pages."),
    "provenance.": ("Provenance weakened", "Ask why before approving."),
    "analysis.": ("Code that was not fully analysed", "Review it by hand; it may hold anything."),
}
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def texts(rule: str) -> tuple[str, str]:
    return TEXTS[max((k for k in TEXTS if rule.startswith(k)), key=len, default="analysis.")]


def as_document(row: Row | dict) -> dict:
    """Plain data without nulls and without binary columns."""

    def plain(v):
        if isinstance(v, Row):
            v = v.asDict()
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items() if x is not None and k != "ord"}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    out = plain(row)
    for f in out.get("findings", []):
        f["title"], f["remediation"] = texts(f["id"])
    for k in ("findings", "violations", "warnings", "added", "removed", "modified", "dependencies", "scripts"):
        out.setdefault(k, [])
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False)


def render_json(doc: dict) -> str:
    return canonical(doc) + "\n"


def escape_markdown(text: str) -> str:
    return re.sub(r"([\\`*_{}\[\]()<>#+!|~-])", r"\\\1", re.sub(r"[\x00-\x1f\x7f-\x9f  ]+", " ", str(text)))


def byte_label(n: int) -> str:
    for unit, name in ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")):
        if n >= unit:
            return f"{n / unit:.2f} {name}" if n < 10 * unit else f"{n / unit:.1f} {name}"
    return f"{n} B"


def _place(e: dict) -> str:
    return f"{e['file']}{':' + str(e['line']) if 'line' in e else ''}: " if "file" in e else ""


def render_markdown(doc: dict) -> str:
    m = escape_markdown
    shipped = sum(d["change"] == "added" and d["scope"] != "development" for d in doc["dependencies"])
    out = [
        "# Snapshot comparison", "",
        f"**{m(doc['before']['name'])} {m(doc['before']['version'])} → {m(doc['after']['version'])}**, risk {doc['score']}/100 ({doc['level']}), policy {'passed' if doc['passed'] else 'failed'}", "",
        f"Made at {doc['generated_at']}. No code of the package was run.", "", "| | |", "|---|---:|",
        f"| Files | +{len(doc['added'])} −{len(doc['removed'])} ~{len(doc['modified'])} |", f"| Bytes | {byte_label(doc['before_bytes'])} → {byte_label(doc['after_bytes'])} |",
        f"| Shipped dependencies added | {shipped} |", f"| Findings, new and accepted | {doc['new_findings']}, {doc['baseline_findings']} |", "",
    ]
    for title, rows in (("Violations", doc["violations"]), ("Warnings", doc["warnings"])):
        if rows:
            out += [f"## {title}", "", *[f"- {m(r['rule'])}: {m(r['message'])}" for r in rows], ""]
    out += ["## Findings", ""] + ([] if doc["findings"] else ["None.", ""])
    for f in doc["findings"]:
        out += [f"### {m(f['title'])}", "", f"{f['severity']}, {f['score']} points, {f['category']}, {f['status']}; `{f['id']}`, `{f['fingerprint']}`", ""]
        for e in f["evidence"]:
            out.append(f"- {m(_place(e) + e['message'])}" + (f" — {m(e['snippet'])}" if e.get("snippet") else ""))
        out += ["", m(f["remediation"]), ""]
    return "\n".join(out) + "\nFindings are heuristic: none does not mean safe.\n"


def workspace_path(doc: dict, file: str, workspace: str | None) -> str | None:
    """Path of an evidence file relative to the workspace, for folders inside it only."""
    if not workspace or doc["after"].get("source_kind") != "directory":
        return None
    root, full = os.path.realpath(workspace), os.path.realpath(os.path.join(doc["after"]["resolved"], file))
    return os.path.relpath(full, root).replace(os.sep, "/") if os.path.commonpath([root, full]) == root and full != root else None


def render_sarif(doc: dict, workspace: str | None = None) -> str:
    from urllib.parse import quote

    by_id = {f["id"]: f for f in doc["findings"]}  # the last of an id, at the place of the first
    named = [
        {"id": i, "name": "".join(w[:1].upper() + w[1:] for w in re.split("[.-]", i)), "shortDescription": {"text": f["title"]}, "help": {"text": f["remediation"]}, "properties": {"category": f["category"], "tags": f["tags"], "defaultSeverity": f["severity"]}}
        for i, f in by_id.items()
    ]
    results = []
    for f in doc["findings"]:
        first = f["evidence"][0] if f["evidence"] else {}
        result = {
            "ruleId": f["id"], "level": LEVELS[f["severity"]], "message": {"text": f"{f['title']}. {f['remediation']}"}, "partialFingerprints": {f"{NAME}Fingerprint": f["fingerprint"]},
            "baselineState": "unchanged" if f["status"] == "baseline" else "new", "properties": {k: f[k] for k in ("score", "severity", "category", "evidence")},
        }
        if "file" in first and (path := workspace_path(doc, first["file"], workspace)):
            where = {"artifactLocation": {"uri": quote(path)}} | ({"region": {"startLine": first["line"]}} if "line" in first else {})
            result["locations"] = [{"physicalLocation": where}]
        results.append(result)
    call = {"executionSuccessful": True, "exitCode": 0 if doc["passed"] else 1}
    if doc["warnings"]:
        call["toolExecutionNotifications"] = [{"descriptor": {"id": w["rule"]}, "level": "warning", "message": {"text": w["message"]}} for w in doc["warnings"]]
    run = {"tool": {"driver": {"name": NAME, "rules": named}}, "invocations": [call], "results": results}
    return canonical({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}) + "\n"


def script_json(value) -> str:
    """JSON that is safe inside a script element."""
    raw = json.dumps(value, ensure_ascii=False)
    for c in "<>&  ":
        raw = raw.replace(c, f"\\u{ord(c):04x}")
    return raw


def render_html(doc: dict, most_paths: int = 500) -> str:
    e = html.escape
    rows = "".join(
        f"<section class='{f['severity']}'><h3>{e(f['title'])}</h3><p>{e(f['severity'])}, {f['score']} points, {e(f['category'])}, {e(f['status'])} <code>{e(f['id'])}</code></p><ul>"
        + "".join(f"<li>{e(_place(x) + x['message'])}{' <code>' + e(x['snippet']) + '</code>' if x.get('snippet') else ''}</li>" for x in f["evidence"])
        + f"</ul><p>{e(f['remediation'])}</p></section>"
        for f in doc["findings"]
    )
    lists = "".join(f"<details><summary>{k} ({len(doc[k])})</summary><ul>{''.join(f'<li>{e(p["path"])}</li>' for p in doc[k][:most_paths])}</ul></details>" for k in ("added", "removed", "modified"))
    return (
        "<!doctype html><html lang='en'><meta charset='utf-8'><title>Snapshot comparison</title><style>body{font:16px sans-serif;max-width:60em;margin:2em auto}section{border-left:4px solid #888;padding-left:1em;margin:1em 0}.critical,.high{border-color:#b00}.medium{border-color:#c80}</style>"
        f"<h1>{e(doc['before']['name'])} {e(doc['before']['version'])} → {e(doc['after']['version'])}</h1><p>Risk {doc['score']}/100 ({e(doc['level'])}), policy {'passed' if doc['passed'] else 'failed'}</p>"
        f"<input id='q' placeholder='Search'>{rows or '<p>No findings.</p>'}{lists}<script type='application/json' id='data'>{script_json(doc)}</script>"
        "<script>q.oninput=()=>{for(const s of document.querySelectorAll('section'))s.hidden=!s.textContent.toLowerCase().includes(q.value.toLowerCase())}</script></html>\n"
    )


def terminal_text(text: str) -> str:
    """Text without escape sequences and control characters."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f‎‏‪-‮⁦-⁩]", " ", re.sub(r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)?|.)", "", str(text)))


def summary(doc: dict, most: int = 8) -> str:
    t = terminal_text
    new = [f for f in doc["findings"] if f["status"] == "new"]
    out = [f"{t(doc['before']['name'])}  {t(doc['before']['version'])} -> {t(doc['after']['version'])}", f"risk {doc['score']}/100 {doc['level']}, {len(new)} new findings", f"files +{len(doc['added'])} -{len(doc['removed'])} ~{len(doc['modified'])}"]
    out += [f"{f['severity']:8} {t(f['title'])} {t(f['evidence'][0].get('file', '') if f['evidence'] else '')}".rstrip() for f in new[:most]]
    if len(new) > most:
        out.append(f"... {len(new) - most} more")
    out.append("policy passed" if doc["passed"] else "policy failed: " + ", ".join(t(v["rule"]) for v in doc["violations"]))
    return "\n".join(out + [f"warning: {t(w['message'])}" for w in doc["warnings"]]) + "\n"


def _workflow(text: str) -> str:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        text = text.replace(a, b)
    return text


def annotations(doc: dict, workspace: str | None = None) -> list[str]:
    out = [f"::warning title={NAME} policy::{_workflow(w['message'])}" for w in doc["warnings"]]
    for f in doc["findings"]:
        if f["status"] == "new" and f["severity"] in ("critical", "high", "medium"):
            first = f["evidence"][0] if f["evidence"] else {}
            path = workspace_path(doc, first["file"], workspace) if "file" in first else None
            where = [f"file={_workflow(path)}"] if path else []
            if path and "line" in first:
                where.append(f"line={first['line']}")
            where.append(f"title={NAME} {f['severity']}")
            out.append(f"::{'warning' if f['severity'] == 'medium' else 'error'} {','.join(where)}::{_workflow(f['title'])}")
    return out


def write_file(path: str, text: str, overwrite: bool = True) -> None:
    """Whole or not at all; without `overwrite` an existing file is an input error."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    other = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        other.write_text(text, "utf-8")
        if overwrite:
            os.replace(other, target)
        else:
            try:
                os.link(other, target)
            except FileExistsError as e:
                raise InputError(f"{path} exists already") from e
    finally:
        other.unlink(missing_ok=True)


def write_baseline(found: DataFrame, path: str, generated_at: str) -> None:
    rows = found.select("fingerprint", "id").distinct().orderBy("fingerprint").toLocalIterator()
    write_file(path, canonical({"schemaVersion": 1, "generatedAt": generated_at, "findings": [{"fingerprint": r["fingerprint"], "id": r["id"], "title": texts(r["id"])[0]} for r in rows]}) + "\n")


def read_baseline(spark, path: str) -> DataFrame:
    """fingerprint and id of an accepted list; anything malformed is an input error."""
    try:
        document = json.loads(Path(path).read_text("utf-8"))
        good = document["schemaVersion"] == 1 and all(re.fullmatch("[0-9a-f]{32}", f["fingerprint"]) and isinstance(f["id"], str) and isinstance(f.get("title", ""), str) for f in document["findings"])
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise InputError(f"cannot read baseline {path}: {e}") from e
    if not good:
        raise InputError(f"{path} is no baseline of version 1")
    return spark.createDataFrame([(f["fingerprint"], f["id"]) for f in document["findings"]], "fingerprint string, id string")


def sarif_level(severity):
    """Column form of LEVELS."""
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.when(c.isin("critical", "high"), "error").when(c == "medium", "warning").otherwise("note")
