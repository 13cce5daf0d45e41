"""Snapshots from directories, archives and registry documents, as FILES and PACKAGES rows.

Listing is our own (Spark's file reader skips dot files and follows links). An input that can't
be read whole within the limits is an error row or an InputError, never a partly clean result.
Nothing of a package is ever executed or written out: archives are read in memory.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import re
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import rules
from ..errors import InputError
from ..functions.text import glob_regex
from ..schemas import FILES, PACKAGES

UNKNOWN_NAME, UNKNOWN_VERSION = "(unknown package)", "(unknown version)"


def is_text(data: bytes) -> bool:
    head = data[: rules.SNIFF_BYTES]
    return 0 not in head and (not head or sum(b < 7 or 14 < b < 32 for b in head) / len(head) < 0.15)


def normal_mode(mode: int, kind: str) -> int:
    return rules.LINK if kind == "symlink" else rules.EXECUTABLE if mode & 0o111 else rules.PLAIN


def _file(path: str, data: bytes, mode: int, known: bool, limits: rules.Limits) -> dict:
    kind = "text" if is_text(data) else "binary"
    whole = len(data) <= limits.max_text_bytes
    return {"path": path, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "mode": normal_mode(mode, kind), "mode_known": known, "kind": kind, "content": data if whole else None, "probe": None if whole else data[: rules.PROBE_BYTES]}


def _ignored(path: str, globs: list[re.Pattern]) -> bool:
    return any(g.search(path) for g in globs)


def _globs(ignore: list[str] | tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(glob_regex(g)) for g in ignore]


def modes_reliable(path: str) -> bool:
    """Whether permission bits of this file system mean anything."""
    return os.name != "nt"


def scan_directory(folder: str, limits: rules.Limits = rules.Limits(), ignore: tuple[str, ...] = ()) -> Iterator[dict]:
    """Every regular file and link below `folder`, by name at each level, depth first; links are not followed."""
    globs = _globs((*rules.DIRECTORY_IGNORES, *ignore))
    known = modes_reliable(folder)
    seen = total = 0
    stack = [("", folder)]
    while stack:
        prefix, at = stack.pop()
        below = []
        for entry in sorted(os.scandir(at), key=lambda e: e.name.encode("utf-16-be", "surrogatepass")):
            seen += 1
            if seen > limits.max_files:
                raise InputError(f"{folder} has more than {limits.max_files} entries")
            path = prefix + entry.name
            if _ignored(path, globs) or entry.is_dir(follow_symlinks=False) and _ignored(path + "/x", globs):
                continue
            if entry.is_symlink():
                target = os.readlink(entry.path).encode("utf-8", "surrogateescape")
                below.append({"path": path, "size": len(target), "sha256": hashlib.sha256(target).hexdigest(), "mode": rules.LINK, "mode_known": known, "kind": "symlink", "content": None, "probe": None})
            elif entry.is_dir(follow_symlinks=False):
                below.append((path + "/", entry.path))
            elif entry.is_file(follow_symlinks=False):
                info = entry.stat(follow_symlinks=False)
                total += info.st_size
                if info.st_size > limits.max_file_bytes or total > limits.max_total_bytes:
                    raise InputError(f"{path} exceeds the size limits")
                if path == "package.json" and info.st_size > limits.max_text_bytes:
                    raise InputError("package.json is too large to read")
                with open(entry.path, "rb") as f:
                    below.append(_file(path, f.read(), info.st_mode, known, limits))
        for x in below:
            if isinstance(x, dict):
                yield x
        stack += [x for x in reversed(below) if isinstance(x, tuple)]


def safe_path(path: str) -> bool:
    p = path.replace("\\", "/")
    return not ("\0" in p or p.startswith("/") or re.match("[A-Za-z]:", p) or ".." in p.split("/"))


class _Bounded(io.RawIOBase):
    """Reads on, up to a number of bytes; then it is an input error."""

    def __init__(self, raw, most: int):
        self.raw_file, self.left = raw, most

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.raw_file.read(len(b))
        self.left -= len(data)
        if self.left < 0:
            raise InputError("the archive unpacks to more than the limits allow")
        b[: len(data)] = data
        return len(data)


def scan_archive(data: bytes, limits: rules.Limits = rules.Limits(), ignore: tuple[str, ...] = ()) -> Iterator[dict]:
    """Files of a tar archive, gzipped or not, below its root; hostile members are input errors."""
    if len(data) > limits.max_archive_bytes:
        raise InputError("the archive is larger than the limit")
    packed = data[:2] == b"\x1f\x8b"
    most = min(limits.max_total_bytes + limits.max_files * 1536 + 10240, max(len(data), 1) * limits.max_ratio if packed else 1 << 62)
    stream = io.BufferedReader(_Bounded(gzip.GzipFile(fileobj=io.BytesIO(data)) if packed else io.BytesIO(data), most), 1 << 16)
    members: dict[str, tuple[bytes, int]] = {}
    n = total = 0
    try:
        with tarfile.open(fileobj=stream, mode="r|") as tar:
            for m in tar:
                n += 1
                if n > limits.max_files:
                    raise InputError(f"the archive has more than {limits.max_files} entries")
                if not safe_path(m.name):
                    raise InputError(f"unsafe path in the archive: {m.name[:200]!r}")
                if m.isdir():
                    continue
                if not m.isreg():
                    raise InputError(f"the archive holds an entry that is no plain file: {m.name[:200]!r}")
                total += m.size
                if m.size > limits.max_file_bytes or total > limits.max_total_bytes:
                    raise InputError(f"{m.name[:200]!r} exceeds the size limits")
                path = re.sub("/+$", "", re.sub(r"^(\./)+", "", m.name.replace("\\", "/")))
                members[path] = (tar.extractfile(m).read(), m.mode)
    except (tarfile.TarError, EOFError, OSError, gzip.BadGzipFile) as e:
        raise InputError(f"not a readable archive: {e}") from e
    yield from _members(members, limits, ignore)


def _members(members: dict[str, tuple[bytes, int]], limits: rules.Limits, ignore: tuple[str, ...]) -> Iterator[dict]:
    """FILES rows of unpacked members; every member below the root is listed or ignored by name."""
    root = archive_root(list(members))
    globs = _globs(ignore)
    paths = sorted((p.removeprefix(root) for p in members), key=lambda p: [x.encode("utf-16-be", "surrogatepass") for x in p.split("/")])
    folded: dict[str, str] = {}
    for path in paths:
        if folded.setdefault(path.lower(), path) != path:
            raise InputError(f"paths that differ only in case: {folded[path.lower()]!r}, {path!r}")
    for path in paths:
        if not _ignored(path, globs):
            content, mode = members[root + path]
            if path == "package.json" and len(content) > limits.max_text_bytes:
                raise InputError("package.json is too large to read")
            yield _file(path, content, mode, True, limits)


def scan_zip(data: bytes, limits: rules.Limits = rules.Limits(), password: bytes | None = None, ignore: tuple[str, ...] = ()) -> Iterator[dict]:
    """Files of a ZIP archive, encrypted or not, below its root, under the same rules as tar archives."""
    if len(data) > limits.max_archive_bytes:
        raise InputError("the archive is larger than the limit")
    members: dict[str, tuple[bytes, int]] = {}
    total = 0
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if len(infos) > limits.max_files:
                raise InputError(f"the archive has more than {limits.max_files} entries")
            for info in infos:
                mode = info.external_attr >> 16
                if not safe_path(info.filename):
                    raise InputError(f"unsafe path in the archive: {info.filename[:200]!r}")
                if info.is_dir():
                    continue
                if stat.S_IFMT(mode) not in (0, stat.S_IFREG):
                    raise InputError(f"the archive holds an entry that is no plain file: {info.filename[:200]!r}")
                with z.open(info, pwd=password) as f:
                    content = f.read(limits.max_file_bytes + 1)
                total += len(content)
                if len(content) > limits.max_file_bytes or total > min(limits.max_total_bytes, max(len(data), 1) * limits.max_ratio):
                    raise InputError(f"{info.filename[:200]!r} exceeds the size limits")
                members[info.filename.replace("\\", "/")] = (content, mode or rules.PLAIN)
    except (zipfile.BadZipFile, RuntimeError, EOFError, OSError, NotImplementedError) as e:
        raise InputError(f"not a readable archive: {e}") from e
    yield from _members(members, limits, ignore)


def archive_root(paths: list[str]) -> str:
    """The folder that holds the package, with its slash; another folder beside package/ is an input error."""
    tops = {p.split("/", 1)[0] for p in paths}
    if "package/package.json" in paths:
        if len(tops) > 1:
            raise InputError(f"entries beside the package folder: {', '.join(sorted(tops - {'package'})[:5])}")
        return "package/"
    return tops.pop() + "/" if len(tops) == 1 and all("/" in p for p in paths) else ""


# --- manifests ---------------------------------------------------------------


def _strings(value: object) -> dict[str, str]:
    return {k: v for k, v in value.items() if isinstance(v, str)} if isinstance(value, dict) else {}


def _list(value: object) -> list[str]:
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def people(value: object) -> list[str]:
    out = []
    for v in value if isinstance(value, list) else [] if value is None else [value]:
        if isinstance(v, dict):
            name, mail = (v[k].strip() if isinstance(v.get(k), str) else "" for k in ("name", "email"))
            v = f"{name or '(unknown)'} <{mail.lower()}>" if mail else name
        if isinstance(v, str) and v:
            out.append(v)
    return out


def entry_points(document: dict) -> list[str]:
    found: set[str] = set()
    stack = [(document.get(f), 0) for f in rules.ENTRY_FIELDS]
    while stack:
        value, depth = stack.pop()
        if depth > 8:
            continue
        if isinstance(value, str):
            if value and "*" not in value:
                found.add(value)
        elif isinstance(value, (list, dict)):
            stack += [(v, depth + 1) for v in (value.values() if isinstance(value, dict) else value)]
    return sorted(found, key=lambda s: s.encode("utf-16-be", "surrogatepass"))


def parse_manifest(raw: bytes | None, name: str | None = None, version: str | None = None) -> dict:
    """The manifest as a PACKAGES part; fields of a wrong type are dropped, invalid JSON is an input error."""
    document: object = {}
    if raw is not None:
        try:
            document = json.loads(raw.decode("utf-8", "replace"), parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        except (ValueError, RecursionError) as e:
            raise InputError(f"package.json is not valid: {e}") from e
    d = document if isinstance(document, dict) else {}
    text = lambda k: d[k] if isinstance(d.get(k), str) else None
    repository = d.get("repository")
    repository = repository if isinstance(repository, str) else repository["url"] if isinstance(repository, dict) and isinstance(repository.get("url"), str) else None
    bundled = d.get("bundledDependencies") if d.get("bundledDependencies") is not None else d.get("bundleDependencies")
    return {
        "name": text("name") if text("name") is not None else name or UNKNOWN_NAME, "version": text("version") if text("version") is not None else version or UNKNOWN_VERSION,
        "description": text("description"), "license": text("license"), "repository": repository or None, "engines": _strings(d.get("engines")), "scripts": _strings(d.get("scripts")),
        "dependencies": _strings(d.get("dependencies")), "optional_dependencies": _strings(d.get("optionalDependencies")), "peer_dependencies": _strings(d.get("peerDependencies")),
        "dev_dependencies": _strings(d.get("devDependencies")), "bundled": _list(bundled), "maintainers": people(d.get("maintainers") if d.get("maintainers") is not None else d.get("author")),
        "entry_points": entry_points(d), "files": _list(d["files"]) if isinstance(d.get("files"), list) else None,
    }


# --- registry documents, offline -----------------------------------------------

_SPECIFIER = re.compile(r"^(@[a-z0-9][a-z0-9._-]*/[a-z0-9._-]+|[a-z0-9][a-z0-9._-]*)(?:@(.+))?$", re.I)


def parse_specifier(text: str) -> tuple[str, str]:
    """Name and version (latest where none is given) of name[@version]."""
    m = _SPECIFIER.match(text.strip())
    if not m:
        raise InputError(f"not a package name: {text!r}")
    return m[1], m[2] or "latest"


def normal_registry(url: str) -> str:
    u = urlsplit(url)
    if u.scheme != "https" or not u.hostname:
        raise InputError(f"a registry address begins with https: {url!r}")
    return f"https://{u.hostname}{f':{u.port}' if u.port else ''}{u.path.rstrip('/')}/"


def verify_digest(data: bytes, integrity: str | None = None, shasum: str | None = None) -> None:
    """An integrity string (the strongest known algorithm counts) or else a SHA-1 must match."""
    import base64

    if integrity is not None:
        best: dict[str, set[str]] = {}
        for token in integrity.split():
            name, _, digest = token.partition("-")
            if name in ("sha256", "sha384", "sha512"):
                digest = digest.split("?")[0]
                if not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", digest):
                    raise InputError(f"malformed integrity value: {token[:80]!r}")
                best.setdefault(name, set()).add(digest)
        for name in ("sha512", "sha384", "sha256"):
            if name in best:
                if base64.b64encode(hashlib.new(name, data).digest()).decode() not in best[name]:
                    raise InputError("the archive does not match its integrity value")
                return
        raise InputError("the integrity value names no known algorithm")
    if shasum is not None and hashlib.sha1(data).hexdigest() != shasum.lower():
        raise InputError("the archive does not match its checksum")


def registry_entry(document: dict, version: str) -> dict:
    """Source columns of one version of a registry document; wrong types are input errors."""
    tags, versions = document.get("dist-tags") or {}, document.get("versions") or {}
    found = versions.get(tags.get(version, version))
    if not isinstance(found, dict):
        raise InputError(f"the registry has no version {version!r}")
    dist = found.get("dist") or {}
    for field in ("tarball", "integrity", "shasum"):
        if dist.get(field) is not None and not isinstance(dist[field], str):
            raise InputError(f"registry field {field} is no text")
    return {
        "source_kind": "registry", "resolved": dist.get("tarball"), "integrity": dist.get("integrity"), "shasum": dist.get("shasum"), "attestations": bool((dist.get("attestations") or {}).get("url")),
        "signatures": bool(dist.get("signatures")), "source_maintainers": people(found.get("maintainers") or document.get("maintainers")),
    }


# --- relations -----------------------------------------------------------------


def load(source: str, limits: rules.Limits = rules.Limits(), ignore: tuple[str, ...] = ()) -> tuple[list[dict], dict]:
    """Files and the PACKAGES part of one input: a folder, or a .tgz, .tar.gz or .tar file."""
    if os.path.isdir(source):
        files, kind = list(scan_directory(source, limits, ignore)), "directory"
    elif os.path.isfile(source):
        if not re.search(r"\.(?:tgz|tar\.gz|tar)$", source, re.I):
            raise InputError(f"not an archive: {source}")
        if os.path.getsize(source) > limits.max_archive_bytes:
            raise InputError("the archive is larger than the limit")
        with open(source, "rb") as f:
            files, kind = list(scan_archive(f.read(), limits, ignore)), "tarball"
    else:
        raise InputError(f"no such input (registry names need the network): {source}")
    manifest = next((f for f in files if f["path"] == "package.json" and f["kind"] == "text"), None)
    package = parse_manifest(manifest["content"] if manifest else None)
    return files, package | {"source_kind": kind, "resolved": os.path.abspath(source), "integrity": None, "attestations": None, "signatures": None, "source_maintainers": []}


class SnapshotSource(DataSource):
    """spark.read.format("snapshots"): FILES or PACKAGES of many inputs, one partition for each input.

    Options: inputs, JSON rows of pair_id, side and input; relation, files or packages; strict,
    whether a bad input raises (else it is an error row of the relation errors).
    """

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return {"files": FILES, "packages": PACKAGES, "errors": "pair_id string, side string, error_code int, error_message string"}[self.options.get("relation", "files")]

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options, [f.name for f in schema.fields])


class _SnapshotReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.inputs, self.relation, self.columns = json.loads(options["inputs"]), options.get("relation", "files"), columns
        self.limits = rules.Limits(**json.loads(options.get("limits", "{}")))
        self.ignore, self.strict = tuple(json.loads(options.get("ignore", "[]"))), options.get("strict", "true") == "true"

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.inputs))]

    def read(self, partition):
        at = self.inputs[partition.value]
        key = {"pair_id": at["pair_id"], "side": at["side"]}
        try:
            files, package = load(at["input"], self.limits, self.ignore)
        except InputError as e:
            if self.relation == "errors":
                yield tuple((key | {"error_code": e.exit_code, "error_message": str(e)})[c] for c in self.columns)
            elif self.strict:
                raise
            return
        rows = {"files": files, "packages": [package], "errors": []}[self.relation]
        for row in rows:
            row = key | row
            yield tuple(row.get(c) for c in self.columns)


def read(spark: SparkSession, inputs: list[dict], relation: str = "files", limits: rules.Limits = rules.Limits(), ignore: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    spark.dataSource.register(SnapshotSource)
    options = {"inputs": json.dumps(inputs), "relation": relation, "limits": json.dumps(limits.__dict__), "ignore": json.dumps(list(ignore)), "strict": str(strict).lower()}
    return spark.read.format("snapshots").options(**options).load()


def read_archives(archives: DataFrame, limits: rules.Limits = rules.Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FILES, PACKAGES and errors of a relation of archives (pair_id, side, content and, where known, integrity and shasum)."""
    integrity, shasum = (F.col(c) if c in archives.columns else F.lit(None).cast("string").alias(c) for c in ("integrity", "shasum"))
    rows = archives.select("pair_id", "side", "content", integrity, shasum)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.to_dict("records"):
                key = {"pair_id": row["pair_id"], "side": row["side"]}
                try:
                    verify_digest(row["content"], row["integrity"], row["shasum"])
                    files = list(scan_archive(row["content"], limits))
                    manifest = next((f["content"] for f in files if f["path"] == "package.json"), None)
                    package = json.dumps(parse_manifest(manifest))
                except InputError as e:
                    yield pd.DataFrame([key | dict.fromkeys(("path", "size", "sha256", "mode", "mode_known", "kind", "content", "probe", "package")) | {"error_message": str(e)}])
                    continue
                yield pd.DataFrame([key | f | {"package": None, "error_message": None} for f in files] + [key | dict.fromkeys(("path", "size", "sha256", "mode", "mode_known", "kind", "content", "probe", "error_message")) | {"package": package}])

    got = rows.mapInPandas(run, FILES + ", package string, error_message string").persist()
    own = [f.strip().split(" ", 1)[0] for f in PACKAGES.split(", ")]
    parsed = got.filter("package is not null").select("pair_id", "side", F.from_json("package", PACKAGES).alias("p"))
    packages = parsed.select("pair_id", "side", *[F.lit("tarball").alias(c) if c == "source_kind" else F.col(f"p.{c}").alias(c) for c in own[2:]])
    return got.filter("path is not null").drop("package", "error_message"), packages, got.filter("error_message is not null").select("pair_id", "side", F.lit(2).alias("error_code"), "error_message")
