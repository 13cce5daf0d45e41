"""Fixed rule tables: severities, capabilities, extensions, limits. Values, not logic."""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("info", "low", "medium", "high", "critical")
RANK = {s: i for i, s in enumerate(SEVERITIES)}
#: Finding categories.
CATEGORIES = ("network", "execution", "filesystem", "obfuscation", "install", "dependency", "binary", "metadata", "provenance", "inventory")
LEVELS = ((80, "critical"), (50, "high"), (25, "medium"), (1, "low"), (0, "none"))

#: Capability of a module's name, without a leading "node:".
MODULES = {
    "child_process": "child_process",
    "cluster": "child_process",
    "fs": "filesystem",
    "fs/promises": "filesystem",
    "http": "network",
    "https": "network",
    "net": "raw-network",
    "tls": "raw-network",
    "dgram": "raw-network",
    "dns": "dns",
    "vm": "dynamic-code",
    "module": "module-loader",
    "worker_threads": "worker-threads",
    "inspector": "inspector",
    "axios": "network",
    "got": "network",
    "undici": "network",
    "node-fetch": "network",
    "superagent": "network",
    "request": "network",
    "execa": "child_process",
    "cross-spawn": "child_process",
    "shelljs": "child_process",
    "fs-extra": "filesystem",
}

#: Capability -> (severity, score); others are medium, 8.
CAPABILITIES = {
    "child_process": ("critical", 34),
    "dynamic-code": ("critical", 32),
    "raw-network": ("high", 22),
    "network": ("high", 20),
    "filesystem": ("medium", 10),
    "dns": ("medium", 10),
    "module-loader": ("medium", 9),
    "worker-threads": ("low", 4),
    "inspector": ("high", 18),
    "environment": ("low", 4),
}
OTHER_CAPABILITY = ("medium", 8)

#: Category of the signals of a capability; others are execution.
CAPABILITY_CATEGORY = {"filesystem": "filesystem", "network": "network", "raw-network": "network", "dns": "network"}

#: File name endings.
CODE_EXTENSIONS = (".js", ".cjs", ".mjs", ".jsx", ".ts", ".cts", ".mts", ".tsx", ".es", ".es6", ".jsm")
BINARY_EXTENSIONS = (".exe", ".dll", ".so", ".dylib", ".node", ".wasm", ".bin", ".dat", ".jar")
NATIVE_EXTENSIONS = (".node", ".dll", ".so", ".dylib", ".exe")
GENERATED_SUFFIXES = (".map", ".min.js", ".bundle.js")
NON_CODE_EXTENSIONS = (
    ".md", ".markdown", ".mdx", ".txt", ".text", ".rst", ".adoc", ".license", ".flow",
    ".json", ".json5", ".jsonc", ".jsonl", ".ndjson", ".yml", ".yaml", ".toml", ".ini", ".cfg", ".conf", ".properties",
    ".html", ".htm", ".xhtml", ".xml", ".xsl", ".svg", ".css", ".scss", ".sass", ".less", ".styl",
    ".map", ".lock", ".snap", ".patch", ".diff", ".csv", ".tsv", ".proto", ".graphql", ".gql", ".sql", ".d",
    ".sh", ".bash", ".zsh", ".fish", ".ksh", ".ps1", ".psm1", ".bat", ".cmd", ".mk", ".makefile", ".cmake",
    ".py", ".pyi", ".rb", ".pl", ".pm", ".php", ".go", ".rs", ".java", ".scala", ".kt", ".kts", ".swift",
    ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".m", ".mm", ".cs", ".fs", ".ex", ".exs", ".erl", ".lua",
    ".vue", ".svelte", ".astro", ".hbs", ".handlebars", ".ejs", ".pug", ".jade", ".mustache", ".twig", ".liquid", ".njk",
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif", ".ico", ".bmp", ".tiff", ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".zip", ".gz", ".tgz", ".br", ".xz", ".bz2", ".7z", ".rar", ".pdf", ".mp3", ".mp4", ".webm", ".wav", ".ogg",
    *BINARY_EXTENSIONS,
)
#: Lifecycle scripts and manifest fields that name shipped files.
LIFECYCLE = ("preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly")
ENTRY_FIELDS = ("main", "module", "browser", "types", "typings", "unpkg", "jsdelivr", "bin", "exports", "imports")
DEPENDENCY_SCOPES = {"dependencies": "runtime", "optionalDependencies": "optional", "peerDependencies": "peer", "devDependencies": "development"}
CANDIDATE_SUFFIXES = ("", ".js", ".cjs", ".mjs", ".json", "/index.js", "/index.cjs", "/index.mjs")
DIRECTORY_IGNORES = ("**/.git/**", "**/node_modules/**")

#: Names whose call loads a module, or compiles a string into code.
LOADER_NAMES = ("require", "_load", "_compile", "_resolveFilename")
COMPILER_NAMES = ("eval", "Function", "constructor", "runInThisContext", "runInNewContext", "compileFunction")

#: Evidence rows that a finding keeps.
CAPS = {"capability": 8, "coverage": 8, "control": 8, "domain": 12, "host_side": 5, "file": 12, "dependency": 20, "text": 10}


@dataclass(frozen=True)
class Limits:
    """Bounds on one input; beyond them an input is an error, never partly clean."""

    max_files: int = 25_000
    max_total_bytes: int = 512 << 20
    max_file_bytes: int = 32 << 20
    max_archive_bytes: int = 128 << 20
    max_text_bytes: int = 2 << 20
    max_ratio: int = 100
    timeout_ms: int = 30_000


PROBE_BYTES, SNIFF_BYTES = 4096, 8192
EXECUTABLE, PLAIN, LINK = 0o755, 0o644, 0o777
