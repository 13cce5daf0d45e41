"""Column expressions over paths, texts, hosts, specifiers and numbers; all but `entropy` run without Python."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import rules

#: White space as the analysed language has it: also no-break space, byte order mark, line and paragraph separators.
SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD_START, WORD_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def unit_order(c: Column | str) -> Column:
    """Sort key with the order of UTF-16 code units."""
    return F.encode(col(c), "UTF-16BE")


def unit_length(c: Column | str) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def valid_text(c: Column | str) -> Column:
    """Bytes as text, malformed sequences replaced."""
    return F.make_valid_utf8(col(c).cast("string"))


def without_mark(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\x{FEFF}", "")


def truncate(c: Column | str, limit: int = 180) -> Column:
    """White space collapsed and trimmed; longer than `limit` ends in an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(col(c), f"{SPACE}+", " "), "^ | $", "")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def byte_label(c: Column | str) -> Column:
    """B, KB, MB or GB; two decimals below 10, else one, rounded half up on integers."""
    n = col(c).cast("long")

    def scaled(unit: int, name: str) -> Column:
        hundredths = F.floor((n * 200 + unit) / (2 * unit)).cast("long")
        tenths = F.floor((n * 20 + unit) / (2 * unit)).cast("long")
        two = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
        one = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        return F.concat(F.when(n < 10 * unit, two).otherwise(one), F.lit(" " + name))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1 << 10, "KB")).when(n < 1 << 30, scaled(1 << 20, "MB")).otherwise(scaled(1 << 30, "GB"))


def thousands(c: Column | str) -> Column:
    return F.format_number(col(c).cast("long"), 0)


def octal(c: Column | str) -> Column:
    return F.conv((col(c).bitwiseAND(511)).cast("string"), 10, 8)


def fingerprint(package: Column | str, rule: Column | str, identity: Column | str) -> Column:
    """First 32 hex digits over name, rule and identity, parted by NUL."""
    nul = F.lit("\x00")
    return F.substring(F.sha2(F.concat(col(package), nul, col(rule), nul, col(identity)).cast("binary"), 256), 1, 32)


def rank(severity: Column | str) -> Column:
    c = col(severity)
    return reduce(lambda w, s: w.when(c == s, rules.RANK[s]), rules.SEVERITIES[1:], F.when(c == rules.SEVERITIES[0], 0))


def level(score: Column | str) -> Column:
    c = col(score)
    return reduce(lambda w, x: w.when(c >= x[0], x[1]), rules.LEVELS[1:-1], F.when(c >= rules.LEVELS[0][0], rules.LEVELS[0][1])).otherwise("none")


# --- paths -----------------------------------------------------------------


def extension(path: Column | str) -> Column:
    """Lower-case extension of the base name, closing dots and white space ignored; a dot file has none."""
    base = F.regexp_replace(F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), "(?s)^.*/", ""), rf"(?:[.]|{SPACE})++$", "")
    return F.lower(F.regexp_extract(base, r"(?s)^.+(\.[^.]*)$", 1))


def safe_path(path: Column | str) -> Column:
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return ~(p.contains("\x00") | p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), ".."))


def normal_path(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^(\./)+", ""), "/+$", "")


def normal_mode(mode: Column | str, kind: Column | str) -> Column:
    return F.when(col(kind) == "symlink", rules.LINK).when(col(mode).bitwiseAND(0o111) != 0, rules.EXECUTABLE).otherwise(rules.PLAIN)


def is_binary_file(kind: Column | str, path: Column | str) -> Column:
    return (col(kind) == "binary") | extension(path).isin(*rules.BINARY_EXTENSIONS)


def is_native_file(path: Column | str) -> Column:
    return extension(path).isin(*rules.NATIVE_EXTENSIONS)


def is_executable(kind: Column | str, mode: Column | str, known: Column | str) -> Column:
    return col(known) & (col(kind) != "binary") & (col(mode).bitwiseAND(0o111) != 0)


def code_reason(path: Column | str, kind: Column | str, head: Column | str, entry_reason: Column | str) -> Column:
    """Why a file counts as code: extension, the entry reason, shebang or content; null if it doesn't."""
    ext, first = extension(path), without_mark(head)
    shebang, js = first.startswith("#!"), first.rlike(r"^#![^\n]*?(?<![A-Za-z0-9_])(?:node(?:js)?|bun|deno|ts-node|tsx|qjs)(?![A-Za-z0-9_])")
    no = F.lit(None).cast("string")
    return (
        F.when(col(kind) == "symlink", no)
        .when(ext.isin(*rules.CODE_EXTENSIONS), "extension")
        .when(shebang & ~js, no)
        .when(col(entry_reason).isNotNull(), col(entry_reason))
        .when(ext.isin(*rules.NON_CODE_EXTENSIONS), no)
        .when(js, "shebang")
        .when(sniff_score(first) >= 3, "content")
        .otherwise(no)
    )


#: Fixed values: (weight, pattern) of marks of program text; 3 in sum suffice.
SNIFFS = (
    (2, WORD_START + r"require\s*\(\s*['\"`]"),
    (2, WORD_START + r"module\s*\.\s*exports" + WORD_END),
    (2, r"(?m)^\s*(?:import|export)" + WORD_END + r"[^\n]*" + WORD_START + r"from\s*['\"]"),
    (1, WORD_START + r"exports\s*\.\s*[A-Za-z_$]"),
    (1, WORD_START + r"function\s*[*A-Za-z_$(]"),
    (1, r"=>\s*[{(A-Za-z_$'\"`]"),
    (1, WORD_START + r"(?:const|let|var)\s+[A-Za-z_$][A-Za-z0-9_$]*\s*="),
    (1, WORD_START + r"class\s+[A-Za-z_$][A-Za-z0-9_$]*\s*(?:extends" + WORD_END + r"|\{)"),
    (1, WORD_START + r"(?:async\s+)?function\s*\*?\s*[A-Za-z_$]*\s*\([^)]*\)\s*\{"),
)


def sniff_score(text: Column | str) -> Column:
    return reduce(lambda a, b: a + b, [F.when(col(text).rlike(p), w).otherwise(0) for w, p in SNIFFS])


# --- bytes -----------------------------------------------------------------


def latin(c: Column | str) -> Column:
    """Bytes as one character each."""
    return F.decode(col(c), "ISO-8859-1")


def is_text_bytes(content: Column | str) -> Column:
    """No NUL in the first 8192 bytes, and under 15 % control bytes."""
    head = latin(F.substring(col(content), 1, rules.SNIFF_BYTES))
    odd = F.regexp_count(head, F.lit(r"[\x{00}-\x{06}\x{0F}-\x{1F}]"))
    return (F.length(head) == 0) | (~head.contains("\x00") & (odd / F.length(head) < 0.15))


def control_count(content: Column | str) -> Column:
    return F.regexp_count(latin(content), F.lit(r"[\x{00}-\x{06}\x{0F}-\x{1F}]"))


@F.pandas_udf(DoubleType())
def entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes in bits; 0 without bytes. Each value is counted in one pass, in Arrow batches."""

    def bits(x: bytes | None) -> float:
        if not x:
            return 0.0
        n = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        share = n[n > 0] / len(x)
        return float(-(share * np.log2(share)).sum()) + 0.0

    return content.map(bits).astype(float)


def line_stats(text: Column | str) -> Column:
    """struct(lines, longest, average) in UTF-16 units; lines end in LF or CR LF."""
    parts = F.split(col(text), r"\r?\n", -1)
    return F.struct(F.size(parts).alias("lines"), F.array_max(F.transform(parts, unit_length)).alias("longest"), (unit_length(text) / F.greatest(F.lit(1), F.size(parts))).alias("average"))


def encoded_token(text: Column | str, base64_run: int = 240, hex_pairs: int = 180, bits: float = 3.5) -> Column:
    """struct(kind, token, entropy) of the first long base64 run, else of the first long hex run; null without."""
    b = F.regexp_extract(col(text), f"[A-Za-z0-9+/]{{{base64_run},}}={{0,2}}", 0)
    h = F.regexp_extract(col(text), f"(?:[a-fA-F0-9]{{2}}){{{hex_pairs},}}", 0)
    made = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("token"), entropy(t.cast("binary")).alias("entropy"))
    return F.when((b != "") & (entropy(b.cast("binary")) >= bits), made("Base64-like", b)).when((h != "") & (entropy(h.cast("binary")) >= bits), made("hex-like", h))


def line_number(text: Column | str, offset: Column | str) -> Column:
    """1 + line feeds before a 0-based offset."""
    return F.regexp_count(F.substring(col(text), F.lit(1), col(offset)), F.lit("\n")) + 1


def line_at(text: Column | str, offset: Column | str) -> Column:
    return F.get(F.split(col(text), "\n", -1), line_number(text, offset) - 1)


# --- hosts and dependency specifiers -----------------------------------------

#: Address literals in source text, slashes perhaps escaped.
URL = r"(?i)(?<![A-Za-z0-9_])https?:\\?/\\?/((?:[\p{L}\p{N}][\p{L}\p{N}.-]*)|\[[a-f0-9:]+\])(?::\d+)?(?:[/?#]|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Private hosts, throw-away services, commands that fetch or run.
PRIVATE = r"^(?:localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|\d+\.\d+\.\d+\.\d+)$"
DISPOSABLE = r"(?i)(?:ngrok|requestbin|webhook\.site|pastebin|discord(?:app)?\.com)$"
DANGEROUS = r"(?i)(?:curl|wget|powershell|certutil|base64|node\s+-e|/dev/tcp|child_process|https?://)"


def hosts(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(URL), F.lit(1)), F.lower)


def private_host(host: Column | str) -> Column:
    return col(host).rlike(PRIVATE)


def disposable_host(host: Column | str, strict: bool = False) -> Column:
    """Whether the host ends in a throw-away service; `strict` also asks for a label boundary before it."""
    return col(host).rlike(r"(?i)(?:^|\.)" + DISPOSABLE.removeprefix("(?i)") if strict else DISPOSABLE)


def dangerous_command(command: Column | str) -> Column:
    return col(command).rlike(DANGEROUS)


#: Forms of a specifier that no registry serves.
NON_REGISTRY = (
    r"(?i)^(?:file|link|workspace|https?|ssh|git(?:\+[^:]+)?|github|gitlab|bitbucket):",
    r"(?i)^(?:\.{1,2}|[a-z]:)$",
    r"(?i)^(?:\.{1,2}[\\/]|[/\\]|~[\\/]|[a-z]:(?:[\\/]|(?=[^\\/])))",
    r"(?i)^(?![~^<>=*|])[^:\s]+\.(?:tgz|tar(?:\.gz)?)$",
    r"^[^@\s]+@[^:\s]+:.+",
    r"^[^:\s\\/]+[\\/][^\s]*$",
)


def non_registry(specifier: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(col(specifier), F.lit("")), f"^{SPACE}+", ""), f"{SPACE}+$", "")
    registry = (s == "") | s.rlike("(?i)^npm:") | s.rlike(r"^@[^/\\#:@\s]+/[^/\\#:@\s]+(?:@[^/\\#:\r\n]+)?$")
    return F.when(registry, False).otherwise(reduce(lambda a, b: a | b, [s.rlike(p) for p in NON_REGISTRY]))


# --- globs -------------------------------------------------------------------


def glob_regex(glob: str, nocase: bool = False) -> str:
    """A regular expression for * ** ? [] {} and plain text; other glob syntax is an error."""
    if glob.startswith(("!", "#")) or any(x in glob for x in ("@(", "+(", "!(", "?(", "*(")):
        raise ValueError(f"unsupported glob: {glob}")
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r".^$+()|\[]{}" else c
        i += 1
    return ("(?i)" if nocase else "") + f"^{out}$"


def matches_any(c: Column | str, globs: list[str] | tuple[str, ...], nocase: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [col(c).rlike(glob_regex(g, nocase)) for g in globs], F.lit(False))
