"""Column expressions against tables of cases."""

import math

import pytest
from pyspark.sql import functions as F

from snapdelta.functions import text as T


def values(spark, cases, f, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_extension(spark):
    cases = ["a.JS", "dir.x/file", ".npmrc", "a.js. ", "x\\y.MJS", "a.tar.gz", "a.", "d/.hidden.js", "", "a.js\t", "a.js.\n \u00a0.", "a\n.ts"]
    assert values(spark, cases, T.extension) == [".js", "", "", ".js", ".mjs", ".gz", "", ".js", "", ".js", ".js", ".ts"]


def test_safe_path(spark):
    good = ["a/b", "..a/b", "./a"]
    bad = ["../a", "a/../b", "/a", "C:x", "a\\..\\b", "a\x00b"]
    assert values(spark, good + bad, T.safe_path) == [True] * 3 + [False] * 6


@pytest.mark.parametrize("spec", "file:../x link:x workspace:* http://h/x https://h/x.tgz ssh://h git+ssh://h/x git://h github:a/b gitlab:a/b bitbucket:a/b a/b a/b#main . .. c: ./x ../x /x \\x ~/x C:\\x x.tgz x.tar.gz x.tar git@h:a/b @s/n/x @s/n\\x".split())
def test_non_registry(spark, spec):
    assert values(spark, [spec], T.non_registry) == [True]


@pytest.mark.parametrize("spec", ["", "1.2.3", "^1", "~2", ">=1 <2", "*", "latest", "npm:x@1", "@s/n", "@s/n@1.x", "1 || 2", "x"])
def test_registry(spark, spec):
    assert values(spark, [spec], T.non_registry) == [False]


def test_entropy_and_bytes(spark):
    cases = [b"", b"aaaa", bytes(range(256)), b"ab" * 8, b"\x00\x01text", "é".encode()]
    got = values(spark, cases, T.entropy, "binary")
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, [0, 0, 8, 1, got[4], 1]))
    assert values(spark, cases, T.control_count, "binary") == [0, 0, 24, 0, 2, 0]
    assert values(spark, [b"", b"text\n", b"a\x00b", b"\x01" * 2 + b"a" * 8, b"\x07\x0e\x0d"], T.is_text_bytes, "binary") == [True, True, False, False, True]


def test_text_helpers(spark):
    assert values(spark, ["a \n\t b\u00a0\ufeffc ", "x" * 181, "x" * 180], T.truncate) == ["a b c", "x" * 179 + "…", "x" * 180]
    assert values(spark, [0, 1023, 1024, 10239, 10240, 5 << 20, 3 << 30], T.byte_label, "long") == ["0 B", "1023 B", "1.00 KB", "10.00 KB", "10.0 KB", "5.00 MB", "3.00 GB"]
    assert values(spark, ["a", "😀", "é"], T.unit_length) == [1, 2, 1]
    assert values(spark, [420, 493], T.octal, "int") == ["644", "755"]
    order = spark.createDataFrame([("😀",), ("\uffee",), ("a",)], "x string").orderBy(T.unit_order("x")).collect()
    assert [r["x"] for r in order] == ["a", "😀", "\uffee"]
    assert values(spark, [b"ok", b"\xff\xfe"], T.valid_text, "binary")[0] == "ok"
    assert values(spark, ["a\nbc\nd"], lambda c: F.struct(T.line_number(c, F.lit(3)), T.line_at(c, F.lit(3))))[0] == (2, "bc")


def test_hosts_and_flags(spark):
    assert values(spark, ["see https://A.b/x http:\\/\\/c.d:80/ xhttps://no"], T.hosts) == [["a.b", "c.d"]]
    assert values(spark, ["localhost", "10.0.0.1", "127.0.0.1", "8.8.8.8", "example.com"], T.private_host) == [True] * 4 + [False]
    assert values(spark, ["x.ngrok", "x.ngrok.io", "discordapp.com"], T.disposable_host) == [True, False, True]
    assert values(spark, ["notpastebin", "a.pastebin"], lambda c: T.disposable_host(c, strict=True)) == [False, True]
    assert values(spark, ["curl x", "echo", "node  -e 1"], T.dangerous_command) == [True, False, True]


def test_encoded_token(spark):
    varied = "".join(chr(97 + i % 26) + str(i % 10) for i in range(130))
    got = values(spark, ["a" * 300, varied, "0123456789abcdef" * 30, "short"], T.encoded_token)
    assert got[0] is None and got[1]["kind"] == "Base64-like" and got[2]["kind"] == "Base64-like" and got[3] is None


def test_code_reason(spark):
    rows = [("a.ts", "text", "", None), ("a", "text", "#!/usr/bin/env node\n", None), ("a", "text", "#!/bin/sh\n", "manifest-entry"), ("a.md", "text", "", "manifest-entry"), ("a.md", "text", "require('x')\nmodule.exports=1", None), ("a.dat2", "text", "\ufeffrequire('x')\nmodule.exports=1", None), ("a", "text", "plain words", None), ("a.js", "symlink", "", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, k string, h string, e string").orderBy("i")
    assert [r[0] for r in df.select(T.code_reason("p", "k", F.col("h"), "e")).collect()] == ["extension", "shebang", None, "manifest-entry", None, "content", None, None]


def test_globs():
    import re

    ok = lambda g, s, n=False: re.search(T.glob_regex(g, n), s) is not None
    assert ok("*.js", "a.js") and not ok("*.js", "d/a.js") and ok("**/*.js", "d/e/a.js") and ok("**/*.js", "a.js") and ok("d/**", "d/.x/y")
    assert ok("a?c", "abc") and ok("[!a]b", "cb") and not ok("[!a]b", "ab") and ok("{a,b}.c", "b.c") and ok("*.COM", "x.com", True) and not ok("a.c", "abc")
    with pytest.raises(ValueError):
        T.glob_regex("!(a)")


def test_ranks_and_levels(spark):
    assert values(spark, ["info", "critical"], T.rank) == [0, 4]
    assert values(spark, [0, 1, 24, 25, 50, 80], T.level, "int") == ["none", "low", "low", "medium", "high", "critical"]
