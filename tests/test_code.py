"""What the static code profile finds, and what it leaves alone."""

import time

import pytest

from snapdelta.functions.code import Ranges, Reader, profile, scan


def capabilities(text, ext=".js"):
    return sorted({s[0] for s in profile(text, ext)["signals"]})


@pytest.mark.parametrize(
    "text,want",
    [
        ("require('child_process')", ["child_process"]),
        ("require('node:fs')", ["filesystem"]),
        ("require(['ch','ild'].join('') + '_process')", ["child_process"]),
        ("require(Buffer.from('Y2hpbGRfcHJvY2Vzcw==', 'base64').toString())", ["child_process"]),
        ("require(Buffer.from('6673', 'hex').toString('utf8'))", ["filesystem"]),
        ("require(atob('ZnM='))", ["filesystem"]),
        ("require('f'.concat('s'))", ["filesystem"]),
        ("require(String.fromCharCode(102, 0x73))", ["filesystem"]),
        ("require(`child_${'process'}`)", ["child_process"]),
        ("require(('fs' as string)!)", ["filesystem"]),
        ("const r = require; r('net')", ["raw-network"]),
        ("let a = require; const b = a; b('dns')", ["dns"]),
        ("import { createRequire as c } from 'module'; const q = c(import.meta.url); q('fs')", ["filesystem", "module-loader"]),
        ("import x from 'http'", ["network"]),
        ("export * from 'vm'", ["dynamic-code"]),
        ("import('worker_threads')", ["worker-threads"]),
        ("process.mainModule.require('inspector')", ["inspector"]),
        ("m['_lo' + 'ad']('fs')", ["filesystem"]),
        ("const F = (() => {}).constructor; F('return 1')", ["dynamic-code"]),
        ("x.constructor('return process')()", ["dynamic-code"]),
        ("x.constructor(y)", []),
        ("eval('1')", ["dynamic-code"]),
        ("new Function('a')", ["dynamic-code"]),
        ("process . env.HOME", ["environment"]),
        ("fetch(u)", ["network"]),
        ("got.post(u)", ["network"]),
        ("Deno.Command", ["child_process"]),
        ("WebAssembly.compile(b)", ["dynamic-code"]),
        ("require(name)", ["module-loader"]),
        ("require('./local')", []),
        ("function require(x) {}", []),
        ("// require('fs')\n/* eval(1) */ 'fetch(u)'; /process.env/", []),
        ("`text eval(1) ${ require('fs') } fetch(`", ["filesystem"]),
        ("const s = \"it's\"; require('fs')", ["filesystem"]),
        ("a = b / c; require('fs') / 2", ["filesystem"]),
    ],
)
def test_capabilities(text, want):
    got = profile(text)
    assert capabilities(text) == want and not got["gaps"]


@pytest.mark.parametrize("text", ["const s = 'open\nrequire('fs')", "/* open\nrequire('fs')", "`open ${require('fs')", "f(require('fs')", "require('fs'))"])
def test_gaps_keep_what_text_rules_find(text):
    got = profile(text)
    assert len(got["gaps"]) == 1
    if not text.startswith("/*"):
        assert "filesystem" in capabilities(text)


def test_markup_text_may_hold_quotes():
    assert profile("const a = <p>Don't</p>\nrequire('fs')", ".jsx")["gaps"] == [] and capabilities("const a = <p>Don't</p>\nrequire('fs')", ".jsx") == ["filesystem"]


def test_hosts():
    text = "fetch('https://EXAMPLE.com/x'); // http://comment.org\n\"http:\\/\\/1.2.3.4:80/\" 'https://еvil.org/a' `http://[::1]/`"
    assert [h[0] for h in profile(text)["hosts"]] == ["example.com", "1.2.3.4", "еvil.org", "[::1]"]


def test_lines_and_snippets():
    (signal,) = profile("a\n\n   require('fs')   ;  \n")["signals"]
    assert signal == ("filesystem", 3, "loads module fs", "require('fs') ;")


def test_deep_nesting_is_a_gap():
    assert profile("(" * 5000 + ")" * 5000)["gaps"][0][0] == "parse-failure"


def test_ranges():
    r = Ranges([(5, 9), (1, 3), (8, 12), (4, 4)])
    assert [x in r for x in (0, 1, 2, 3, 5, 11, 12)] == [False, True, True, False, True, True, False]


def test_fold_limits():
    deep = "'a'" + "+'a'" * 5
    assert Reader(scan(deep).tokens).whole(0, 11)[0] == "a" * 6
    assert Reader(scan("'a' + b").tokens).fold(0) is None


def test_hostile_texts_take_seconds():
    began = time.perf_counter()
    names = ", ".join(f"n{i}" for i in range(30_000))
    assert ("child_process", 1) in [x[:2] for x in profile(f"import {{ {names} }} from 'child_process'")["signals"]]
    nested = "'a'[" * 3000 + "'b'" + "]" * 3000
    for text in (nested, f"x = {nested};", 'f(1).constructor("x");' * 40_000, "import " * 100_000, "export * " * 100_000, "a" + "(a" * 3000 + ")" * 3000, "require(" * 2000 + "'fs'" + ")" * 2000):
        profile(text)
    assert time.perf_counter() - began < 60


def test_one_failing_content_is_a_gap(spark, monkeypatch):
    from snapdelta.operators import profile as operator

    rows = spark.createDataFrame([("a", ".js", bytearray(b"require('fs')")), ("b", ".js", None)], "sha256 string, ext string, content binary")
    got = {r["sha256"]: r for r in operator.profile_contents(rows).collect()}  # a null content fails in the reader
    assert got["a"]["signals"] and not got["a"]["gaps"] and got["b"]["gaps"][0]["reason"] == "parse-failure"
