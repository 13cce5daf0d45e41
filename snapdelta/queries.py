"""The operators as queries over the driver's tables, each beside SQL that gives the same rows.

The tables are no packages, so a query makes a snapshot pair of one of them. DOC: documents
without ids ending in 3 against those without ids ending in 7, every fifth text altered. EVT:
users and their event types before and from 2024-01-03 on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import reports, rules
from .functions import text as T
from .operators import inventory, metadata, policy as P, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    """The DOC pair as FILES rows without contents; one narrow pass for both sides."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    after = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("before").alias("side"), (F.col("doc_id") % 10 != 3).alias("there"), F.col("text").alias("body")), F.struct(F.lit("after").alias("side"), (F.col("doc_id") % 10 != 7).alias("there"), after.alias("body")))
    rows = docs.select("doc_id", path.alias("path"), "source", F.inline(sides)).filter("there")
    return rows.select(F.lit("doc").alias("pair_id"), "side", "path", F.octet_length("body").cast("long").alias("size"), T.sha256("body").alias("sha256"), F.lit(420).alias("mode"), F.lit(True).alias("mode_known"), F.lit("text").alias("kind"), "body", "doc_id", "source")


DOC_SQL = """
WITH b AS (SELECT concat(source,'/',doc_id) AS path, doc_id, source, text AS body, sha256(text) AS sha256, strlen(text) AS size FROM documents WHERE doc_id % 10 <> 3),
a AS (SELECT path, doc_id, source, body, sha256(body) AS sha256, strlen(body) AS size FROM (SELECT concat(source,'/',doc_id) AS path, doc_id, source, CASE WHEN doc_id % 5 = 0 THEN concat(text,'!') ELSE text END AS body FROM documents WHERE doc_id % 10 <> 7)),
inv AS (SELECT coalesce(a.path,b.path) AS path, coalesce(a.doc_id,b.doc_id) AS doc_id, coalesce(a.source,b.source) AS source, b.sha256 AS before_sha, a.sha256 AS after_sha, b.size AS before_size, a.size AS after_size,
 CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.sha256 <> b.sha256 THEN 'modified' ELSE 'unchanged' END AS status FROM b FULL OUTER JOIN a USING (path))
"""


@query(DOC_SQL + "SELECT path, status, before_sha, after_sha, before_size, after_size FROM inv")
def inventory_diff(spark, d):
    got = inventory.diff(doc_files(spark, d))
    return got.select("path", "status", F.col("before.sha256").alias("before_sha"), F.col("after.sha256").alias("after_sha"), F.col("before.size").alias("before_size"), F.col("after.size").alias("after_size"))


@query(DOC_SQL + "SELECT count_if(status='added')::BIGINT AS added, count_if(status='removed')::BIGINT AS removed, count_if(status='modified')::BIGINT AS modified, count_if(status='unchanged')::BIGINT AS unchanged FROM inv")
def inventory_counts(spark, d):
    return inventory.counts(inventory.diff(doc_files(spark, d))).drop("pair_id")


@query("WITH " + DOC_SQL.split("WITH")[1] + "SELECT source AS package, coalesce(sum(before_size),0)::BIGINT AS before_bytes, coalesce(sum(after_size),0)::BIGINT AS after_bytes, coalesce(sum(after_size),0) - coalesce(sum(before_size),0) > greatest(2000.0, 0.01 * coalesce(sum(before_size),0)) AS spike FROM inv GROUP BY source")
def size_spike(spark, d):
    got = inventory.totals(doc_files(spark, d).drop("pair_id").withColumnRenamed("source", "pair_id"))
    return got.select(F.col("pair_id").alias("package"), "before_bytes", "after_bytes", inventory.is_spike(F.col("before_bytes"), F.col("after_bytes"), 2000, 0.01).alias("spike"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sha256("text").alias("sha256"))


@query(DOC_SQL + "SELECT path, substr(sha256(concat('doc',chr(0),concat('files.',status),chr(0),concat(path,':',coalesce(after_sha,before_sha)))),1,32) AS fingerprint FROM inv WHERE status <> 'unchanged'")
def finding_fingerprint(spark, d):
    return _doc_findings(spark, d).select("path", "fingerprint")


def _doc_findings(spark, d):
    got = inventory.diff(doc_files(spark, d)).filter("status <> 'unchanged'")
    rule, identity = F.concat(F.lit("files."), "status"), F.concat_ws(":", "path", F.coalesce("after.sha256", "before.sha256"))
    return got.select("path", "status", T.fingerprint(F.lit("doc"), rule, identity).alias("fingerprint"))


@query("""WITH m AS (SELECT o_custkey % 50 AS k, o_orderpriority AS name, count_if(o_orderkey % 2 = 0) AS b, count_if(o_orderkey % 2 = 1 AND o_orderkey % 7 <> 0) AS a FROM orders GROUP BY 1,2)
SELECT k AS pair_id, name, nullif(b,0)::VARCHAR AS "before", nullif(a,0)::VARCHAR AS "after", CASE WHEN b=0 THEN 'added' WHEN a=0 THEN 'removed' ELSE 'changed' END AS change FROM m WHERE a<>b""")
def map_diff_fields(spark, d):
    o = table(spark, d, "orders").withColumn("pair_id", F.col("o_custkey") % 50)
    n = o.groupBy("pair_id", "o_orderpriority").agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("b"), F.count_if((F.col("o_orderkey") % 2 == 1) & (F.col("o_orderkey") % 7 != 0)).alias("a"))
    entry = lambda c: F.map_from_entries(F.filter(F.collect_list(F.when(F.col(c) > 0, F.struct("o_orderpriority", F.col(c).cast("string")))), lambda x: x.isNotNull()))
    pairs = n.groupBy("pair_id").agg(entry("b").alias("b"), entry("a").alias("a")).select("pair_id", F.struct(F.col("b").alias("m")).alias("before"), F.struct(F.col("a").alias("m")).alias("after"))
    return metadata.map_changes(pairs, "m")


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey AS c FROM orders), s AS (SELECT DISTINCT y FROM y)
SELECT * FROM (SELECT n.y::BIGINT AS year, n.c AS member, 'added' AS change FROM y n ANTI JOIN y p ON p.y = n.y-1 AND p.c = n.c WHERE n.y-1 IN (SELECT y FROM s)
UNION ALL SELECT (p.y+1)::BIGINT, p.c, 'removed' FROM y p ANTI JOIN y n ON n.y = p.y+1 AND p.c = n.c WHERE p.y+1 IN (SELECT y FROM s))""")
def set_diff_members(spark, d):
    m = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_custkey").alias("member")).distinct()
    last = m.withColumn("year", F.col("year") + 1)
    years = m.select("year").distinct()
    both = m.withColumn("n", F.lit(True)).join(last.withColumn("p", F.lit(True)), ["year", "member"], "full_outer").filter("n is null or p is null")
    first = F.broadcast(m.agg(F.min("year").alias("first")))
    return both.join(years, "year", "left_semi").crossJoin(first).filter("year > first").select("year", "member", F.when(F.col("n"), "added").otherwise("removed").alias("change"))


EVT_SQL = """WITH e AS (SELECT user_id, event_type, ts >= TIMESTAMP '2024-01-03' AS after, event_id FROM events),
n AS (SELECT user_id, event_type, event_id FROM e WHERE after), new AS (SELECT * FROM n ANTI JOIN (SELECT DISTINCT user_id, event_type FROM e WHERE NOT after) o USING (user_id, event_type)),
r(event_type, severity, score) AS (VALUES ('purchase','critical',34),('signup','high',20),('click','medium',10),('view','low',4))
"""
EVT_RULES = {"purchase": ("critical", 34), "signup": ("high", 20), "click": ("medium", 10), "view": ("low", 4)}


def _new_events(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")).alias("after"))
    old = e.filter("not after").select("user_id", "event_type").distinct()
    return e.filter("after").join(old, ["user_id", "event_type"], "left_anti")


def _event_rule(k):
    table_of = F.create_map(*[F.lit(x) for t, v in EVT_RULES.items() for x in (t, v[k])])
    return F.coalesce(F.try_element_at(table_of, F.col("event_type")), F.lit(rules.OTHER_CAPABILITY[k]))


@query(EVT_SQL + "SELECT user_id, event_type AS capability, coalesce(severity,'medium') AS severity, coalesce(score,8)::INT AS score, count(*)::BIGINT AS n FROM new LEFT JOIN r USING (event_type) GROUP BY ALL")
def capability_added(spark, d):
    got = _new_events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("event_type").alias("capability"), _event_rule(0).alias("severity"), _event_rule(1).cast("int").alias("score"), "n")


@query(EVT_SQL + "SELECT user_id, event_type AS capability, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM new) WHERE k <= 8 GROUP BY ALL")
def capability_evidence_top8(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    top = _new_events(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 8")
    return top.groupBy("user_id", F.col("event_type").alias("capability")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("evidence"))


@query(EVT_SQL + "SELECT user_id, least(24, 17 + count(*))::INT AS non_registry, least(14, 3 + count(*))::INT AS runtime, least(15, 8 + count(*))::INT AS executable, least(16, 8 + count(*))::INT AS domains FROM new GROUP BY user_id")
def score_caps(spark, d):
    n = _new_events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", *[F.least(F.lit(top), base + F.col("n")).cast("int").alias(name) for name, top, base in (("non_registry", 24, 17), ("runtime", 14, 3), ("executable", 15, 8), ("domains", 16, 8))])


def _host_rows(spark, d):
    p = table(spark, d, "pages")
    mid = p.agg(F.floor((F.max("page_id") + 1) / 2).alias("mid"))
    host = F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1))
    return p.select("page_id", host.alias("host")).filter("host <> ''").crossJoin(F.broadcast(mid)).select("page_id", "host", (F.col("page_id") >= F.col("mid")).alias("after"))


HOST_SQL = """WITH mid AS (SELECT (max(page_id)+1)//2 AS m FROM pages), h AS (SELECT page_id, lower(regexp_extract(url,'^https?://([^/:?#]+)',1)) AS host, page_id >= m AS after FROM pages, mid),
hosts AS (SELECT * FROM h WHERE host <> ''), new AS (SELECT * FROM (SELECT * FROM hosts WHERE after) ANTI JOIN (SELECT DISTINCT host FROM hosts WHERE NOT after) USING (host))
"""


def _new_hosts(spark, d):
    h = _host_rows(spark, d)
    return h.filter("after").join(h.filter("not after").select("host").distinct(), "host", "left_anti")


@query(HOST_SQL + "SELECT host, count(*)::BIGINT AS n, min(page_id) AS first_page FROM new GROUP BY host")
def domains_added(spark, d):
    return _new_hosts(spark, d).groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(HOST_SQL + "SELECT host, page_id, ord FROM (SELECT host, page_id, row_number() OVER (ORDER BY host, page_id)::INT AS ord FROM (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM hosts) WHERE k <= 5) WHERE ord <= 12")
def domain_evidence_cap(spark, d):
    w = Window.partitionBy("host").orderBy("page_id")
    top = _host_rows(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 5").select("host", "page_id")
    first = top.orderBy("host", "page_id").limit(12)
    return first.withColumn("ord", F.row_number().over(Window.orderBy("host", "page_id")))


@query(HOST_SQL.rsplit(", new AS", 1)[0] + "SELECT DISTINCT host, regexp_matches(host,'^(localhost|127\\..*|10\\..*|192\\.168\\..*|169\\.254\\..*|[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)$') AS private, regexp_matches(host,'(ngrok|requestbin|webhook\\.site|pastebin|discord(app)?\\.com|example\\.com)$') AS disposable FROM hosts")
def host_flags(spark, d):
    return _host_rows(spark, d).select("host", T.private_host("host").alias("private"), (T.disposable_host("host") | F.endswith("host", F.lit("example.com"))).alias("disposable")).distinct()


@query(HOST_SQL.rsplit(", new AS", 1)[0] + "SELECT host, count(*)::BIGINT AS n FROM hosts WHERE regexp_matches(host,'^[^/]*\\.com$') AND NOT regexp_matches(host,'^s[^/]*[0-4]\\.[^/]*$') GROUP BY host")
def domain_policy(spark, d):
    """Denied hosts; allowed ones win."""
    denied = T.matches_any("host", ("*.com",), True) & ~T.matches_any("host", ("s*[0-4].*",), True)
    return _host_rows(spark, d).filter(denied).groupBy("host").agg(F.count("*").alias("n"))


@query(HOST_SQL.rsplit(", new AS", 1)[0] + "SELECT host, count(*)::BIGINT AS n FROM hosts WHERE NOT (regexp_matches(host,'^[^/]*[13579]\\.[^/]*$') OR regexp_matches(host,'^a[^/]$')) GROUP BY host")
def ignore_glob(spark, d):
    return _host_rows(spark, d).filter(~T.matches_any("host", ("*[13579].*", "a?"))).groupBy("host").agg(F.count("*").alias("n"))


LINE_RULES = {"script": "<script", "call": r"track\(", "comment": "<!--", "link": "href="}


@query(f"""WITH l AS (SELECT page_id, generate_subscripts(x,1) AS line, unnest(x) AS text FROM (SELECT page_id, string_split(html, chr(10)) AS x FROM pages)), r(rule, pattern) AS (VALUES {', '.join(f"('{k}','{v}')" for k, v in LINE_RULES.items())})
SELECT page_id, line::INT AS line, rule FROM l, r WHERE regexp_matches(text, pattern)""")
def rule_scan_lines(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "\n", -1)).alias("at", "text"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in LINE_RULES.items()]))
    return lines.select("page_id", (F.col("at") + 1).alias("line"), F.explode(hits).alias("rule"))


@query("SELECT page_id, len(regexp_extract_all(html,'href='))::INT AS all_links, len(regexp_extract_all(regexp_replace(html,'(?s)<!--.*?-->','','g'),'href='))::INT AS live_links FROM pages")
def comment_masked_scan(spark, d):
    n = lambda c: F.regexp_count(c, F.lit("href="))
    return table(spark, d, "pages").select("page_id", n(F.col("html")).alias("all_links"), n(F.regexp_replace("html", r"(?s)<!--.*?-->", "")).alias("live_links"))


ENTROPY_SQL = """bytes AS (SELECT {k}, unnest(range(1, length(x)+1, 2)) AS i, x FROM (SELECT {k}, hex(encode({t})) AS x FROM {f})),
counts AS (SELECT {k}, substr(x, i::INT, 2) AS b, count(*) AS c FROM bytes GROUP BY ALL), ent AS (SELECT {k}, -sum(c/t*log2(c/t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY {k}) AS t FROM counts) GROUP BY {k})"""


@query("WITH " + ENTROPY_SQL.format(k="doc_id", t="text", f="documents") + " SELECT doc_id, round(coalesce(h,0),6) AS entropy FROM documents LEFT JOIN ent USING (doc_id)")
def entropy_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.entropy(F.col("text").cast("binary")), 6).alias("entropy"))


@query("SELECT doc_id, regexp_extract(text,'[A-Za-z0-9+/]{40,}={0,2}') AS token FROM documents WHERE regexp_matches(text,'[A-Za-z0-9+/]{40,}')")
def encoded_tokens(spark, d):
    found = table(spark, d, "documents").select("doc_id", T.encoded_token("text", 40, 30, 0.0).alias("t")).filter("t is not null")
    return found.select("doc_id", F.col("t.token").alias("token"))


@query("SELECT doc_id, len(regexp_extract_all(text,'[\\x00-\\x06\\x0F-\\x1F]'))::INT AS n FROM documents")
def control_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.control_count(F.col("text").cast("binary")).alias("n"))


@query("SELECT doc_id, len(l)::INT AS lines, list_max(list_transform(l, lambda x: length(x)))::INT AS longest, round(length(text)/len(l),6) AS average, (list_max(list_transform(l, lambda x: length(x))) > 500 AND length(text)/len(l) > 250) OR (length(text) > 40000 AND len(l) < 12) AS dense FROM (SELECT doc_id, text, string_split_regex(text,'\\r?\\n') AS l FROM documents)")
def line_stats(spark, d):
    got = table(spark, d, "documents").select("doc_id", "text", T.line_stats("text").alias("s"))
    dense = ((F.col("s.longest") > 500) & (F.col("s.average") > 250)) | ((F.length("text") > 40000) & (F.col("s.lines") < 12))
    return got.select("doc_id", F.col("s.lines").alias("lines"), F.col("s.longest").alias("longest"), F.round("s.average", 6).alias("average"), dense.alias("dense"))


@query("SELECT page_id, lower(regexp_extract(regexp_replace(regexp_replace(regexp_extract(url,'^https?://[^/]*(/[^?#]*)?',1),'^.*/',''),'[.\\s]+$',''),'^.+(\\.[^.]*)$',1)) AS ext FROM pages")
def extension_of(spark, d):
    return table(spark, d, "pages").select("page_id", T.extension(F.regexp_extract("url", "^https?://[^/]*(/[^?#]*)?", 1)).alias("ext"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'extension' WHEN text LIKE '#!%' THEN NULL WHEN doc_id % 11 = 0 THEN 'manifest-entry' WHEN doc_id % 13 = 0 THEN NULL ELSE NULL END AS reason FROM documents""")
def classify_path(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("lib/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".mjs").when(F.col("doc_id") % 13 == 0, ".md").otherwise(""))
    entry = F.when(F.col("doc_id") % 11 == 0, "manifest-entry")
    return docs.select("doc_id", T.code_reason(path, F.lit("text"), F.substring("text", 1, 4096), entry).alias("reason"))


@query("""SELECT page_id, ((CASE WHEN regexp_matches(html,'\\bfunction\\s*[*A-Za-z_$(]') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(html,'=>\\s*[{(A-Za-z_$''"`]') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(html,'\\b(const|let|var)\\s+[A-Za-z_$][A-Za-z0-9_$]*\\s*=') THEN 1 ELSE 0 END)
 + (CASE WHEN regexp_matches(html,'\\brequire\\s*\\(\\s*[''"`]') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(html,'\\bmodule\\s*\\.\\s*exports\\b') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(html,'(?m)^\\s*(import|export)\\b[^\\n]*\\bfrom\\s*[''"]') THEN 2 ELSE 0 END)
 + (CASE WHEN regexp_matches(html,'\\bexports\\s*\\.\\s*[A-Za-z_$]') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(html,'\\bclass\\s+[A-Za-z_$][A-Za-z0-9_$]*\\s*(extends\\b|\\{)') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(html,'\\b(async\\s+)?function\\s*\\*?\\s*[A-Za-z_$]*\\s*\\([^)]*\\)\\s*\\{') THEN 1 ELSE 0 END))::INT AS score FROM pages""")
def sniff_score(spark, d):
    return table(spark, d, "pages").select("page_id", T.sniff_score("html").alias("score"))


@query("SELECT doc_id, CASE WHEN length(t) > 180 THEN concat(substr(t,1,179),'…') ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text,'\\s+',' ','g')) AS t FROM documents)")
def truncate_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate("text").alias("snippet"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN concat(n,' B') WHEN n < 10*u THEN concat((2*n*100+u)//(2*u)//100,'.',lpad(((2*n*100+u)//(2*u)%100)::VARCHAR,2,'0'),name) ELSE concat((2*n*10+u)//(2*u)//10,'.',(2*n*10+u)//(2*u)%10,name) END AS label FROM (SELECT doc_id, n, CASE WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END AS u, CASE WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END AS name FROM (SELECT doc_id, strlen(text) AS n FROM documents))")
def byte_size_label(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n")).select("doc_id", T.byte_label("n").alias("label"))


SPECIFIERS = ("^1.2.3", "latest", "npm:x@1", "file:../x", "git+ssh://h/x", "github:a/b", "a/b", "../x", ".", "@s/n", "@s/n@1", "@s/n/x", "x.tgz", "~1.x", "C:\\x", "git@h:a/b", "https://h/x.tgz", ">=1 <2", "workspace:*", "~/x", "*", "1 || 2")
NON_REGISTRY_SPECIFIERS = ("file:../x", "git+ssh://h/x", "github:a/b", "a/b", "../x", ".", "@s/n/x", "x.tgz", "C:\\x", "git@h:a/b", "https://h/x.tgz", "workspace:*", "~/x")


@query(f"SELECT r_regionkey, s AS specifier, s IN ({', '.join(repr(s).replace(chr(92) * 2, chr(92)) for s in NON_REGISTRY_SPECIFIERS)}) AS direct FROM region, (SELECT unnest([{', '.join(repr(s).replace(chr(92) * 2, chr(92)) for s in SPECIFIERS)}]) AS s)")
def nonregistry_spec(spark, d):
    rows = table(spark, d, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, SPECIFIERS))).alias("specifier"))
    return rows.withColumn("direct", T.non_registry("specifier"))


RISK_SQL = """WITH f AS (SELECT l_suppkey AS pair_id, CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'high' ELSE 'low' END AS severity, l_quantity::INT AS score, concat(l_orderkey,'-',l_linenumber) AS id, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'new' END AS status FROM lineitem)
"""


def _line_findings(spark, d):
    rows = table(spark, d, "lineitem")
    severity = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "high").otherwise("low")
    return rows.select(F.col("l_suppkey").alias("pair_id"), severity.alias("severity"), F.col("l_quantity").cast("int").alias("score"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_linestatus") == "F", "baseline").otherwise("new").alias("status"))


@query(RISK_SQL + """SELECT pair_id, least(100, coalesce(sum(score) FILTER (status='new'),0))::INT AS score, count_if(status='new' AND severity='info')::BIGINT AS info, count_if(status='new' AND severity='low')::BIGINT AS low, count_if(status='new' AND severity='medium')::BIGINT AS medium, count_if(status='new' AND severity='high')::BIGINT AS high, count_if(status='new' AND severity='critical')::BIGINT AS critical,
count_if(status='new')::BIGINT AS new_findings, count_if(status<>'new')::BIGINT AS baseline_findings, CASE WHEN coalesce(sum(score) FILTER (status='new'),0) >= 80 THEN 'critical' WHEN coalesce(sum(score) FILTER (status='new'),0) >= 50 THEN 'high' WHEN coalesce(sum(score) FILTER (status='new'),0) >= 25 THEN 'medium' WHEN coalesce(sum(score) FILTER (status='new'),0) > 0 THEN 'low' ELSE 'none' END AS level FROM f GROUP BY pair_id""")
def risk_summary(spark, d):
    return scoring.risk(_line_findings(spark, d))


@query(RISK_SQL + "SELECT pair_id, id, severity, score, row_number() OVER (PARTITION BY pair_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END DESC, score DESC, id)::INT AS ord FROM f")
def finding_order(spark, d):
    rows = _line_findings(spark, d).withColumns({"draft_ord": F.lit(0), "draft_sub": F.lit("")})
    return scoring.ordered(rows).select("pair_id", "id", "severity", "score", "ord")


@query("SELECT doc_id, sha256 FROM (SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_first_wins(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sha256("text").alias("sha256")).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))


@query(DOC_SQL + ", p AS (SELECT path, doc_id, status AS change, substr(sha256(concat('doc',chr(0),concat('files.',status),chr(0),concat(path,':',coalesce(after_sha,before_sha)))),1,32) AS fingerprint FROM inv WHERE status <> 'unchanged') SELECT path, fingerprint, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'baseline' ELSE 'new' END AS status FROM p")
def baseline_apply(spark, d):
    found = _doc_findings(spark, d).drop("status").withColumn("doc_id", F.regexp_extract("path", "([0-9]+)$", 1).cast("long"))
    accepted = found.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("fingerprint")
    return scoring.apply_baseline(found, accepted).select("path", "fingerprint", "status")


@query(RISK_SQL + "SELECT pair_id, count(*)::BIGINT AS n FROM f WHERE status='new' AND severity IN ('high','critical') GROUP BY pair_id")
def policy_fail_on(spark, d):
    seen = P.visible(_line_findings(spark, d).withColumn("fingerprint", F.col("id")), P.Policy(failOn="high"))
    return seen.filter(T.rank("severity") >= rules.RANK["high"]).groupBy("pair_id").agg(F.count("*").alias("n"))


@query(RISK_SQL + "SELECT pair_id, least(100,sum(score))::BIGINT AS score FROM f WHERE status='new' GROUP BY pair_id HAVING least(100,sum(score)) > 20")
def policy_max_score(spark, d):
    seen = P.visible(_line_findings(spark, d).withColumn("fingerprint", F.col("id")), P.Policy(maxRiskScore=20))
    return seen.groupBy("pair_id").agg(F.least(F.lit(100), F.sum("score")).alias("score")).filter("score > 20")


@query(EVT_SQL + "SELECT user_id, count(*)::BIGINT AS n FROM new WHERE event_type IN ('purchase','click') GROUP BY user_id")
def policy_deny_capability(spark, d):
    got = _new_events(spark, d).withColumns({"id": F.concat(F.lit("capability.added."), "event_type"), "tags": F.array("event_type")})
    denied = reduce(lambda a, b: a | b, [F.array_contains("tags", c) | F.endswith("id", F.lit("." + c)) for c in ("purchase", "click")])
    return got.filter(denied).groupBy("user_id").agg(F.count("*").alias("n"))


@query(DOC_SQL + "SELECT source, count(*)::BIGINT AS added FROM inv WHERE status='added' GROUP BY source HAVING count(*) > 3")
def policy_limits(spark, d):
    got = inventory.diff(doc_files(spark, d)).filter("status = 'added'")
    return got.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("source")).agg(F.count("*").alias("added")).filter("added > 3")


@query(RISK_SQL + "SELECT s_suppkey AS pair_id, (coalesce(max(CASE WHEN status='new' AND severity IN ('high','critical') THEN 1 ELSE 0 END),0) + CASE WHEN coalesce(sum(score) FILTER (status='new'),0) > 20 THEN 1 ELSE 0 END)::BIGINT AS violations, coalesce(max(CASE WHEN status='new' AND severity IN ('high','critical') THEN 1 ELSE 0 END),0) = 0 AND coalesce(sum(score) FILTER (status='new'),0) <= 20 AS passed FROM supplier LEFT JOIN f ON pair_id = s_suppkey GROUP BY s_suppkey")
def policy_verdict(spark, d):
    found = _line_findings(spark, d).withColumns({"fingerprint": F.col("id"), "tags": F.array().cast("array<string>"), "category": F.lit("inventory")})
    nothing = lambda ddl: spark.createDataFrame([], ddl)
    broken = P.violations(found, nothing("pair_id long, change string, scope string"), nothing("pair_id long, status string"), P.Policy(failOn="high", maxRiskScore=20))
    return P.verdicts(broken, table(spark, d, "supplier").select(F.col("s_suppkey").alias("pair_id")))


@query(DOC_SQL + "SELECT path, after_size AS size FROM inv WHERE status IN ('added','modified') AND after_size > 4000")
def coverage_gaps(spark, d):
    f = doc_files(spark, d).select("pair_id", "side", "path", "size", "sha256", "mode", "mode_known", "kind")
    changed = inventory.changed(inventory.diff(f)).select("pair_id", "path")
    return f.filter("side = 'after' and size > 4000").join(changed, ["pair_id", "path"], "left_semi").select("path", "size")


CASES_SQL = "SELECT quality = 1 AS y, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)"


@query(f"SELECT *, CASE WHEN tp+fp=0 THEN 0 ELSE round(tp/(tp+fp),6) END AS precision, CASE WHEN tp+fn=0 THEN 0 ELSE round(tp/(tp+fn),6) END AS recall, CASE WHEN fp+tn=0 THEN 0 ELSE round(fp/(fp+tn),6) END AS false_positive_rate FROM (SELECT count_if(y AND p)::BIGINT AS tp, count_if(NOT y AND p)::BIGINT AS fp, count_if(NOT y AND NOT p)::BIGINT AS tn, count_if(y AND NOT p)::BIGINT AS fn FROM ({CASES_SQL}))")
def confusion_matrix(spark, d):
    cases = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("label"), (F.col("n_chars") > 1000).alias("predicted"))
    return scoring.confusion(cases).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "false_positive_rate")})


@query("SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM documents WHERE n_chars > 500")
def missing_expected(spark, d):
    return table(spark, d, "labels").filter("toxic = 1").select("doc_id").subtract(table(spark, d, "documents").filter("n_chars > 500").select("doc_id"))


@query(RISK_SQL + "SELECT id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM f")
def sarif_level(spark, d):
    return _line_findings(spark, d).select("id", reports.sarif_level("severity").alias("level"))


@query("SELECT p_partkey, path, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY string_split(path,'/'), p_partkey)::INT AS ord FROM (SELECT p_partkey, concat(p_brand,'/',replace(p_type,' ','/')) AS path FROM part)")
def traversal_order(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.replace("p_type", F.lit(" "), F.lit("/"))).alias("path"))
    w = Window.partitionBy(F.col("p_partkey") % 20).orderBy(F.split("path", "/"), "p_partkey")
    return rows.withColumn("ord", F.row_number().over(w))


@query("WITH n AS (SELECT p_name AS path FROM part UNION SELECT upper(p_name) FROM part WHERE p_partkey % 7 = 0) SELECT lower(path) AS folded, count(*)::BIGINT AS n FROM n GROUP BY 1 HAVING count(*) > 1")
def case_collision(spark, d):
    p = table(spark, d, "part")
    n = p.select(F.col("p_name").alias("path")).union(p.filter("p_partkey % 7 = 0").select(F.upper("p_name"))).distinct()
    return n.groupBy(F.lower("path").alias("folded")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def asof_previous_release(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"))


@query("SELECT user_id, event_type AS capability, min(ts)::DATE::VARCHAR AS first_day FROM events GROUP BY ALL")
def streaming_new_capability(spark, d):
    from .streaming.releases import first_seen

    return first_seen(table(spark, d, "events").select("user_id", F.col("event_type").alias("capability"), "ts"))


@query("SELECT l_returnflag AS category, l_linestatus AS severity, count(*)::BIGINT AS findings, sum(l_quantity)::BIGINT AS score FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def finding_rollup(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("severity"), F.col("l_quantity").cast("long").alias("score"))
    return rows.cube("category", "severity").agg(F.count("*").alias("findings"), F.sum("score").alias("score"))


@query()
def code_profile(spark, d):
    """Signals of the scripts in pages; the one Python operator of the audit."""
    from .operators import profile

    script = F.concat_ws("\n", F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)))
    pages = table(spark, d, "pages").select(T.sha256(script).alias("sha256"), F.lit(".js").alias("ext"), script.cast("binary").alias("content"))
    got = profile.profile_contents(pages.dropDuplicates(["sha256"]))
    return got.select("sha256", F.size("signals").alias("signals"), F.size("hosts").alias("hosts"), F.size("gaps").alias("gaps"))


@query()
def report_rows(spark, d):
    """One JSON report for each supplier with findings."""
    found = scoring.ordered(_line_findings(spark, d).withColumns({"draft_ord": F.lit(0), "draft_sub": F.lit("")}))
    body = F.to_json(F.struct(F.col("pair_id"), F.array_sort(F.collect_list(F.struct("ord", "id", "severity", "score", "status"))).alias("findings")))
    return found.groupBy("pair_id").agg(body.alias("report"))
