"""Secret scans: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame and SQL work on the executors. A candidate is a value of a known form or
one assigned to a name with a secret word anywhere in it (DB_PASSWORD, apiToken). Its features are
its length, the transitions between kinds of characters and between neighbouring letters, how much
of it a dictionary covers, its path (the source column) and the words beside it. The dictionary is
the most frequent words of all documents, and words that fill placeholders. The forest is fitted
with Spark's own trees on labelled findings, which rules write from counters: real keys of several
forms, and the usual false alarms (placeholders, words, versions, digests, identifiers, paths, test
data).

Places come from the matches themselves: a text is split at them, and the lengths of the pieces
are summed. They count code points from 1. Null and empty texts have no candidates; a null source
is an unknown path. Candidates that lie in one another are one, the leftmost and longest form. A
value has no upper length; a PEM block goes from BEGIN to END, or to the end of its lines where END
is missing. Repeated rows repeat their findings; rows without doc_id are scanned as well. An empty
table gives an empty result; extra columns are ignored, and clashing names do no harm, as only the
columns doc_id, text and source are read. The query returns digests of the values, not the values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, read_table

#: A name that holds a secret word, whole from the first of [A-Za-z0-9_.-] on, and what stands between it and its value.
#: A run that no sign of assignment follows is left at once, and no run is tried from its middle.
ASSIGN = r"""["']?[ \t]{0,4}(?>:=|=>|[:=])"""
NAME = rf"""(?i:(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]++{ASSIGN})(?>[A-Za-z0-9_.-]*(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?key|private[_-]?key)[A-Za-z0-9_.-]*){ASSIGN}[ \t]{{0,4}}["']?)"""
#: The forms of candidates, tried in this order at each place. Each goes to the natural end of its value.
FORMS = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]*-(?!----)){0,256}+[^-]*-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:\s|\\[nr]){1,8}[A-Za-z0-9+/=]{16,}){0,256}+)",
    r"\b(?:" + "|".join((
        r"(?:AKIA|ASIA)[0-9A-Z]{16}\b", r"gh[pousr]_[A-Za-z0-9]{36,}\b", r"github_pat_[A-Za-z0-9_]{22,}", r"glpat-[A-Za-z0-9_\-]{20,}", r"npm_[A-Za-z0-9]{36,}", r"pypi-[A-Za-z0-9_\-]{40,}", r"hf_[A-Za-z0-9]{30,}",
        r"xox[abprs]-[A-Za-z0-9-]{10,}", r"AIza[0-9A-Za-z_\-]{35,}", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
        r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    )) + ")",
    NAME + r"""(?!-----BEGIN )[^\s"'`,;<>]{8,}""",
)
PATTERN = "|".join(FORMS)
#: Words that fill placeholders and identifiers; the dictionary has them beside the words of the corpus.
DICTIONARY = (
    "password passwd secret token example sample change changeme default your insert replace here test dummy fake demo null none true false undefined config "
    "string value name user admin root local host server client access private public service account database connection production development version "
    "release build index module import export return function class object array number random generate please enter redacted hidden xxxx"
).split()
#: Words beside a finding that speak for another meaning.
OTHER_WORDS = "commit sha1 sha256 md5 checksum digest hash uuid revision integrity fingerprint example sample placeholder dummy fake test docs".split()
NEAR = 48
#: Letters of a dictionary word; words that the dictionary takes from the corpus.
SHORTEST, LONGEST, WORDS = 4, 12, 20_000

FEATURES = ("chars", "digit_share", "upper_share", "symbol_share", "kind_changes", "vowel_changes", "rare_pairs", "distinct_share", "dictionary_share", "hex", "known_form", "secret_word", "other_word", "test_path", "run_share", "quoted")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def dictionary(docs: DataFrame, most: int = WORDS) -> DataFrame:
    """word: the `most` words of 4 to 12 letters a-z that the most documents hold, two at least; counted over all whole texts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z0-9_])[a-z]{{{SHORTEST},{LONGEST}}}(?![a-z0-9_])"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    return cut(counts.orderBy(F.desc("n"), "word").limit(most).select("word"))


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """`found` (a stored table) with `letters`: how many letters of a value lie in words of the dictionary, of at most WORDS rows."""
    keyed = found.withColumn("key", F.monotonically_increasing_id())
    runs = keyed.select("key", F.posexplode(F.regexp_extract_all(F.lower("value"), F.lit(rf"[a-z]{{{SHORTEST},64}}"), F.lit(0))).alias("piece", "run"))
    at = runs.select("key", "piece", "run", F.explode(F.sequence(F.lit(1), F.length("run") - SHORTEST + 1)).alias("i"))
    parts = at.select("key", "piece", "i", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("run") - F.col("i") + 1))).alias("n"), "run")
    hits = parts.withColumn("word", F.substring("run", F.col("i"), F.col("n"))).join(F.broadcast(words), "word")
    places = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)))))  # of at most 64 letters
    letters = hits.groupBy("key", "piece").agg(places.alias("n")).groupBy("key").agg(F.sum("n").alias("letters"))
    return keyed.join(letters, "key", "left").drop("key").withColumn("letters", F.coalesce("letters", F.lit(0)))


def with_features(found: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Adds FEATURES to rows with value, assigned (whether a name precedes it), before, after, source; `words` is a dictionary."""
    found = found.withColumn("letters", F.lit(0)) if words is None else covered(found, words)
    v, low = F.col("value"), F.lower(F.col("value"))
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    around = F.lower(F.concat_ws(" ", "before", "after"))
    either = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    columns = {
        "chars": F.least(n, F.lit(256.0)),
        "digit_share": _count(v, "[0-9]") / n,
        "upper_share": _count(v, "[A-Z]") / n,
        "symbol_share": _count(v, "[^A-Za-z0-9]") / n,
        "kind_changes": _count(v, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])") / n,
        "vowel_changes": _count(low, "(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])") / n,
        "rare_pairs": _count(low, "(?=(?:[bcdfghjklmnpqrstvwxz][qxzjvkw]|[qxzj][b-df-hj-np-tv-z]))") / n,
        "distinct_share": F.size(F.array_distinct(F.split(low, ""))).cast("double") / F.least(n, F.lit(36.0)),
        "dictionary_share": F.greatest(1 - F.length(F.regexp_replace(low, either(DICTIONARY), "")) / n, F.col("letters") / n),
        "hex": yes(v.rlike(r"^(?:0x)?[0-9a-fA-F]{16,}$")),
        "known_form": yes(~F.col("assigned")),
        "secret_word": yes(F.col("assigned") | around.rlike(r"\b(?:token|secret|password|passwd|pwd|api[_-]?key|credential|auth)")),
        "other_word": yes(around.rlike(r"\b" + either(OTHER_WORDS) + r"\b")),
        "test_path": yes(F.lower(F.col("source")).rlike(r"(?:^|[/._-])(?:tests?|spec|examples?|samples?|fixtures?|mocks?|docs?)(?:[/._-]|$)")),
        "run_share": (n - F.length(F.regexp_replace(low, r"(.)\1{2,}", "$1"))) / n,
        "quoted": yes(F.col("before").rlike("[\"'`]$")),
    }
    return found.withColumns({k: columns[k].cast("double") for k in FEATURES}).drop("letters")


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))


def gaps(text: Column) -> Column:
    """What lies before, between and after the matches."""
    return F.split(text, PATTERN, -1)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, at (number in its text), start, length, value, assigned, before and after of each candidate."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    d = d.withColumn("matches", matches(F.col("text"))).filter(F.size("matches") > 0).withColumn("gaps", gaps(F.col("text")))
    beside = lambda array, i: F.coalesce(F.get(array, i), F.lit(""))

    def piece(m: Column, i: Column) -> Column:
        before, after = F.concat(beside("matches", i - 1), F.get("gaps", i)), F.concat(F.get("gaps", i + 1), beside("matches", i + 1))
        return F.struct(i.alias("at"), m.alias("whole"), F.length(F.get("gaps", i)).alias("gap"), F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

    found = d.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "source", F.xxhash64("text").alias("text_hash"), F.inline(F.transform("matches", piece)))
    earlier = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # the candidates of one text
    found = found.withColumn("start", F.coalesce(F.sum(F.col("gap") + F.length("whole")).over(earlier), F.lit(0)) + F.col("gap") + 1)
    found = found.withColumn("name", F.regexp_extract("whole", f"^({NAME})", 1)).withColumn("value", F.substring("whole", F.length("name") + 1, F.length("whole")))
    return found.select(
        "doc_id", "text_hash", "source", "at", (F.col("start") + F.length("name")).cast("int").alias("start"), F.length("value").alias("length"), "value", (F.length("name") > 0).alias("assigned"),
        F.right(F.concat("before", "name"), F.lit(NEAR)).alias("before"), "after",
    )


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """`rows` findings with label, written by rule from counters; half of them real."""
    i = F.col("id")
    digest = lambda k: F.sha2(F.concat_ws("-", F.lit(k), i.cast("string")), 512)
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(digest("a"), digest("b")))), r"[\r\n+/=]", "")
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    word = lambda k: pick(DICTIONARY, k)
    size = lambda low, high, k: (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(high - low)) + low).cast("int")
    real = [
        (F.substring(digest("c"), 1, 40), True), (F.substring(digest("c"), 1, 32), True), (F.substring(digest("c"), 1, 64), True), (F.upper(F.substring(digest("c"), 1, 40)), True),
        (F.substring(mixed, F.lit(1), size(16, 64, 1)), True), (F.substring(mixed, F.lit(5), size(20, 44, 2)), True),
        (F.concat(F.substring(mixed, 1, 6), F.lit("!"), F.substring(mixed, 9, 5), F.lit("#"), F.substring(mixed, 20, 4)), True),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), False), (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), False), (F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), False),
        (F.concat(F.lit("npm_"), F.substring(mixed, 1, 36)), False), (F.concat(F.lit("glpat-"), F.substring(mixed, 1, 20)), False), (F.concat(F.lit("SG."), F.substring(mixed, 1, 22), F.lit("."), F.substring(mixed, 30, 43)), False),
        (F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit(".eyJ"), F.substring(mixed, 21, 40), F.lit("."), F.substring(mixed, 61, 24)), False),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.regexp_replace(F.substring(F.base64(F.unhex(F.repeat(F.concat(digest("a"), digest("b")), 4))), F.lit(1), size(60, 680, 5)), "(.{64})", "$1\n"), F.lit("\n-----END RSA PRIVATE KEY-----")), False),
        (F.repeat(mixed, 3), True),
    ]
    alarm = [
        (F.concat_ws("_", word(1), word(2), word(3)), True), (F.concat(word(4), word(5)), True), (F.concat_ws("-", F.lit("your"), word(6), F.lit("here")), True), (F.rpad(F.lit(""), size(8, 40, 3), "x"), True),
        (F.concat(F.lit("${"), F.upper(word(7)), F.lit("_"), F.upper(word(8)), F.lit("}")), True), (F.concat_ws(".", word(9), word(10), word(1)), True), (F.concat(F.lit("/"), word(2), F.lit("/"), word(3), F.lit("/"), word(4)), True),
        (F.lit("1234567890123456"), True), (F.rpad(F.lit(""), size(8, 32, 4), "0"), True), (F.concat(word(5), F.initcap(word(6)), F.initcap(word(7)), F.lit("()")), True), (F.concat(F.lit("AKIAEXAMPLE"), F.lit("EXAMPLEX")), False),
        (F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), F.concat_ws(" ", F.lit("your"), word(1), word(2), word(3), F.lit("here")), F.lit("\n-----END PRIVATE KEY-----")), False), (F.concat_ws("/", *[word(k) for k in range(1, 11)] * 4), True),
        (F.concat(F.lit("npm_"), F.rpad(F.lit(""), size(36, 40, 6), "x")), False), (F.concat(F.lit("glpat-"), F.concat_ws("-", F.lit("your"), word(1), word(2), word(3), F.lit("here"))), False), (F.concat(F.lit("process.env."), F.upper(word(3)), F.lit("_"), F.upper(word(9))), True),
    ]
    case = lambda options, at, k: reduce(lambda c, o: c.when(at == o[0], o[1][k]), list(enumerate(options))[1:], F.when(at == 0, options[0][k]))
    label = F.pmod(F.xxhash64(i, F.lit("label")), F.lit(2))
    at = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(len(real)))  # both lists are of one length
    assigned = F.when(label == 1, case([(v, F.lit(a)) for v, a in real], at, 1)).otherwise(case([(v, F.lit(a)) for v, a in alarm], at, 1))
    value = F.when(label == 1, case(real, at, 0)).otherwise(case(alarm, at, 0))
    quote = pick(['"', "'", ""], "quote")
    name = pick(["token", "secret", "password", "api_key", "access-key"], "name")
    noise = lambda k: F.when(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(3)) == 0, pick(["the", "of value", "de la", "set to", "und", "see docs", "commit"], k + "w")).otherwise("")
    return (
        spark.range(0, rows, 1, 2)
        .withColumns({"label": label.cast("double"), "assigned": assigned, "value": value})
        .withColumn("before", F.concat(noise("l"), F.when(F.col("assigned"), F.concat(F.lit(" "), name, F.lit(" = "), quote)).otherwise(" ")))
        .withColumn("after", F.concat(quote, F.lit(" "), noise("r")))
        .withColumn("source", F.when(F.pmod(F.xxhash64(i, F.lit("path")), F.when(label == 1, 20).otherwise(3)) == 0, pick(["tests/unit", "docs/guide", "example"], "p1")).otherwise(pick(["src/main", "web", "src0", None], "p2")))
    )


def train(spark: SparkSession, rows: int = 4000, trees: int = 24, depth: int = 6, seed: int = 4, words: DataFrame | None = None) -> PipelineModel:
    """A forest on `rows` labelled findings; a fixed number, so its cost doesn't grow with the corpus."""
    found = labelled_findings(spark, rows)
    findings = cut(with_features(found if words is None else cut(found), words).select("label", *FEATURES))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64)
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model: RandomForestClassificationModel = forest.fit(gather.transform(findings))
    return PipelineModel([gather, model])


def scan(spark: SparkSession, docs: DataFrame, model: PipelineModel | None = None, threshold: float = 0.5, words: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, at, start, length, value, probability and secret (the verdict) of each candidate.

    Without a model, the dictionary is made of `docs` and a forest is fitted with it; a model that
    was fitted with `words` needs them.
    """
    if model is None:
        words = dictionary(docs)
        model = train(spark, words=words)
    found = candidates(docs)
    scored = model.transform(with_features(found if words is None else cut(found), words))
    p = vector_to_array("probability").getItem(1)
    return scored.select("doc_id", "text_hash", "at", "start", "length", "value", p.alias("probability"), (p >= threshold).alias("secret"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret of `findings` (what `scan` gives for them) replaced by `mark`; columns and rows stay."""
    verdicts = findings.select("doc_id", "text_hash", F.struct("at", "length", "secret").alias("verdict")).distinct()  # as many as one text has candidates
    verdicts = verdicts.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("verdict")).alias("verdicts"), F.bool_or("verdict.secret").alias("any")).filter("any")
    text, found = docs["text"], matches(docs["text"])

    def piece(gap: Column, i: Column) -> Column:
        v, m = F.get(verdicts["verdicts"], i), F.get(found, i)
        return F.concat(gap, F.coalesce(F.when(v["secret"], F.concat(F.substr(m, F.lit(1), F.length(m) - v["length"]), F.lit(mark))).otherwise(m), F.lit("")))

    clean = F.array_join(F.transform(gaps(text), piece), "")
    joined = docs.join(verdicts, docs["doc_id"].cast("long").eqNullSafe(verdicts["doc_id"]) & (F.xxhash64(text) == verdicts["text_hash"]), "left")
    return joined.select(*[F.when(verdicts["any"], clean).otherwise(text).alias("text") if c == "text" else docs[c] for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "probability", "secret")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact(docs, scan(spark, docs))
