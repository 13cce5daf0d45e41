"""Which files are code, and what the code can do: every distinct content is profiled once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import code
from ..functions import text as T
from ..schemas import PROFILES


def entry_reasons(files: DataFrame, packages: DataFrame) -> DataFrame:
    """pair_id, side, path and reason of files that a manifest field or a script names."""
    tokens = F.filter(F.flatten(F.transform(F.map_values("scripts"), lambda c: F.split(c, r"[\s;|&<>()\"']+"))), lambda t: (t != "") & ~t.startswith("-"))
    named = packages.select("pair_id", "side", F.explode(F.array(F.struct(F.lit(0).alias("first"), F.lit("manifest-entry").alias("reason"), F.col("entry_points").alias("names")), F.struct(F.lit(1).alias("first"), F.lit("lifecycle-script").alias("reason"), tokens.alias("names")))).alias("x"))
    named = named.select("pair_id", "side", "x.first", "x.reason", F.explode("x.names").alias("raw"))
    plain = F.regexp_replace(F.regexp_replace(F.replace("raw", F.lit("\\"), F.lit("/")), r"^\./", ""), "^/+", "")
    named = named.withColumn("plain", plain).filter((F.col("plain") != "") & ~F.col("plain").startswith("../") & ~F.col("plain").contains("\x00"))
    suffixes = F.array(*map(F.lit, rules.CANDIDATE_SUFFIXES))
    tried = named.select("pair_id", "side", "first", "reason", "plain", F.posexplode(suffixes).alias("pos", "suffix")).withColumn("path", F.concat("plain", "suffix"))
    hit = tried.join(files.select("pair_id", "side", "path"), ["pair_id", "side", "path"])
    best = hit.groupBy("pair_id", "side", "first", "reason", "plain").agg(F.min_by("path", "pos").alias("path"))
    return best.groupBy("pair_id", "side", "path").agg(F.min_by("reason", "first").alias("entry_reason"))


def code_files(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Files that count as code, with ext and reason."""
    head = T.valid_text(F.substring(F.coalesce("content", "probe"), 1, rules.PROBE_BYTES))
    named = files.join(entry_reasons(files, packages), ["pair_id", "side", "path"], "left")
    return named.withColumn("ext", T.extension("path")).withColumn("reason", T.code_reason(F.col("path"), F.col("kind"), head, F.col("entry_reason"))).filter("reason is not null")


def profile_contents(contents: DataFrame) -> DataFrame:
    """PROFILES of distinct (sha256, ext, content). The only Python of the audit; Arrow batches in and out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PROFILES), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    got = code.profile(row["content"].decode("utf-8", "replace"), row["ext"])
                except Exception as e:  # a content that defeats the reader is a gap, and no other content suffers
                    got = {"signals": [], "hosts": [], "gaps": [("parse-failure", f"the analysis failed: {type(e).__name__}")]}
                yield pa.RecordBatch.from_pylist(
                    [{
                        "sha256": row["sha256"], "ext": row["ext"],
                        "signals": [dict(zip(("capability", "line", "message", "snippet"), x)) for x in got["signals"]],
                        "hosts": [dict(zip(("host", "line", "snippet"), x)) for x in got["hosts"]],
                        "gaps": [dict(zip(("reason", "detail"), x)) for x in got["gaps"]],
                    }],
                    schema=schema,
                )

    return contents.select("sha256", "ext", "content").mapInArrow(run, PROFILES)


def profiled(coded: DataFrame) -> DataFrame:
    """Code files joined to the profile of their content."""
    contents = coded.filter("content is not null").groupBy("sha256", "ext").agg(F.first("content").alias("content"))
    return coded.join(profile_contents(contents), ["sha256", "ext"], "left")


def signals(profiles: DataFrame) -> DataFrame:
    one = profiles.select("pair_id", "side", "path", "sha256", F.explode("signals").alias("s")).select("pair_id", "side", "path", "sha256", "s.*")
    return one.dropDuplicates(["pair_id", "side", "path", "capability", "line", "message"])


def host_mentions(profiles: DataFrame) -> DataFrame:
    return profiles.select("pair_id", "side", "path", F.posexplode("hosts").alias("ord", "h")).select("pair_id", "side", "path", "ord", "h.*")


def gaps(profiles: DataFrame, max_text_bytes: int) -> DataFrame:
    """Code that wasn't read, or not wholly understood. What is not analysed is never silently clean."""
    unread = profiles.filter("content is null").select(
        "pair_id", "side", "path", "sha256", F.lit("size-limit").alias("reason"),
        F.concat(T.thousands("size"), F.lit(f" bytes are more than the limit of {max_text_bytes:,} for analysed text; taken as code for "), F.col("reason")).alias("detail"),
    )
    parsed = profiles.select("pair_id", "side", "path", "sha256", F.explode("gaps").alias("g")).select("pair_id", "side", "path", "sha256", "g.*")
    return unread.unionByName(parsed)


def control_bytes(profiles: DataFrame, least: int = 16) -> DataFrame:
    n = T.control_count("content")
    nul = T.latin("content").contains("\x00")
    found = profiles.filter("content is not null").select("pair_id", "side", "path", "sha256", "reason", n.alias("n"), nul.alias("nul")).filter((F.col("n") >= least) | F.col("nul"))
    return found.withColumn("message", F.concat(T.thousands("n"), F.lit(" control bytes"), F.when(F.col("nul"), " with NUL").otherwise(""), F.lit(" in a file taken as code for "), F.col("reason")))
