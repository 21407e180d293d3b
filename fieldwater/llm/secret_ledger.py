"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

Every version of every text is addressed by the hash of its content. The ledger
keeps which (blob, rule version) pairs were scanned and what was found; a scan
reads only texts of pairs that are not in it, one row for each blob however
many paths hold it, and joins the findings back to all rows. Findings are
written before the pairs are marked as scanned, so an interrupted scan is
repeated, never lost.

Defined cases: a NULL text counts as empty and has no findings; rows that
repeat are each reported; rows without id are reported with a NULL id. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldwater.llm.store import small


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that holds the secret and how many characters that needs."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# A run of fewer than 32 hex digits, or a key of fewer than 16 characters, can't
# be part of a longer match, so these two carry their minimum in the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

SCANNED = "blob_id string, rule string"
FINDINGS = 'blob_id string, rule string, kind string, start long, `end` long'


class Ledger:
    """Two tables in a shared folder: scanned pairs and findings."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(SCANNED).parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        """Without the repeats that an interrupted scan may have left."""
        return self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings").distinct()

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...], doc_id: str, text: str) -> DataFrame:
    """(blob_id, rep, pending): blobs with rules they were not scanned by, and the smallest id that holds them."""
    blobs = docs.select(F.col(doc_id).alias("doc_id"), blob_id(F.col(text)).alias("blob_id")).groupBy("blob_id").agg(F.min("doc_id").alias("rep"))
    names = [r.name for r in rules]
    done = ledger.scanned().filter(F.col("rule").isin(names)).groupBy("blob_id").agg(F.collect_set("rule").alias("done"))
    listed = F.array(*[F.lit(n) for n in names])
    pending = F.array_except(listed, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob_id", "left").select("blob_id", "rep", pending.alias("pending")).filter(F.size("pending") > 0)


def _matches(rule: Rule) -> Column:
    """Of one rule: the lengths of the text between matches, of the matches and of their secrets."""
    lengths = lambda parts: F.transform(parts, F.length)
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.lit(rule.name).alias("rule"),
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.least).alias("least"),
        lengths(F.split("body", rule.pattern, -1)).alias("gaps"),
        lengths(F.regexp_extract_all("body", pattern, F.lit(0))).alias("sizes"),
        lengths(F.regexp_extract_all("body", pattern, F.lit(rule.group))).alias("secrets"),
    )
    return F.when(F.array_contains("pending", rule.name) & F.col("body").rlike(rule.pattern), found)


def find_spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob_id, body, pending): code-point spans of the matches whose secret is long enough."""
    per_rule = texts.select("blob_id", F.explode(F.array_compact(F.array(*[_matches(r) for r in rules]))).alias("m"))
    # A document repeated whole offers its blob more than once.
    per_rule = per_rule.select("blob_id", "m.*").dropDuplicates(["blob_id", "rule"])
    steps = F.arrays_zip(F.slice("gaps", 1, F.size("sizes")).alias("gap"), F.col("sizes").alias("size"), F.col("secrets").alias("secret"))
    each = per_rule.select("blob_id", "rule", "kind", "least", F.posexplode(steps).alias("n", "s"))
    each = each.select("blob_id", "rule", "kind", "least", "n", "s.gap", "s.size", "s.secret")
    # A match ends where all gaps and matches so far end.
    until = W.partitionBy("blob_id", "rule").orderBy("n")
    end = F.sum(F.col("gap") + F.col("size")).over(until)
    spans = each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("size"))
    return spans.filter(F.col("secret") >= F.col("least")).select("blob_id", "rule", "kind", "start", "end")


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> None:
    """Bring the ledger up to date with the texts of ``docs``."""
    spark = docs.sparkSession
    path = f"{ledger.path}/pending"
    unseen(docs, ledger, rules, doc_id, text).write.mode("overwrite").parquet(path)
    todo = spark.read.parquet(path)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    on = F.col("_id").eqNullSafe(F.col("rep")) & (F.sha2("body", 256) == F.col("blob_id"))
    # One row of each pending blob is wanted; however many there are, texts are moved at most once.
    texts = rows.join(todo, on).select("blob_id", "body", "pending")
    ledger.add("findings", find_spans(texts, rules).distinct())
    ledger.add("scanned", todo.select("blob_id", F.explode("pending").alias("rule")))


def secrets(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, blob_id, found) for every row: all findings of the given rules as an array of (start, end, kind).

    Scans what the ledger lacks first. ``found`` is ordered by start, then by
    the order of the rules.
    """
    scan(docs, ledger, rules, doc_id, text)
    order = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule"))
    held = ledger.findings().filter(F.col("rule").isin([r.name for r in rules]))
    per_blob = held.groupBy(F.col("blob_id").alias("_blob")).agg(F.array_sort(F.collect_list(F.struct("start", order.alias("rank"), "end", "kind"))).alias("found"))
    path = f"{ledger.path}/by_blob"
    per_blob.write.mode("overwrite").parquet(path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), blob_id(F.col(text)).alias("blob_id"))
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    joined = rows.join(small(docs.sparkSession.read.parquet(path)), F.col("blob_id") == F.col("_blob"), "left")
    return joined.select("doc_id", "blob_id", F.coalesce("found", none).alias("found"))


def digest_columns(found: DataFrame) -> DataFrame:
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[count(k) for k in base], F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
