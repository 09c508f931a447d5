"""Secrets in text: plain patterns, and parts of credentials that occur together."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lociflow.llm.scratch import Scratch

# kind, pattern, group whose length counts, least length of it, part it is of a credential, weak
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = [
    ("assign", ASSIGN, 2, 8, "secret", False),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16, "identifier", False),
    ("hex", "[0-9a-f]{32,}", 0, 32, "secret", False),
    ("identifier", "(?i)(?<![a-z0-9_])(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\\x20*[:=]"
                   "\\x20*[\"']?[a-z0-9+/_.@-]{3,}", 0, 1, "identifier", True),
    ("key", "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,39}[0-9])(?=[0-9a-f]{0,39}[A-Zg-z+/_-])[A-Za-z0-9+/_-]{40}"
            "(?![A-Za-z0-9+/_-])", 0, 1, "secret", True),
    ("endpoint", "(?i)(?<![a-z0-9])(?:https?|ftp|ssh|jdbc:[a-z]{2,16}|postgres|mysql|redis|amqp|mongodb)://"
                 "[^\\x20\\x09-\\x0D\"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9]|\\.[0-9])", 0, 1, "endpoint", True),
]
N_BASE = 3
# A part is completed by any of these.
COMPLETED_BY = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def find_secrets(docs: DataFrame, scope: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Base kinds (assign, access, hex) are always reported. Weak kinds (identifier,
    key, endpoint) only where a part that completes them starts at most ``scope`` code
    points before or after. That is an interval join: a row is cut into cells of
    that length, of each role in a cell the first and last start are kept, and a part
    meets those of its own cell and both beside it. The nearest complement in a cell beside is
    its last or first, and in its own any will do, so no pairs arise. Positions are code points, the end exclusive. They come from the
    lengths of matches and of the gaps between them, added up in a window over one
    document and kind.

    Null text counts as empty and gives zero counts and empty lists, a null
    identifier stays null, repeated rows each get a row; ties in start go by kind
    as listed, then end. Only the two named columns are read.
    """
    scratch = Scratch(docs.sparkSession)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def found(i: int, pattern: str, group: int):
        p = F.lit(pattern)
        part = F.struct(F.lit(i).alias("kind"),
                        F.transform(F.split("text", pattern, -1), F.length).alias("gaps"),
                        F.transform(F.regexp_extract_all("text", p, F.lit(0)), F.length).alias("lens"),
                        F.transform(F.regexp_extract_all("text", p, F.lit(group)), F.length).alias("values"))
        return F.when(F.col("text").rlike(pattern), part)

    rows = scratch.write(text.select("doc_id", F.monotonically_increasing_id().alias("row_no"), F.array_compact(
        F.array(*(found(i, k[1], k[2]) for i, k in enumerate(KINDS)))).alias("found")), "rows")
    each = rows.where(F.size("found") > 0).select("row_no", F.explode("found").alias("f")).select("row_no", "f.kind", F.posexplode(
        F.arrays_zip(F.slice("f.gaps", F.lit(1), F.size("f.lens")).alias("gap"), F.col("f.lens").alias("len"), F.col("f.values").alias("value"))))
    before = Window.partitionBy("row_no", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.lit([k[3] for k in KINDS]), F.col("kind") + 1)
    end = F.sum(F.col("col.gap") + F.col("col.len")).over(before)
    parts = scratch.write(each.select("row_no", "kind", (end - F.col("col.len")).alias("start"), end.alias("end"),
                                      (F.col("col.value") >= least).alias("ok")).where("ok").drop("ok"), "parts")

    placed = parts.select("*", F.element_at(F.lit([k[4] for k in KINDS]), F.col("kind") + 1).alias("role"), F.floor(F.col("start") / scope).alias("cell"))
    ends = placed.groupBy("row_no", "cell", F.col("role").alias("other")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    completes = F.when(F.col("role") == "secret", F.col("other").isin(*COMPLETED_BY["secret"])).otherwise(F.col("other") == "secret")
    near = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope)
    around = placed.where(F.col("kind") >= N_BASE).withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    linked = around.join(ends, ["row_no", "cell"]).where(completes & near).select("row_no", "kind", "start", "end").distinct()

    span = F.struct("start", "kind", "end").alias("span")
    spans = parts.where(F.col("kind") < N_BASE).unionByName(linked).select("row_no", F.lit(None).cast(text.schema["doc_id"].dataType).alias("doc_id"), span)
    bare = rows.select("row_no", "doc_id", F.lit(None).cast("struct<start:bigint,kind:int,end:bigint>").alias("span"))
    lists = spans.unionByName(bare).groupBy("row_no").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list("span")).alias("spans"))
    names = F.lit([k[0] for k in KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(i):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < N_BASE)
    return lists.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
