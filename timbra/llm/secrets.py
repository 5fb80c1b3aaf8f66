"""Secret scans with multipart credential linking, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Fixed patterns of the base kinds; assign's second group is the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
SHORTEST_VALUE, SHORTEST_ACCESS = 6, 20
#: Weak candidates: names of an account, bare keys, places to use them.
WEAK_ID = r"""(?i:\b(user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
#: A host starts where no host character or word goes on before it and is taken whole, so no
#: text is walked twice and nothing nests, however many dots and hyphens it has.
ENDPOINT = r"(?i:\b(?:https?|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9@:._/-]{4,}+|(?<![a-z0-9_-])(?<![a-z0-9_-]\.)[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}\b|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b)"
#: A scope ends at a blank line.
BREAK = r"\n[\x20\t\r]*\n"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: The role of each kind; a hex run or a value is a secret, an access key an identifier.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "place"}


RAW = "array<struct<kind:string,at:int,gap:int,n:int,v:int>>"


def gate(text: Column, kind: str) -> Column:
    """What every match of a kind contains, by searches far cheaper than its pattern."""
    has = lambda x: F.contains(text, F.lit(x))
    if kind in ("assign", "weak_id"):
        return has(":") | has("=")
    if kind == "access":
        return has("AKIA")
    if kind == "weak_secret":
        return text.rlike("[0-9]")
    return has("://") | text.rlike(r":[0-9]{2}|[0-9]\.[0-9]") if kind == "endpoint" else F.lit(True)


def found(text: Column, kind: str, pattern: str, group: int | None = None) -> Column:
    """The leftmost non-overlapping matches in order: number, length of the gap before, length
    of the match and of its ``group``, in code points. No text leaves this expression."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(hits, lambda x: F.length(x))
    values = sizes if group is None else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))
    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), sizes.alias("n"), values.alias("v")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["g"].alias("gap"), x["n"].alias("n"), x["v"].alias("v")))
    return F.when(gate(text, kind) & text.rlike(pattern), rows).otherwise(F.array().cast(RAW))


def parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id) of every row and (rid, kind, s, e) of every span of every kind, scope
    breaks included where a text has weak candidates. Both are written tables."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    t = F.col("t")
    rows = rows.select("rid", "doc_id", "t", F.concat(found(t, "assign", ASSIGN, 2), found(t, "access", ACCESS), found(t, "hex", HEX)).alias("base"), F.concat(found(t, "weak_id", WEAK_ID), found(t, "weak_secret", WEAK_SECRET), found(t, "endpoint", ENDPOINT)).alias("weak"))
    breaks = F.when(F.size("weak") > 0, found(t, "break", BREAK)).otherwise(F.array().cast(RAW))
    raw = cut(rows.select("rid", "doc_id", F.concat("base", "weak", breaks).alias("raw")))
    upto = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = raw.select("rid", F.explode("raw").alias("x")).select("rid", "x.*").withColumn("e", F.sum(F.col("gap") + F.col("n")).over(upto)).withColumn("s", F.col("e") - F.col("n"))
    least = F.when(F.col("kind") == "assign", SHORTEST_VALUE).when(F.col("kind") == "access", SHORTEST_ACCESS).otherwise(0)
    return raw.select("rid", "doc_id"), cut(spans.filter(F.col("v") >= least).select("rid", "kind", "s", "e"))


def linked(spans: DataFrame) -> DataFrame:
    """(rid, kind, s, e) of the weak candidates to report.

    An interval join of parts with scopes, the stretches between a text's breaks: both are
    walked in order of position, and a part is in the scope after the last break before it.
    Which roles a scope holds is summed up by scope, so no part meets another, and parts link
    at any distance. A weak identifier needs a secret in its scope, a weak secret an identifier,
    an endpoint both.
    """
    weak = F.col("kind").isin(*KINDS[3:])
    scope = F.count_if(F.col("kind") == "break").over(Window.partitionBy("rid").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    rows = spans.join(spans.filter(weak).select("rid").distinct(), "rid", "left_semi").withColumn("scope", scope)
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])[F.col("kind")]
    rows = rows.filter(F.col("kind") != "break").withColumn("role", role)
    roles = rows.groupBy("rid", "scope").agg(F.bool_or(F.col("role") == "id").alias("id"), F.bool_or(F.col("role") == "secret").alias("secret"))
    seen = rows.filter(weak).join(roles, ["rid", "scope"])
    return seen.filter(F.when(F.col("role") == "place", F.col("id") & F.col("secret")).when(F.col("role") == "id", F.col("secret")).otherwise(F.col("id"))).select("rid", "kind", "s", "e")


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``.

    Null and empty texts have no spans; repeated rows are scanned alike; an empty table
    gives none. Base spans always stay; weak ones come with their complements only.
    """
    docs, spans = parts(docs)
    base = spans.filter(F.col("kind").isin(*KINDS[:3]))
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])[F.col("kind")]
    span = F.struct("s", rank.alias("k"), "e", "kind")
    is_base = F.col("kind").isin(*KINDS[:3])
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    found = base.unionByName(linked(spans)).groupBy("rid").agg(*map(count, KINDS[:3]), F.collect_list(F.when(is_base, span)).alias("own"), F.collect_list(span).alias("every"))
    rows = docs.join(found, "rid", "left")
    none = F.lit("")
    return rows.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(F.coalesce(_joined(F.col("own")), none), 256).alias("base_sha256"), F.coalesce(_joined(F.col("every")), none).alias("spans"))
