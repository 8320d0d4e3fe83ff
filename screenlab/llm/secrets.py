"""Secret scan with linking of multipart credentials, in SQL functions alone.

Strong patterns stand by themselves. Weak parts - identifiers, secret-like strings and endpoints - are
reported only next to their complement: an identifier next to a secret, a secret next to an identifier, an
endpoint next to both; parts that overlap do not vouch for each other. Parts meet by an interval join: every part is put into the bins of its document that
its scope touches, and bins are joined. Parts of a class do not overlap and are six characters long or
more, so a bin holds a bounded number of them and the join grows with the text, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import joined, masked, match_spans, shown
from .store import kept, numbered

#: The strong patterns. A shorter run of the second and third is no match at all, and no
#: match starts inside one, so their lengths are asked for in the pattern; the first is checked afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts. Lookbehinds keep long runs from being tried at each of their characters.
IDENTIFIER = r"(?i:client|account|tenant|access_?key)_?(?i:id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.-]{6,}"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"https?://[A-Za-z0-9.-]{4,}(?::[0-9]+)?"
#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")


def strong(text: Column) -> Column:
    """Struct of the strong spans by kind."""
    long_enough = lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 1)) >= 6
    return F.struct(F.filter(match_spans(text, ASSIGN), long_enough).alias("assign"), match_spans(text, ACCESS).alias("access"), match_spans(text, HEX).alias("hex"))


def _mixed(m: Column) -> Column:
    return m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]") & m["value"].rlike("[0-9]")


def has_identifier(text: Column) -> Column:
    """Whether a text may hold an identifier; every rule of ``linked`` needs one."""
    value = F.coalesce(text, F.lit(""))
    return value.contains("AKIA") | value.rlike(IDENTIFIER)


def linked(docs: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """__key (MD5 of a text) and __linked: its weak parts with a complement within ``scope`` characters.

    Only texts with an identifier are looked at, each distinct text once.
    """
    value = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(docs[text].alias("__text")).filter(has_identifier(F.col("__text"))).select(F.md5(F.encode(value, "utf-8")).alias("__key"), "__text").dropDuplicates(["__key"])
    classes = {
        "identifier": [("access", 1, match_spans(value, ACCESS)), ("identifier", 3, match_spans(value, IDENTIFIER))],
        "secret": [("assign", 0, strong(value)["assign"]), ("hex", 2, match_spans(value, HEX)), ("opaque", 4, F.filter(match_spans(value, OPAQUE), _mixed))],
        "endpoint": [("endpoint", 5, match_spans(value, ENDPOINT))],
    }

    def part(name: str, kind: str, order: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(name).alias("class"), F.lit(kind).alias("kind"), F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end")))

    parts = [part(name, kind, order, spans) for name, kinds in classes.items() for kind, order, spans in kinds]
    parts = rows.select("__key", F.explode(F.concat(*parts)).alias("p")).select("__key", "p.*")
    bins = lambda margin: F.explode(F.sequence(F.floor((F.col("start") - margin) / scope), F.floor((F.col("end") + margin) / scope))).alias("bin")
    weak = parts.filter("order >= 3").select("__key", "class", "kind", "order", "start", "end", bins(scope))
    other = parts.select("__key", F.col("class").alias("class2"), F.col("start").alias("start2"), F.col("end").alias("end2"), bins(0))
    near = weak.join(other, ["__key", "bin"]).filter((F.col("start2") <= F.col("end") + scope) & (F.col("end2") >= F.col("start") - scope) & ((F.col("end2") <= F.col("start")) | (F.col("start2") >= F.col("end"))) & (F.col("class2") != F.col("class")))
    beside = near.groupBy("__key", "class", "kind", "order", "start", "end").agg(F.bool_or(F.col("class2") == "identifier").alias("id"), F.bool_or(F.col("class2") == "secret").alias("secret"))
    beside = beside.filter(((F.col("class") == "identifier") & F.col("secret")) | ((F.col("class") == "secret") & F.col("id")) | (F.col("id") & F.col("secret")))
    one = F.struct("start", "order", "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("shown"))
    return beside.groupBy("__key").agg(F.collect_list(one).alias("__linked"))


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", scope: int = 200, salts: int = 64) -> DataFrame:
    """``keep``, n_assign, n_access, n_hex, __base and __spans (structs in order of start, then kind) of each row.

    Null text counts as empty. Spans depend on the text alone, so repeated rows and copies have the same
    ones. Only rows with an identifier are shuffled; they meet the links of their text by its MD5 and one of
    ``salts`` numbers, so the copies of a text are many tasks' work. Columns in ``keep`` that are named like a
    count are left out. An empty table gives an empty result.
    """
    keep = kept(keep, [f"n_{k}" for k in KINDS[:3]])
    counts = [f"n_{k}" for k in KINDS[:3]]

    def based(rows: DataFrame, *more: Column) -> DataFrame:
        found = rows.select(*[rows[c] for c in keep], *more, strong(F.coalesce(rows[text], F.lit(""))).alias("__found"))
        base = F.array_sort(F.concat(*[shown(k, F.col("__found")[k], i) for i, k in enumerate(KINDS[:3])]))
        sizes = [F.size(F.col("__found")[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
        return found.select(*keep, *[c for c in found.columns if c in ("__key", "__salt")], *sizes, base.alias("__base"))

    may = has_identifier(docs[text])
    key = F.md5(F.encode(F.coalesce(docs[text], F.lit("")), "utf-8")).alias("__key")
    # which of the same links a row meets: by its columns and, for repeated rows, by where it stands
    salt = F.pmod(F.xxhash64(*[docs[c] for c in keep], F.spark_partition_id()), F.lit(salts)).cast("int").alias("__salt")
    plain = based(docs.filter(~may)).withColumn("__spans", F.col("__base"))
    links = linked(docs, text, scope).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = based(docs.filter(may), key, salt).join(links, ["__key", "__salt"], "left")
    spans = F.when(F.col("__linked").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__linked")))
    return plain.unionByName(rows.select(*keep, *counts, "__base", spans.alias("__spans")))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """The rows with all secrets in ``text`` replaced by ``mark``; the other columns stay, whatever their names.

    Null text stays null; repeated rows give repeated results, an empty table an empty one.
    """
    inner, columns = numbered(docs), docs.columns
    at = f"__c{columns.index(text)}"
    found = scan_secrets(inner, inner.columns, at, scope).withColumn(at, masked(F.col(at), F.col("__spans"), mark))
    return found.select(*inner.columns).toDF(*columns)


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of the query."""
    return found.select(*keep, "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))
