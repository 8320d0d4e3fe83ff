"""Personal data by weak supervision, in SQL functions alone.

Strong patterns are always reported. Weaker candidates - local phone numbers, social security numbers,
account numbers, titled names, given names before a capitalised word - get votes from labelers: the strictness of their form, gazetteers, words of
context, and what stands near. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern is personal; these soft labels train a naive Bayes
classifier over a span's features, which decides about the candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import in_blocks, joined, let, match_spans, shown
from .store import kept, staged

#: The strong patterns, made possessive where that cannot change a match, and started only
#: at the end of a match or the start of a run, as no match starts later inside a run where its start fails.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Common given names and family names of English, German, French and Spanish, and words of addresses.
GIVEN = (
    "Adam Adrian Alan Alejandro Alexander Alice Alicia Amelia Ana Andrea Andreas Andrew Angela Anna Anne Antoine Antonio Arthur Barbara Beatriz Benjamin Bernd Bernard Brian Camille Carla Carlos "
    "Carmen Caroline Catherine Charles Charlotte Christian Christine Claire Claudia Daniel David Diana Diego Dieter Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Francisco Frank "
    "Gabriel George Gerhard Hannah Hans Heinrich Helen Henri Henry Ines Isabel Jack Jacques James Jan Javier Jean Jennifer Johann John Jonas Jorge Jose Joseph Juan Julia Julie Karin Karl Katharina "
    "Klaus Laura Lea Leon Louis Lucas Lucia Luis Manuel Maria Marie Mark Markus Martin Mary Matthew Maximilian Michael Michel Miguel Monika Nicolas Nina Olivia Oscar Pablo Patricia Patrick Paul "
    "Pedro Peter Philip Philippe Pierre Rafael Rebecca Ricardo Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Sebastian Simon Sofia Sophie Stefan Stephen Susan Sven Teresa Thomas Ursula Victor "
    "Walter William Wolfgang Yves"
).split()
FAMILY = (
    "Anderson Bauer Becker Bernard Brown Clark Davis Diaz Dubois Durand Evans Fernandez Fischer Garcia Gomez Gonzalez Green Hall Harris Hernandez Hoffmann Jackson Johnson Jones Klein Koch Lambert "
    "Laurent Lefebvre Leroy Lewis Lopez Martinez Meyer Miller Moreau Moreno Morris Petit Perez Ramirez Richter Roberts Robinson Rodriguez Romero Roux Ruiz Sanchez Schmidt Schneider Schulz Schwarz "
    "Smith Taylor Thompson Torres Vidal Wagner Weber White Williams Wilson Wolf Wright Zimmermann"
).split()
PLACES = "street avenue road lane boulevard straße strasse gasse platz rue allée calle avenida plaza".split()

#: Weak candidates by kind.
WEAK = {
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
    "person": r"(?=[A-Z][a-z]{1,30}\x20[A-Z][a-z])(?<![A-Za-z.]|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20)(?:" + "|".join(GIVEN) + r")\x20[A-Z][a-z]{1,30}(?![A-Za-z])",
}
STRICT = {
    "local_phone": r"^\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}$|^([0-9]{3})([.-])[0-9]{3}\2[0-9]{4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "account": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})+$",
    "name": r"\.\x20[A-Z][a-z]+\x20[A-Z]",
    "person": r"\x20(?:" + "|".join(FAMILY) + ")$",
}
GAZETTEER = r"(?i)\b(?:iban|" + "|".join([*GIVEN, *FAMILY, *PLACES]) + r")\b"
CUES = r"(?i)\b(?:tel|telephone|phone|call|mobile|fax|contact|ssn|social|account|iban|name|born|dear|patient|telefon|t[ée]l[ée]phone|tel[ée]fono|konto|compte|cuenta|nom|nombre)\b"
COUNTER = r"(?i)\b(?:order|invoice|isbn|issn|version|ref|reference|serial|part|model|page|no|nr)\b"
DULL = r"^[^0-9A-Za-z]*(?:([0-9])[^0-9A-Za-z]*)(?:\1[^0-9A-Za-z]*)+$"
LABELERS = ("form", "gazetteer", "context", "content", "company")


def strong(text: Column) -> Column:
    """Struct of the strong spans by kind."""
    small = lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.char_length(x) < 3) | ((F.char_length(x) == 3) & (x <= "255")))
    digits = lambda m: F.regexp_replace(m["value"], "[^0-9]", "")
    doubled = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    luhn = lambda x: F.aggregate(F.transform(F.split(F.reverse(x), "(?!^)(?!$)"), lambda d, i: doubled(d.cast("int"), i)), F.lit(0), lambda a, d: a + d) % 10 == 0
    card = lambda m: let(digits(m), lambda x: F.when(F.char_length(x).between(13, 19), luhn(x)).otherwise(False))
    dialled = lambda m: F.char_length(digits(m)).between(9, 15)
    email = F.when(text.contains("@"), match_spans(text, EMAIL)).otherwise(match_spans(F.lit(""), EMAIL))
    phone = F.when(text.contains("+"), match_spans(text, PHONE)).otherwise(match_spans(F.lit(""), PHONE))
    return F.struct(
        email.alias("email"),
        F.filter(match_spans(text, IP), lambda m: F.forall(F.split(m["value"], r"\."), small)).alias("ip"),
        F.filter(match_spans(text, CARD), card).alias("card"),
        F.filter(phone, dialled).alias("phone"),
    )


def votes(kind: str, m: Column, near: Column) -> Column:
    """Votes of the labelers on a candidate: 1 for, -1 against, 0 none. A given name does not vouch for itself."""
    around = F.concat_ws(" ", m["before"], m["after"])
    named = around if kind == "person" else F.concat_ws(" ", m["before"], m["value"], m["after"])
    return F.struct(
        F.when(m["value"].rlike(STRICT[kind]), 1).otherwise(0).alias("form"),
        F.when(named.rlike(GAZETTEER), 1).otherwise(0).alias("gazetteer"),
        F.when(around.rlike(CUES), 1).when(around.rlike(COUNTER), -1).otherwise(0).alias("context"),
        F.when(m["value"].rlike(DULL), -1).otherwise(0).alias("content"),
        F.when(near, 1).otherwise(0).alias("company"),
    )


def candidates(text: Column, base: Column) -> Column:
    """Weak candidates that overlap no strong span, with votes and features.

    Strong spans are looked up by blocks, so a text with very many of them costs little more than its length.
    """
    spans = F.array_sort(F.concat(*[F.transform(base[k], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in BASE]))
    blocks = F.transform(in_blocks(spans), lambda b: F.struct(b.alias("spans"), F.array_min(F.transform(b, lambda s: s["start"])).alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high")))

    def meets(b: Column, m: Column, margin: int) -> Column:
        inside = lambda low, high: (low < m["end"] + margin) & (high > m["start"] - margin)
        return F.exists(b, lambda x: F.coalesce(inside(x["low"], x["high"]), F.lit(False)) & F.exists(x["spans"], lambda s: inside(s["start"], s["end"])))

    def of(b: Column, order: int, kind: str, pattern: str) -> Column:
        free = F.filter(match_spans(text, pattern, 40), lambda m: ~meets(b, m, 0))
        length = lambda m: F.least(F.floor(F.char_length(m["value"]) / 4), F.lit(9)).cast("int")
        edge = lambda m: F.when(F.right(m["before"], F.lit(1)).rlike(r"^[\s(\"':]?$"), 1).otherwise(0)
        return F.transform(free, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), m["start"].alias("start"), m["end"].alias("end"), votes(kind, m, meets(b, m, 60)).alias("votes"), length(m).alias("length"), edge(m).alias("edge")))

    return let(blocks, lambda b: F.concat(*[of(b, order, kind, pattern) for order, (kind, pattern) in enumerate(WEAK.items())]))


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counts of vote patterns.

    Returns the share of personal spans, each labeler's chance of voting rightly given that it votes (if
    personal, if not), and each pattern's chance of being personal. Starts from labelers that are right
    at 0.7, and counts each of these beliefs as five spans, so few candidates move them little.
    """
    prior, right, believed = 0.5, [(0.7, 0.7)] * len(LABELERS), 5.0
    chance: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (a, b) in zip(p, right):
                if v:
                    yes += math.log(a if v > 0 else 1 - a)
                    no += math.log(1 - b if v > 0 else b)
            chance[p] = 1 / (1 + math.exp(no - yes))
        total = sum(patterns.values())
        prior = (sum(n * chance[p] for p, n in patterns.items()) + 0.5 * believed) / (total + believed)
        for k in range(len(LABELERS)):
            sums = [[0.7 * believed, believed], [0.7 * believed, believed]]
            for p, n in patterns.items():
                if p[k]:
                    sums[0][1] += n * chance[p]
                    sums[1][1] += n * (1 - chance[p])
                    sums[0][0] += n * chance[p] * (p[k] > 0)
                    sums[1][0] += n * (1 - chance[p]) * (p[k] < 0)
            right[k] = tuple(min(0.99, max(0.01, s / t)) for s, t in sums)
    return prior, right, chance


FEATURES = ("kind", "form", "gazetteer", "context", "content", "company", "length", "edge")


def train(spans: DataFrame) -> tuple[float, dict[tuple[str, str], float]]:
    """Log odds of the classifier: the base and one for each (feature, value), from ``spans`` of candidates.

    Only counts of vote patterns and of feature values go to the driver; both are limited by the number of
    labelers and of values (a few hundred), whatever the input.
    """
    rows = spans.select("c.kind", *[F.col("c.votes")[x].alias(x) for x in LABELERS], "c.length", "c.edge")
    patterns = {tuple(r[x] for x in LABELERS): r["n"] for r in rows.groupBy(*LABELERS).agg(F.count("*").alias("n")).collect()}
    prior, _, chance = reliabilities(patterns)
    if not patterns:
        return 0.0, {}
    key = F.concat_ws(",", *[F.col(x).cast("string") for x in LABELERS])
    soft = F.create_map(*[x for p, c in sorted(chance.items()) for x in (F.lit(",".join(map(str, p))), F.lit(c))])[key]
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in FEATURES])).alias("x")
    counts = rows.withColumn("soft", soft).select("soft", values).groupBy("x.feature", "x.value").agg(F.sum("soft").alias("yes"), F.sum(1 - F.col("soft")).alias("no")).collect()
    kinds = {f: sum(r["feature"] == f for r in counts) for f in FEATURES}
    sums = {f: [sum(r[side] for r in counts if r["feature"] == f) for side in ("yes", "no")] for f in FEATURES}
    log_odds = {(r["feature"], r["value"]): math.log((r["yes"] + 1) / (sums[r["feature"]][0] + kinds[r["feature"]])) - math.log((r["no"] + 1) / (sums[r["feature"]][1] + kinds[r["feature"]])) for r in counts}
    return math.log(prior / (1 - prior)), {k: round(v, 9) for k, v in log_odds.items()}


def scan_personal(docs: DataFrame, keep: list[str], text: str = "text", least: float = 0.5, trained: tuple[float, dict[tuple[str, str], float]] | None = None) -> DataFrame:
    """``keep``, n_email, n_ip, n_card, n_phone, __base and __spans (structs by kind, then start) of each row.

    Candidates are reported if the classifier gives them ``least`` or more; it is trained on these rows
    unless ``trained`` (what ``train`` returns) is given. Null text counts as empty; repeated rows give
    repeated results; columns in ``keep`` that are named like a count are left out; without candidates
    only strong spans are reported; an empty table gives an empty result.
    """
    keep = kept(keep, [f"n_{k}" for k in BASE])
    value = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(*[docs[c] for c in keep], value.alias("__text"), strong(value).alias("__found"))
    rows = rows.select(*keep, *[shown(k, F.col("__found")[k]).alias(f"__{k}") for k in BASE], candidates(F.col("__text"), F.col("__found")).alias("__candidates"))
    rows = staged(rows, "personal")
    base_odds, odds = trained or train(rows.select(F.explode("__candidates").alias("c")))
    table = F.create_map(*[x for (f, v), o in sorted(odds.items()) for x in (F.lit(f"{f}={v}"), F.lit(o))]) if odds else F.create_map(F.lit(""), F.lit(0.0))
    of = lambda c, f: c["votes"][f] if f in LABELERS else c[f]
    score = lambda c: F.lit(base_odds) + sum((F.coalesce(table[F.concat(F.lit(f"{f}="), of(c, f).cast("string"))], F.lit(0.0)) for f in FEATURES), F.lit(0.0))
    cut = math.log(least / (1 - least))
    added = F.array_sort(F.transform(F.filter("__candidates", lambda c: score(c) >= cut), lambda c: F.struct(c["order"].alias("order"), c["start"].alias("start"), c["end"].alias("end"), F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string")).alias("shown"))))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["shown"].alias("shown")))
    base = F.concat(*[plain(F.col(f"__{k}")) for k in BASE])
    return rows.select(*keep, *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], base.alias("__base"), F.concat(base, plain(added)).alias("__spans"))


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of the query."""
    return found.select(*keep, *[f"n_{k}" for k in BASE], F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))
