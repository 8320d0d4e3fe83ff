"""Language, quality, near duplicates and contamination, against brute force."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from screenlab.llm import contamination, language, quality, simhash
from screenlab.llm.queries import ORACLE_SQL, QUERIES

from .conftest import EDGE, SF


def test_language_held_out(spark):
    out = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 200 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97 and all(0 <= r["score"] <= 1 for r in out)


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).withColumn("h", language.is_held_out("id")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_language_scores(spark, edge):
    model = language.fit(edge.filter("doc_id <> 8"), per_language=50, bits=10)
    out = {r["doc_id"]: r for r in language.identify(edge, model, ["doc_id", "score"]).collect()}
    assert out[1]["lang_pred"] == "en" and out[6]["lang_pred"] == "fr"
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (2, 3, 4, 5))
    # plain sums over the n-grams of one text
    text = EDGE[5][1]
    grams = language.ngrams(text, model.orders, model.bits)
    sums = np.array([sum(float(model.logs[g, k]) for g in grams) for k in range(2)])
    assert model.languages[int(sums.argmax())] == "fr" and abs(out[6]["score"] - 1 / np.exp(sums - sums.max()).sum()) < 1e-6
    small = model.predict([text, None, EDGE[0][1]], block=64)
    assert small[0] == ["fr", "und", "en"]


def test_blocks_change_nothing(spark, edge):
    """Neither the size of a block of text nor that of a block of languages changes a result."""
    model = language.fit(edge.filter("doc_id <> 8"), per_language=50, bits=10)
    texts = [t for _, t, _ in EDGE]
    whole = model.predict(texts)
    assert all(model.predict(texts, block) == whole for block in (1, 7, 1000, 1 << 22))
    for text in ("", "a", "ab ΑΣ cd", "日本 x" * 300):
        want = sorted(language.ngrams(text, (1, 2, 3), 15))
        assert all(sorted(np.concatenate(list(language.gram_blocks(text, (1, 2, 3), 15, b)))) == want for b in (1, 2, 5, 64))
    many = spark.createDataFrame([(i, f"{c * 3}{d * 2} {c}{d} " * 9, f"l{i:02d}") for i, (c, d) in enumerate((c, d) for c in "abcde" for d in "vwxyz")], "doc_id long, text string, lang string").unionByName(edge.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    one = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(many, language.fit(many, bits=12), ["doc_id"]).collect()}
    parts = list(language.models(many, bits=12, block_languages=4))
    assert [len(m.languages) for m in parts] == [4] * 6 + [1]
    assert one == {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(many, parts, ["doc_id"]).collect()}
    assert {n for _, n, _ in one} > {f"l{i:02d}" for i in range(25)}


def test_language_without_labels(edge):
    model = language.fit(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(edge, model, ["doc_id"]).collect()} == {"und"}
    assert language.identify(edge.limit(0), model, ["doc_id"]).count() == 0


WORD = r"[^\x20\x09-\x0D]+"


def plain_measures(text):
    text = text or ""
    words = regex.findall(WORD, text)
    lines = [x for x in text.split("\n") if regex.search(WORD, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(again)


def test_measures():
    rnd = random.Random(1)
    for _ in range(400):
        text = "".join(rnd.choice("aab b \n\t\x0b\x85\xa0é#|") for _ in range(rnd.randrange(80)))
        assert quality.measure(text) == plain_measures(text)
    assert quality.measure(None) == (0, 0, 0, 0, 0)


def test_exact_bound():
    from math import comb

    for k, n, level in ((0, 20, 0.05), (3, 50, 0.01), (10, 400, 0.001), (49, 50, 0.05)):
        p = quality.upper_bound(k, n, level)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - level) < 1e-6
    assert quality.upper_bound(0, 0, 0.05) == 1.0 and quality.upper_bound(5, 5, 0.05) == 1.0
    assert 0.01 < quality.upper_bound(10_000, 1_000_000, 1e-4) < 0.011


def test_cutoffs_keep_good_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "big", 100, 500, int(rng.integers(0, 10)), 0, 0) for i in range(3000)] + [(i, "few", 100, 500, 5, 0, 0) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    cut = quality.fit_cutoffs(frame, F.lit(True), F.col("lang"))
    assert not any(s == "few" for s, _ in cut) and 0.08 < cut["big", "symbols"] < 0.1
    bad = frame.limit(1).withColumn("n_symbols", F.lit(60).cast("long"))
    out = quality.judged(frame.unionByName(bad), cut, F.col("lang"), ["doc_id"]).collect()
    assert sum(not r["kept"] for r in out) == 1


def plain_cutoffs(rows, rate=0.05, level=0.05, steps=64):
    """Cut-offs by (stratum, rule) from (stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), with the exact binomial by its sum."""
    from math import comb

    grid, out = [0.005 * 800 ** (k / (steps - 1)) for k in range(steps)], {}
    for stratum in {r[0] for r in rows}:
        good = [r for r in rows if r[0] == stratum and r[1] >= 50 and 100 * r[5] <= 50 * r[1]]
        for rule, of in {"symbols": lambda r: r[3] / r[1], "repeats": lambda r: r[5] / r[1], "lines": lambda r: r[4] / r[1], "long_words": lambda r: r[2] / r[1] / 100}.items():
            for cut in reversed(grid):
                n, k, p = len(good), sum(of(r) > cut for r in good), rate / 4
                # the bound is within the rate just if so few rejections are unlikely at that rate
                if n == 0 or k >= n or sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > level / 4:
                    break
                out[stratum or "", rule] = cut
    return out


def test_kept_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2400):
        lang, n = rng.choice(["en", "en", "en", None, "de"]), rng.randrange(30, 300)
        rows.append((i, lang, n, n * rng.randrange(3, 9), rng.choice([0, 0, 0, 1, n // 9]), rng.choice([0, 0, 0, n // 20]), rng.choice([0, 0, n // 9, n])))
    frame = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    want = plain_cutoffs([r[1:] for r in rows])
    assert want and quality.fit_cutoffs(frame, F.lit(True), F.col("lang")) == want
    out = {r["doc_id"]: r["kept"] for r in quality.judged(frame, quality.cutoff_table(frame, F.lit(True), F.col("lang")), F.col("lang"), ["doc_id", "n_words"]).collect()}
    for i, lang, n, chars, symbols, lines, again in rows:
        over = {"symbols": symbols / n, "repeats": again / n, "lines": lines / n, "long_words": chars / n / 100}
        assert out[i] == (n >= 50 and 100 * again <= 50 * n and not any(v > want.get((lang or "", rule), 9e9) for rule, v in over.items()))
    # any number of strata
    many = frame.withColumn("lang", (F.col("doc_id") % 700).cast("string"))
    assert quality.judged(many, quality.cutoff_table(many, F.lit(True), F.col("lang")), F.col("lang"), ["doc_id"]).count() == len(rows)


def plain_joint(rows, rate=0.05, level=0.05, steps=64):
    """Cut-offs by (stratum, rule) of the joint chain, from (stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, good, fit)."""
    from math import comb

    grid, out = [0.005 * 800 ** (k / (steps - 1)) for k in range(steps)] + [float("inf")], {}
    values = lambda r: {"symbols": r[3] / r[1], "repeats": r[5] / r[1], "lines": r[4] / r[1], "long_words": r[2] / r[1] / 100}
    for stratum in {r[0] for r in rows}:
        part = {(g, f): [values(r) for r in rows if r[0] == stratum and r[6] is g and r[7] is f and r[1] >= 50 and 100 * r[5] <= 50 * r[1]] for g in (True, False) for f in (True, False)}
        fitting, testing = part[True, True], part[True, False]
        if not fitting:
            continue
        least = lambda share: {rule: next(k for k, g in enumerate(grid) if sum(v[rule] > g for v in fitting) <= share * len(fitting)) for rule in values([0, 1, 0, 0, 0, 0])}
        chain = [{rule: min(steps, k + m) for rule, k in least(0).items()} for m in (8, 4, 0)] + [least(x) for x in (1 / 400, 1 / 200, 1 / 100, 1 / 50, 1 / 25)]
        lost = lambda docs, cut: sum(any(v[rule] > grid[k] for rule, k in cut.items()) for v in docs)
        best = None
        for cut in chain:
            n, k = len(testing), lost(testing, cut)
            if n == 0 or k >= n or sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)) > level:
                break
            gain = lost(part[False, True], cut) - lost(fitting, cut)
            if best is None or gain > best[0]:
                best = (gain, cut)
        if best:
            out |= {(stratum or "", rule): grid[k] for rule, k in best[1].items() if k < steps}
    return out


def test_joint_cutoffs_equal_brute_force(spark):
    rng, rows = random.Random(8), []
    for i in range(3000):
        lang, n, good = rng.choice(["en", "en", "en", None, "de", "sv" if i % 40 == 0 else "de"]), rng.randrange(30, 300), rng.choice([True, True, False, None])
        bad = good is False and rng.random() < 0.8
        noisy = rng.random() < (0.012 if lang == "en" else 0.0)
        rows.append((i, lang, n, n * rng.randrange(3, 9), rng.choice([n // 3, n // 2]) if bad or noisy else rng.choice([0, 0, n // 30]), rng.choice([0, 0, 0, n // 20]), rng.choice([0, 0, n // 9, n]), good, rng.random() < 0.5))
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, good boolean, fit boolean"
    frame, want = spark.createDataFrame(rows, schema), plain_joint([r[1:] for r in rows])
    run = lambda frame: {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.joint_cutoffs(frame, F.col("good"), F.col("fit"), F.col("lang")).collect()}
    assert len({s for s, _ in want}) == 3 and run(frame) == want  # too few rows of "sv": none
    out = quality.judged(frame, quality.joint_cutoffs(frame, F.col("good"), F.col("fit"), F.col("lang")), F.col("lang"), ["lang", "good"]).filter("NOT base_failed").groupBy("good").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["good"]: r["kept"] for r in out}
    assert kept[True] > 0.95 and kept[False] < 0.35
    # repeated rows count again; without labels, or in one part alone, there is nothing to cut
    assert run(frame.unionByName(frame)) == plain_joint([r[1:] for r in rows + rows])
    assert run(frame.withColumn("good", F.lit(None).cast("boolean"))) == run(frame.withColumn("fit", F.lit(True))) == run(frame.withColumn("fit", F.lit(None).cast("boolean"))) == run(frame.limit(0)) == {}
    assert quality.joint_cutoffs(frame.withColumn("lang", (F.col("doc_id") % 300).cast("string")), F.col("good"), F.col("fit"), F.col("lang")).count() == 0


def test_rejection_rate_is_kept(spark):
    """Strata of one distribution, whose good rows are noisy at a rate above the allowed one: hardly any stratum gets a cut-off that rejects them."""
    rng, rows = random.Random(3), []
    for s in range(60):
        for i in range(300):
            noisy = i % 3 and rng.random() < 0.07
            rows.append((f"s{s}", 100, 500, 40 if noisy or not i % 3 else 0, 0, 0, bool(i % 3), rng.random() < 0.5))
    frame = spark.createDataFrame(rows, "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, good boolean, fit boolean")
    cut = quality.joint_cutoffs(frame, F.col("good"), F.col("fit"), F.col("lang")).filter("rule = 'symbols' AND cutoff < 0.4").count()
    assert cut <= 8  # 3 of 60 at the bound


def test_quality_query(spark, edge):
    out = {r["doc_id"]: r for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(out) == set(docs)
    for i, r in out.items():
        want = plain_measures(docs[i]["text"])
        assert tuple(r[m] for m in quality.MEASURES) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    made = quality.judged(quality.measured(edge.drop("n_words"), ["doc_id", "lang"]), {}, F.col("lang"), ["doc_id"])
    assert made.count() == len(EDGE) and quality.measured(edge.limit(0), ["doc_id"]).count() == 0


def plain_print(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = regex.findall(WORD, low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest id reachable, from all pairs of fingerprints."""
    prints = sorted({p for _, p in rows})
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(b)] = root(a)
    least = {}
    for i, p in rows:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return sorted((-1 if i is None else i, least.get(root(p))) for i, p in rows)


def test_simhash_query(spark, docs):
    rows = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    out = QUERIES["op3_simhash_dedup"](spark, SF).collect()
    assert sorted((r["doc_id"], r["fingerprint"]) for r in out) == sorted((i, f"{p:016x}") for i, p in rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == plain_components(rows)


def test_simhash_edge_cases(edge):
    rows = [(i, plain_print(t)) for i, t, _ in EDGE]
    out = simhash.near_duplicates(edge, ["doc_id", "score"]).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["__component"]) for r in out) == plain_components(rows)
    assert simhash.near_duplicates(edge.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("slice_rows,group_rows", [(8, 4), (40, 1000), (4096, 1024)])
def test_links_lose_nothing(spark, slice_rows, group_rows):
    rnd = random.Random(slice_rows)
    base = [rnd.getrandbits(64) for _ in range(30)]
    near = set(base)
    for b in base:
        x = b
        for _ in range(12):  # chains and clouds
            x ^= sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 4)))
            near |= {x, b ^ (1 << rnd.randrange(64)), x & (2**64 - 1)}
    prints = sorted(near)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "__fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_pairs(frame, 3, slice_rows, group_rows)).collect()}
    unsigned = lambda x: x & (2**64 - 1)
    got = {}
    for p in prints:
        signed = p - (1 << 64) if p >> 63 else p
        got.setdefault(roots.get(signed, signed), set()).add(p)
    want = {}
    for (_, c), p in zip(sorted(plain_components([(i, p) for i, p in enumerate(prints)]) , key=lambda x: x[0]), prints):
        want.setdefault(c, set()).add(p)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()} and unsigned(-1) == 2**64 - 1


def test_bands_share_a_value():
    """Whatever the number of fingerprints, two within the radius agree on the bits of some band."""
    rnd = random.Random(3)
    for n in (0, 10, 10**6, 10**8, 10**10, 10**12):
        cut, taken = simhash.bands(n, 3, 1024)
        assert min(sum(b - a for a, b in ranges) for ranges in cut) >= taken >= min(28, round(np.log2(max(1, n / 1024)))) and len(cut) <= 56
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a ^ sum(1 << k for k in rnd.sample(range(64), 3))
            assert any(all((a ^ b) >> low & ((1 << (high - low)) - 1) == 0 for low, high in ranges) for ranges in cut)


def test_links_with_many_blocks(spark, monkeypatch):
    """The bands of a huge table lose no link of a small one."""
    rnd = random.Random(4)
    prints = sorted({x ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(4))) for x in [rnd.getrandbits(64) for _ in range(60)] for _ in range(5)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "__fp long")
    real = simhash.bands
    monkeypatch.setattr(simhash, "bands", lambda n, radius, rows: real(10**10, radius, rows))
    roots = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.components(simhash.near_pairs(frame)).collect()}
    got = {}
    for i, p in enumerate(prints):
        got.setdefault(roots.get(p, p), set()).add(i)
    want = {}
    for i, c in plain_components(list(enumerate(prints))):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(prints)


def test_contamination_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        path = f"{SF}/{name}.parquet" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}.parquet") else "")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cursor = con.execute(ORACLE_SQL["op4_decontamination"])
    columns = [d[0] for d in cursor.description]
    want = sorted(repr(r) for r in cursor.fetchall())
    assert want == sorted(repr(tuple(r)) for r in QUERIES["op4_decontamination"](spark, SF).select(*columns).collect())


def test_contamination_edge_cases(spark, edge):
    items = spark.createDataFrame([(1, "sat on the mat"), (2, None), (3, " ... "), (4, " ".join(f"w{i}" for i in range(20))), (4, "Chat NOIR")], "item_id long, text string")
    text = "x " + " ".join(f"W{i}!" for i in range(2, 17)) + " le chat noir"
    rows = edge.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(99, text, 5)], "doc_id long, text string, n_words int"))
    out = {r["doc_id"]: r for r in contamination.decontaminate(rows, items, ["doc_id"], spans=True).collect()}
    assert out[99]["n_hit"] == 17 and out[99]["__items"] == ["4"] and out[99]["contaminated"]
    assert [text[s["start"] : s["end"]] for s in out[99]["__spans"]] == ["W2! " + " ".join(f"W{i}!" for i in range(3, 16)) + " W16", "chat noir"]
    assert out[1]["n_hit"] == 80 and out[3]["n_words"] == out[2]["n_words"] == 0 and not out[3]["contaminated"]
    again = contamination.decontaminate(rows, items, ["doc_id"], spans=True, most_bytes=10).collect()  # many passes
    key = lambda r: (r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["__items"]), r["contaminated"], str(r["__spans"]))
    assert sorted(map(key, again)) == sorted(map(key, contamination.decontaminate(rows, items, ["doc_id"], spans=True).collect()))
    assert contamination.decontaminate(rows, items.limit(0), ["doc_id"]).filter("contaminated OR n_hit > 0").count() == 0
    assert contamination.decontaminate(rows.limit(0), items, ["doc_id"]).count() == 0


def test_items_are_held_part_by_part(spark, monkeypatch):
    items = spark.createDataFrame([(f"i{k}", f"é{k} b{k} c{k}") for k in range(6)], "item_id string, text string")
    assert [len(p) for p in contamination.item_shards(items, "item_id", "text", 20)] == [2, 2, 2]  # nine characters, ten bytes an item
    fetched, events, shards, one_pass = [0], [], contamination.item_shards, contamination._pass

    def counted(*args):
        for part in shards(*args):
            fetched[0] += 1
            yield part

    monkeypatch.setattr(contamination, "item_shards", counted)
    monkeypatch.setattr(contamination, "_pass", lambda *args: events.append(fetched[0]) or one_pass(*args))
    docs = spark.createDataFrame([(k, f"x é{k} b{k} c{k} y") for k in range(6)], "doc_id long, text string")
    found = contamination.decontaminate(docs, items, ["doc_id"], most_bytes=20, size=3).collect()
    assert events == [2, 3, 3] and {r["doc_id"]: r["__items"] for r in found} == {k: [f"i{k}"] for k in range(6)}
