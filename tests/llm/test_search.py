"""Ranked search, toxicity and conversation repair, against brute force and on held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter
from functools import cache
from itertools import product

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from screenlab.llm import conversations, lexical, toxicity
from screenlab.llm.queries import QUERIES

from .conftest import EDGE, SF

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_search(docs, items, k):
    held = [(i, Counter(regex.findall(TERM, (t or "").translate(FOLD)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    rows, terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        own = set(regex.findall(TERM, (text or "").translate(FOLD)))
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * rows) // terms
            s = sum(math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own & c.keys())
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, score int, item_id string")
    items = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical.ranked_search(docs, items, **options).collect()), key=str)


def random_texts(seed, n):
    """Texts over words of very unlike frequency, many of them alike."""
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.5)) % 400}" for _ in range(5000)]
    texts = [" ".join(draw.choices(words, k=draw.choice([1, 3, 30, 200]))) for _ in range(n)]
    return [(i, draw.choice([texts[i], texts[i], texts[i // 2], None, ""]) if i % 5 == 0 else texts[i]) for i in range(n)]


def test_search_equals_brute_force(spark):
    docs = random_texts(3, 300)
    items = [(i, " ".join(t.split()[:12])) for i, t in random_texts(4, 25) if t]
    for k in (1, 7, 50):
        assert found(spark, docs, items, k=k) == plain_search(docs, items, k)
    assert found(spark, docs, items, k=7, most_bytes=60) == plain_search(docs, items, 7)  # many parts of the items


def test_search_odd_cases(spark, edge):
    """Nulls, empty texts, repeated rows and items, ties, marks and letters of all widths, ids that are null."""
    docs = [(i, t) for i, t, _ in EDGE]
    items = [(1, "the CAT sat"), (1, "the CAT sat"), (2, None), (3, ""), (None, "日本語のテキスト word"), (4, "?!"), (5, "x\x85y b　c zzz"), (6, "words no id")]
    assert found(spark, docs, items) == plain_search(docs, items, 50)
    assert found(spark, [(7, "a b")] * 60 + [(6, "a b"), (None, "a b"), (1, "c")], [(1, "a")], k=50) == plain_search([(7, "a b")] * 60 + [(6, "a b"), (None, "a b"), (1, "c")], [(1, "a")], 50)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
    named = edge.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("term"))
    got = lexical.ranked_search(named, spark.createDataFrame([("q", "cat")], "item_id string, text string")).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [("q", 1, "1"), ("q", 2, "11")]


def test_blocks_of_postings_change_nothing(spark):
    docs = random_texts(9, 120)
    assert Counter(t for text in (t for _, t in docs) for part in lexical.term_blocks(text, 7) for t in part) == Counter(t for text in (t for _, t in docs) for t in (text or "").encode().split())
    items = lexical.Items([(0, "w1 w2 w5 w77")])
    index = lexical.forward_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.sparkContext.broadcast(items.number))
    batch = index.toArrow().combine_chunks().to_batches()[0]
    cut = list(lexical._blocks([batch], rows=9, postings=5))
    assert sum(b.num_rows for b in cut) == batch.num_rows and max(b.num_rows for b in cut) <= 9
    assert sum(b.column(2).flatten().to_pylist().count(0) for b in cut) == batch.column(2).flatten().to_pylist().count(0)


# -- toxicity --


def test_toxicity_held_out(spark):
    """Labels that were not learned from: most toxic rows are found, hardly any clean one is taken for toxic."""
    sf = SF.replace("0.001", "0.1")
    out = QUERIES["op12_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in out) == len(held) > 900
    toxic, clean = [[r["predicted"] for r in held if r["toxic"] == y] for y in (1, 0)]
    assert sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_toxicity_learns_no_held_out_label(spark):
    docs = spark.createDataFrame([(i, "fine words here " + ("vile" if i % 2 else "good")) for i in range(40)], "doc_id long, text string").withColumn("held_out", toxicity.is_held_out())
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs.filter("NOT held_out"), labels.filter(~toxicity.is_held_out()), 12, 1000, 2)
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    few = toxicity.training_rows(docs, labels.unionByName(labels), 12, 10, 2).count()
    assert 1 <= few <= 20
    weights = toxicity.fit(docs, labels, bits=12, l1=0.1)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, weights, ["doc_id"]).collect()}
    assert got == {i: i % 2 for i in range(40)}


def plain_features(text, bits):
    """One word, beginning, pair and triple after the other."""
    top = (1 << 64) - 1
    mix = [int(x) for x in toxicity._MIX]
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()

    def poly(word):
        return sum((ord(c) + 1) * pow(toxicity._BASE, i, 1 << 64) for i, c in enumerate(word)) & top

    def end(h):
        h = ((h ^ (h >> 29)) * mix[1]) & top
        return h >> (64 - bits)

    h = [poly(w) for w in words]
    out = {end(x * mix[0] & top) for x in h}
    out |= {end((poly(w[:n]) + n) * mix[5] & top) for w in words for n in toxicity.PREFIXES if len(w) > n}
    for gap in (1, 2, 3):
        out |= {end(((a ^ (b * mix[gap] & top)) * mix[0]) & top) for a, b in zip(h, h[gap:])}
    out |= {end((((((a ^ (b * mix[1] & top)) * mix[4]) & top) ^ c) * mix[0]) & top) for a, b, c in zip(h, h[1:], h[2:])}
    return sorted(out)


def test_toxicity_features():
    for text in ("", "a", "Ab cd, EF-gh naïve Straße", "日本 x1 y_z ok " * 7, " \n "):
        assert toxicity.features(text, 20).tolist() == plain_features(text, 20)
        for block in (1, 3, 10, 1000):
            parts = [p for p in toxicity.feature_blocks(text, 20, block)]
            if block > 40 or not text.strip():
                assert sorted(set(np.concatenate(parts).tolist()) if parts else set()) == plain_features(text, 20)
    for bits in (10, 16, 20):
        for found in (np.zeros(0, np.int32), np.arange(0, 1 << bits, 97, dtype=np.int32), np.array([(1 << bits) - 1], np.int32)):
            assert (toxicity.unpacked(toxicity.packed(found, bits), bits) == found).all()
    text = " ".join(f"word{i % 37}" for i in range(4000))
    assert set(np.concatenate(list(toxicity.feature_blocks(text, 20, 100))).tolist()) == set(plain_features(text, 20))


def test_ftrl_equals_plain_loop():
    """The state after each example equals one worked out coordinate by coordinate."""
    draw, bits = random.Random(2), 5
    model = toxicity.Ftrl(bits, 0.5, 1.0, 0.3, 0.1)
    z, n = [0.0] * 33, [0.0] * 33
    for _ in range(60):
        at, y = sorted(draw.sample(range(32), 6)), draw.randrange(2)
        full = [*at, 32]
        w = [0.0 if abs(z[i]) <= (0.3 if i < 32 else 0) else (math.copysign(0.3 if i < 32 else 0, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 0.5 + 0.1) for i in full]
        g = 1 / (1 + math.exp(-sum(w))) - y
        for i, x in zip(full, w):
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * x
            n[i] += g * g
        model.learn(np.array(at), y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and (model.weights()[:-1] == 0).any()


def test_toxicity_odd_cases(spark, edge):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, 0), (9, None), (None, 1), (10, 0), (11, 1), (7, 0), (99, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(edge, labels, bits=14, l1=0.0, rounds=2)
    out = toxicity.score(edge, weights, ["doc_id", "score", "n_words"]).collect()
    assert len(out) == len(EDGE) and out[0].asDict().keys() == {"doc_id", "n_words", "score", "predicted"}
    assert len({r["score"] for r in out if r["doc_id"] in (2, 3, 4)}) == 1 and len({r["score"] for r in out if r["doc_id"] == 7}) == 1
    assert {r["doc_id"]: r["predicted"] for r in out}[11] == 1
    none = toxicity.fit(edge, labels.limit(0), bits=10)
    assert {(r["score"], r["predicted"]) for r in toxicity.score(edge, none, ["doc_id"]).collect()} == {(0.0, 0)}
    assert toxicity.score(edge.limit(0), weights, ["doc_id"]).count() == 0 and toxicity.fit(edge.limit(0), labels, bits=10).bias is None
    # repeated ids: one row each is learned from, whatever stands in how many copies
    many = edge.filter("doc_id = 7").unionByName(edge.filter("doc_id = 7").withColumn("text", F.lit("other words")))
    assert toxicity.training_rows(many, labels, 10, 100, 4).count() == 1


# -- conversations --


def plain_repair(symbols):
    """Least cost and ASCII-least edits by trying all edits from every place and state."""

    @cache
    def best(i, q, put):
        out = [(0, "")] if i == len(symbols) and q in conversations.ENDS else []
        if put < 3:
            for role in "ua":
                if (q, role) in conversations.STEP and (b := best(i, conversations.STEP[q, role], put + 1)):
                    out.append((b[0] + 3, "I" + b[1]))
        if i < len(symbols):
            for edit, cost, to in conversations.Automaton._edits(symbols[i], q):
                if b := best(i + 1, to, 0):
                    out.append((b[0] + cost, edit + b[1]))
        return min(out) if out else None

    return best(0, 0, 0)


def test_automaton_equals_trying_all():
    automaton, draw = conversations.Automaton(), random.Random(5)
    for n in range(4):
        for symbols in product(range(9), repeat=n):
            assert automaton.repair(bytes(symbols)) == plain_repair(symbols)
    for _ in range(500):
        symbols = bytes(draw.randrange(9) for _ in range(draw.randrange(4, 40)))
        assert automaton.repair(symbols) == plain_repair(tuple(symbols))
    assert len(automaton.vectors) < 60  # cost vectors stay few, so the table does


SPACE = " \t\n\x0b\x0c\r"


def plain_report(rows):
    """Reports of conversations, from rows (conv_id, turn, role, text) after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, blank, duplicate, truncated, symbols = set(), 0, 0, 0, []
        for _, role, text in own:
            end = text.rstrip(SPACE)
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, duplicate, truncated = blank + (fault == "b"), duplicate + (fault == "d"), truncated + (fault == "t")
            symbols.append(0 if fault in ("b", "d") else conversations.Automaton.symbol(role[:1], fault == "t"))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = plain_repair(tuple(symbols))
        lines, rest, last = [], iter(own), "a"
        for edit in audit:
            row = next(rest) if edit != "I" else (None, "", "")
            if edit == "D":
                continue
            last = row[1][:1] if edit == "K" else "a" if last == "u" else "u"
            lines.append((row[1] if edit == "K" else {"u": "user", "a": "assistant"}[last]) + ":" + row[2])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


@pytest.fixture(scope="module")
def talks(spark):
    """Conversations with nulls everywhere, repeats, equal turns, odd roles and one very long text."""
    draw = random.Random(8)
    texts = ["Yes.", "No?", "and then", "", " \t", None, "Yes.", "naïve 日本。", "ok! \n", "." * 3, "long " * 30_000]
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "User"]
    rows = [(draw.choice([None, *range(25)]), draw.choice([None, 1, 2, 3, 5, -4, 7]), draw.choice(roles), draw.choice(texts)) for _ in range(200)]
    rows += rows[:20] + [(77, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(150)] + [(78, None, "user", "same.")] * 40
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")


def test_repair_equals_brute_force(spark, talks):
    rows, frame = talks
    want = plain_report(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_report(frame).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    lines: dict = {}
    for r in sorted(conversations.repaired_rows(frame).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        lines.setdefault(r["conv_id"], []).append(r["role"] + ":" + r["text"])
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}


def test_damage_and_empty_conversations(spark, talks):
    rows, frame = talks
    left = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code:
            x = "" if code == 1 else x.translate({ord(m): None for m in ".!?"}) if code == 2 else x
            left += [(c, t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    damaged = conversations.damaged(frame)
    assert sorted(map(str, map(tuple, damaged.collect()))) == sorted(map(str, left))
    every = spark.createDataFrame([(1000, None, None, None)], "conv_id long, turn long, role string, text string").unionByName(frame.select("conv_id", "turn", "role", "text"))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_report(damaged, every).collect()}
    want = {c: w[:-1] for c, w in plain_report(left).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, nothing) for c in {1000, *(r[0] for r in rows)}}
    assert conversations.repair_report(frame.limit(0)).count() == 0 and conversations.repaired_rows(frame.limit(0)).count() == 0
