"""Language ID, spelling variants and the prefix trie against brute force, with nulls, ties, repeats and hot groups."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import language_id, prefix_trie, queries, spelling

from ..common import normal
from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
G = np.random.default_rng(11)


def fold(text):
    """What language ID codes of a text, told again letter by letter."""
    out = ""
    for c in text:
        if "À" <= c <= "Þ" and c != "×":
            c = c.lower()
        c = c if ord(c) > 127 else c.lower() if c.isalpha() else " "
        if not (c == " " and (not out or out[-1] == " ")):
            out += c
    return out.encode()


def brute_bits(tree, order, data):
    """Code length by the definition: escapes with exclusion, no tables."""

    def p(context, byte):
        if context is None:
            return 1 / 256
        shorter = None if not context else context[1:]
        seen = tree.get(context)
        if not seen:
            return p(shorter, byte)
        n, q = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + q)
        return q / (n + q) * p(shorter, byte) / (1 - sum(p(shorter, b) for b in seen))

    padded = b"\0" * order + data
    return -sum(math.log2(p(padded[i : i + order], padded[i + order])) for i in range(len(data)))


def brute_trees(rows, order):
    trees = defaultdict(lambda: defaultdict(Counter))
    for text, lang in rows:
        padded = b"\0" * order + fold(text)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                trees[lang][padded[i - k : i]][padded[i]] += 1
    return trees


@pytest.fixture(scope="module")
def spoken(spark):
    tongue = {"aa": ["the", "ship", "sails", "on"], "bb": ["das", "schöne", "Übel", "kam"], "cc": ["où", "était", "le", "chat"]}
    rows = [(i, " ".join(G.choice(words, int(G.integers(1, 30)))), lang) for i, lang in enumerate(sorted(tongue) * 20) for words in [tongue[lang]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 -- !", "cc"), (903, "ship", None), (None, "le chat", "cc"), (904, "漢字", "aa"), (905, "ÜBEL" * 300, "bb"), (3, "the ship", "aa"), (3, "the ship", "aa")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, bits int").repartition(5)


def test_code_lengths_are_exact(spoken):
    rows, df = spoken
    learned = [(t, lang) for i, t, lang in rows if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    trees = brute_trees(learned, 3)
    got = Counter()
    for r in language_id.identify(df).collect():
        got[r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9), round(r["bits"], 6)] += 1
    want = Counter()
    for i, t, _ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if t is None or not any(c.isalpha() for c in t):
            want[i, held, "und", 0.0, 0.0] += 1
            continue
        bits = {lang: brute_bits(tree, 3, fold(t)) for lang, tree in trees.items()}
        best = min(bits, key=lambda x: (bits[x], x))
        want[i, held, best, round(1 / sum(2.0 ** (bits[best] - b) for b in bits.values()), 9), round(bits[best], 6)] += 1
    assert got == want


@pytest.mark.parametrize("most", [10**6, 40])
def test_probabilities_of_a_context_add_up(spoken, most):
    trees = language_id.fit(spoken[1], order=2, most_nodes=most)
    assert sum(len(level[0]) for tree in trees.levels for level in tree) <= most
    for context in (b"\0\0", b"th", b"zz", b" s", "ü".encode()):
        gram = np.array([(context[0] << 16) | (context[1] << 8) | b for b in range(256)], np.uint64)
        for i in range(len(trees.langs)):
            assert abs((2.0 ** -trees.bits(i, gram)).sum() - 1) < 1e-9


def test_folded_and_distinct():
    texts = ["Ab  c!d", "", None, "ÀÞ×ß É", "  x", "\U0001f600 É"]
    data, bounds = language_id.folded(pa.array(texts, pa.string()))
    assert [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:])] == [fold(t or "") for t in texts]
    for order in (3, 4):
        for _, found in language_id.grams(data, bounds, order):
            kinds, which = language_id.distinct(found)
            assert (kinds[which] == found).all() and (np.diff(kinds.astype(np.int64)) > 0).all()


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97


def test_language_without_anything_to_learn(spark, spoken):
    none = spoken[1].where("false")
    assert language_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(spoken[1].withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_variants(rows, least_length=5, least_n=3):
    n = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    known = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_n}
    near, holes = defaultdict(set), defaultdict(set)
    for w in known:
        for k in range(len(w)):
            if (x := w[:k] + w[k + 1 :]) in known:
                near[w].add(x)
                near[x].add(w)
            holes[k, w[:k], w[k + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in known:
        if near[w] and known[b := min(near[w], key=lambda x: (-known[x], x))] >= 2 * known[w]:
            form[w] = b

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(near[w]), known.get(form.get(w))) for w, c in known.items()}


@pytest.fixture(scope="module")
def misspelt(spark):
    base = ["harbour", "straße", "éclair", "aaaaa", "x" * 3000, "BANANA", "Ünder"]
    texts = []
    for w in base:
        texts += [w] * 40 + [w[:2] + w[3:]] * 9 + [w[:3] + "z" + w[3:]] * 4 + [w[:1] + "q" + w[2:]] * 4 + [w[:1] + "q" + w[2:] + "ÿ"] * 3
    texts += ["harbour"] * 300 + ["tiedx"] * 3 + ["tiedy"] * 6 + ["tiedz"] * 6 + ["bo dy ab"] * 5
    rows = [(i, f"{t}, {t}!") for i, t in enumerate(texts)] + [(None, "harbour harbour"), (5000, None), (5001, ""), (5002, "1 2 3"), (7, "banana"), (7, "banana")]
    rows += [(6000 + i, " ".join(["harbour", "eclair", "banana"] * 50)) for i in range(97)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(4)


@pytest.mark.parametrize("most_bytes", [spelling.MOST_BYTES, 64])
def test_spelling(misspelt, most_bytes):
    rows, df = misspelt
    got = [tuple(r) for r in spelling.variants(df, most_bytes=most_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_spelling_on_nothing(misspelt):
    assert spelling.variants(misspelt[1].where("false")).count() == 0
    assert spelling.variants(misspelt[1].where("doc_id = 5002")).count() == 0


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5"), ("b", "w5")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(chain).collect()} == {(w, "w37") for w in [*(f"w{i}" for i in range(37)), "a", "b"]}


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        v = own.get(c - c % 20, [])[:h] + v[h:]
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    total = {}
    for k in sorted(members, key=len, reverse=True):
        below = [total[x] for x in kids[k]]
        saved = (len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        total[k] = (sum(x[0] for x in below) + (not below), saved + sum(x[1] for x in below))
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *total[k], digest(k)) for k, m in members.items()}


def test_trie(spark):
    rows = [(c, t, "user" if t % 2 else "bot", f"say {G.integers(0, 3)}" + " more" * int(G.integers(0, 3))) for c in range(0, 300, 3) for t in range(int(G.integers(1, 7)))]
    rows += [(1000, t, "a", f"w {t % 5}") for t in range(400)] + [(1001, t, "a", f"w {t % 5}") for t in range(390)]  # long chains
    rows += [(c, t, "hot", "the same") for c in range(2000, 3700) for t in range(2)]  # ends of one node in several parts
    rows += [(4, None, None, None), (4, None, "u", None), (4, 0, "u", ""), (4, 0, "u", ""), (4, 0, "b", "x"), (None, 0, "u", "lost"), (7, 5, "u", "only"), (43, 1, "u", "no head of its family")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, a string").repartition(6)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0


def test_contraction_of_chains_stars_and_forests(spark):
    parent = {i: i - 1 if i % 50 else None for i in range(200)} | {1000 + i: 7 for i in range(300)} | {2000 + i: int(G.integers(0, 200)) for i in range(300)} | {5000: None}
    tree = spark.createDataFrame([(i, p, i % 7, 1) for i, p in parent.items()], "id long, parent long, x long, n long")
    want = {i: [i % 7, 1] for i in parent}
    for i in parent:
        up = parent[i]
        while up is not None:
            want[up][0] += i % 7
            want[up][1] += 1
            up = parent[up]
    got = prefix_trie.subtree_totals(tree, ["x", "n"]).collect()
    assert len(got) == len(parent) and {r["id"]: [r["x"], r["n"]] for r in got} == want


def test_running_totals_of_a_key_in_many_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4500, 1).otherwise(F.col("id") % 7 + 2).alias("k"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.along(rows, "k", [F.col("i")], n=(F.lit(1), "sum"), x=(F.col("i"), "bit_xor")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = defaultdict(lambda: [0, 0])
    for r in sorted(got, key=lambda r: (r["k"], r["i"])):
        seen[r["k"]][0] += 1
        seen[r["k"]][1] ^= r["i"]
        assert [r["n"], r["x"]] == seen[r["k"]]
    assert len(got) == 5000


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_prefix_trie"])
def test_twin(spark, duck, name):
    assert normal(queries.queries()[name](spark, SF).toPandas()).equals(normal(duck.sql(queries.oracle_sql()[name]).df()))
