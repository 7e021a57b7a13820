"""Each operator against a brute-force version on small tables with nulls, ties, repeats, clashing names and empty input."""

import hashlib
import re
import time
import timeit
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import ann, chat_format, html_extract, line_dedup, lm_score, minhash, packing, quality_rules, sentencepiece_lattice, substring
from tidemark.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
G = np.random.default_rng(5)
POOL = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(G.choice(POOL, n))


@pytest.fixture(scope="module")
def texts():
    base, shared = [prose(80) for _ in range(12)], prose(60)
    out = [*base, None, "", " \n\t ", "Hi", "one two three", "One TWO three", "a " * 300, "x" * 5000, "é 漢字 <s> ▁ \t tab"]
    out += [base[0], base[0], base[1].replace("w1", "W1"), base[2] + " tail words here", " ".join(base[3].split()[:70]), base[4] + "\n" + shared, shared + " " + base[5]]
    out += ["\n".join(f"line {i % 7} of text" for i in range(30)), "\n".join(f"line {i % 7} of text" for i in range(3)) + "\n\nend"]
    for _ in range(10):
        w = base[6].split()
        w[int(G.integers(0, 80))] = prose(1)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "n", "x") for i, t in enumerate(texts)], "doc_id long, text string, node string, n_words string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def brute_lines(rows):
    """Texts without the lines of later three-line windows, by id, for (id, text) in the order of ids."""
    seen, want = set(), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        solid = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for a in range(len(solid) - 2):
            key = tuple(lines[solid[a + j]] for j in range(3))
            if key in seen:
                gone.update(solid[a : a + 3])
            seen.add(key)
        want[i] = t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return want


def test_line_dedup(docs, texts, empty):
    clash = docs.withColumns({"_gone": F.lit("g"), "Key": F.lit(1), "_n_lines": F.lit("old")})
    out = line_dedup.drop_repeated_lines(clash).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute_lines(enumerate(texts))
    assert all(r["_gone"] == "g" and r["Key"] == 1 for r in out)
    assert {r["doc_id"]: r["_n_lines"] for r in out} == {i: 0 if t is None else t.count("\n") + 1 for i, t in enumerate(texts)}
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_dedup_of_long_texts(spark):
    text = "\n".join(f"line {i} of many" for i in range(60_000))
    rows = spark.createDataFrame([(0, text), (1, text), (2, text + "\n\nend")], "doc_id long, text string")
    began = time.time()
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(rows).collect()} == {0: text, 1: "", 2: "\nend"}
    assert time.time() - began < 30


def test_html(spark):
    page = '<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>First, long  text\nwith words, and more of them.<p>Second <b>bold</b>, also long enough here.<form>x</form></article><div id="comments"><p>Nice, very nice, truly, yes.</p></div><script>var a="</p>"</script><footer>f</footer>'
    rows = spark.createDataFrame([(1, page, "old"), (2, None, None), (3, "", ""), (4, "plain words", "")], "page_id long, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(rows).collect()}
    text = "T & U\n\nFirst, long text with words, and more of them.\n\nSecond bold, also long enough here."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("plain words", 11)}


LONG = "A sentence of the article, with commas, that goes on for quite a while, and says something of note. " * 3
BODY = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
SAID = "\n\n".join(["Title", LONG.strip(), LONG.strip()])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<body><form id="aspnetForm"><nav><a href=x>m</a></nav><article>{BODY}</article><div class=footer>f</div></form>', SAID),
        (f'<body><div class="page-header-area"><div>{BODY}</div></div><div class=comments><p>{LONG * 3}</p></div>', SAID),
        (f'<body><header><p>Site</p></header><div>{BODY}</div><div class="comments"><p>{LONG * 30}</p></div>', SAID),
        (f'<div class="text">{BODY}</div><div class="text"><p>The end.</p></div><div class="sidebar"><p>{LONG}</p></div>', SAID + "\n\nThe end."),
        (f'<div>{BODY}<p title="x>{LONG}</p></div>', SAID + "\n\n" + LONG.strip()),
        (f"<div><p><![CDATA[Plain & <text>, {LONG}]]></p>{BODY}</div>", f"Plain & <text>, {LONG.strip()}\n\n" + SAID),
        (f"<div>{BODY}<p>{LONG}&<b>amp;</b> &amp;lt; &eacute;</p></div>", SAID + "\n\n" + LONG + "&amp; &lt; é"),
        ("<p></p>", ""),
        ("<div hidden><p>" + LONG + "</p></div>", ""),
    ],
)
def test_html_frames_quotes_and_references(html, text):
    assert html_extract.main_text(html) == text


SHORT = [f"Line {i} of it." for i in range(40)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<div>{BODY}<p>He cited the <span class="legal">Act of 1901</span> and <a class="share-link">the ledger</a> too.</p></div>', SAID + "\n\nHe cited the Act of 1901 and the ledger too."),
        (f'<div>{BODY}<p>A <em class="search">needle</em>, of course, in the hay that they had.</p></div>', SAID + "\n\nA needle, of course, in the hay that they had."),
        (f'<div>{BODY}<p class="hidden-gem">{LONG}</p><p class="notice">Sale, sale, sale.</p></div>', SAID + "\n\n" + LONG.strip()),
        ("<form>" + "".join(f"<p>{x}</p>" for x in SHORT) + "</form>", "\n\n".join(SHORT)),
        ('<div class="ad"><p>Buy, buy, and buy again.</p></div><nav><form><p>Find</p></form></nav>', ""),
        (f'<div>{BODY}</div><ol class="commentlist"><li>Nice, very nice, truly, {LONG}</li></ol>', SAID),
        (f'<div>{BODY}</div><section id="discussion"><h2>3 responses</h2><p>I agree, {LONG}</p></section>', SAID),
        (f'<div>{BODY}<div class="adsbygoogle"><p>Cheap, cheaper, {LONG}</p></div></div>', SAID),
    ],
)
def test_html_keeps_the_article_and_nothing_else(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("bit", ["<b>x</i>", "<b><p>y", "<b><h1>t</h1>", "<svg>z", "<td><i>a</b>", "<ul><b><li>k", '<a href="q>w', "<form><div>v"])
def test_html_time_grows_with_the_page(bit):
    def seconds(n):
        page = f"<article>{BODY}</article>" + bit.partition(">")[0] + ">" + bit * n + "</u>" * n
        return min(timeit.repeat(lambda: html_extract.main_text(page), number=1, repeat=2))

    assert seconds(40_000) < 12 * seconds(8_000) + 2


def test_html_empty_table_and_repeats(spark):
    rows = spark.createDataFrame([(1, "<p>Some words.</p>"), (1, "<p>Some words.</p>")], "page_id long, html string")
    assert [r["text"] for r in html_extract.extract(rows).collect()] == ["Some words."] * 2
    assert html_extract.extract(rows.where("false")).count() == 0


def test_nearest_of_extreme_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [0.0, 3e-310])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(df, df.where("vec_id = 0")).collect()}
    assert all(abs(got[0, i] - x) < 1e-12 for i, x in ((1, 0.5**0.5), (2, 1.0), (3, 0.0)))


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "ann", "Hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, 2, None, "<|end|>"), (None, 0, "x", "y"), (2, 300, "ann", "late"), (2, 0, "bob", "soon")], "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["perspective"]): r for r in chat_format.rotate_perspectives(rows).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "ann"), (2, "bob")} and {r["part"] for r in whole.values()} == {0}
    assert whole[2, "ann"]["text"] == "<|user name=bob|>\nsoon<|end|>\n<|assistant|>\nlate<|end|>\n"
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat_format.rotate_perspectives(rows, part_turns=256).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "ann", 0), (2, "ann", 1), (2, "bob", 0), (2, "bob", 1)}
    r = got[(1, "ann", 0)]
    assert r["text"] == "<|assistant|>\nHi<|end|>\n" + "<|user name=bob|>\n<|end|>\n" * 2 + "<|user|>\n< |end|><|end|>\n" and r["n_turns"] == 4
    assert [r["text"][s["start"] : s["stop"]] for s in r["mask"]] == ["Hi<|end|>"]
    assert got[(2, "ann", 0)]["mask"] == []


def test_nearest(spark):
    v = G.standard_normal((400, 16))
    v[50:80] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), block_rows=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    n = np.sqrt((v * v).sum(axis=1))
    hits = total = 0
    for q in range(0, 400, 20):
        s = (v * v[q]).sum(axis=1) / (n * n[q])
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        assert all(abs(s[i] - x) < 1e-9 for i, x in got[q])
        hits, total = hits + len(set(want) & {i for i, _ in got[q]}), total + 5
    assert hits / total >= 0.9
    assert [i for i, _ in got[60]] == [7, 50, 51, 52, 53]
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_sentencepiece(docs, texts, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_lattice.encode(docs, path, frequent=200)
    got = {r["doc_id"]: list(r["ids"]) for r in out.collect()}
    assert got == {i: model.encode(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in sentencepiece_lattice.decode(out, path).collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert sentencepiece_lattice.encode(empty, path).count() == 0


def test_merges_of_many_words():
    """The fold of many words at once against the library, over words of all lengths and scripts."""
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    g = np.random.default_rng(3)
    pieces = [model.id_to_piece(i) for i in g.integers(300, model.get_piece_size(), 3000)]
    words = ["▁" + "".join(g.choice(pieces, int(n))).replace("▁", "") for n in g.integers(1, 6, 1500)] + ["▁", "▁a", "▁" + "ab" * 40, "▁漢字é"]
    got = sentencepiece_lattice._merge_many(words, path)
    want = [model.encode(w[1:]) for w in words]
    same = [g is None or np.frombuffer(g, np.int32).tolist() == w for g, w, t in zip(got, want, words) if len(t) > 1]
    assert all(same) and sum(g is not None for g in got) > 1000
    assert sentencepiece_lattice._merge_many([], path) == [] and got[-2] is None


def test_viterbi_fold(spark):
    table = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -6.0, "bc": -2.2, "c": -1.0, "aa": -1.9}
    pieces = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(table.items())], "piece string, id int, score double")
    ids = {p: i for i, p in enumerate(table)}
    words = ["a", "abc", "aabcab", "bcb", "xa"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    byte_ids = list(range(1000, 1256))
    got = {r["word"]: list(r["ids"]) for r in sentencepiece_lattice.encode_words(df, pieces, "unigram", 3, byte_ids).collect()}

    def ways(w):
        if not w:
            yield 0.0, []
        for k in range(1, min(3, len(w)) + 1):
            if w[:k] in table or k == 1:
                for s, rest in ways(w[k:]):
                    yield s + table.get(w[:k], -1e12), [w[:k], *rest]

    for w in words:
        best = max(ways(w))[0]
        flat = [p for p in got[w]]
        text = b"".join(list(table)[i].encode() if i < 1000 else bytes([i - 1000]) for i in flat).decode()
        assert text == w
        if "x" not in w:
            assert abs(sum(list(table.values())[i] for i in flat) - best) < 1e-9
        assert got[w] == sentencepiece_lattice._path_one(w, table, ids, byte_ids, 3)


def test_word_stats(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.word_stats(docs).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        rep = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert got[i] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", " ".join(w))), len(lines) - len(set(lines)), len(rep)), i


def test_rules_learn(spark):
    good = [(i, prose(40), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(x + "***" for x in prose(40).split()), 0) for i in range(120)] + [(2000 + i, prose(40).upper() + "!!", 0) for i in range(120)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(5, None)], "doc_id long, quality int")
    rules = quality_rules.fit(df, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, rules).collect()}
    assert rules and all(kept[i] for i, _, _ in good) and np.mean([kept[i] for i, _, _ in bad]) < 0.05
    assert quality_rules.fit(df, labels.where("false")) == []


def test_lm_scoring(spark, docs, empty):
    train = [("the cat sat on the mat and ate the fish " * 12).strip() for _ in range(300)]
    odd = " ".join(G.permutation(train[0].split()))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*train, odd])], "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.pseudo_likelihood(df).collect()}
    assert got[0] > got[300] + 0.5
    rows = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(docs).collect()}
    assert rows[12]["n_tokens"] == 0 and rows[12]["mean_log_prob"] is None
    assert lm_score.pseudo_likelihood(empty).count() == 0


def test_lm_words_all_count(spark):
    """Rare words are told apart, scored by their own counts, and every word is trained on once."""
    import pyarrow as pa

    common, seldom = [f"c{i:04d}s" for i in range(1100)], [f"q{i:03d}s" for i in range(60)]
    texts = [" ".join(common)] * 3 + [" ".join(seldom)] * 2 + [" ".join(["zzxqs", "jqvxs"] * 10), "zzxqs"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counted = lm_score.counted_words(df)
    assert counted.count() == 1162
    known, others = lm_score.vocabulary(counted)
    lp = {r["h"]: (r["n"], r["lp"]) for r in others.collect()}
    assert len(lp) == 1162 - lm_score.HEAD and len({x for _, x in lp.values()}) > 1
    h = lambda w: int(lm_score.words(pa.array([w]))[0].view(np.int64)[0])
    assert h("q007s") in lp and h("q008s") in lp and all(x < 0 for _, x in lp.values())
    assert lp[h("q007s")][0] == 2 and lp[h("q007s")][1] < max(x for n, x in lp.values() if n == 3)
    flat = lm_score.train(df, known, 4000)
    plain = {r["doc_id"]: r["log_prob"] for r in lm_score.score(df, known, others, flat).collect()}
    bare = known._replace(hot=known.hot[:0], hot_log=known.hot_log[:0])
    joined = {r["doc_id"]: r["log_prob"] for r in lm_score.score(df, bare, others, flat).collect()}
    assert all(abs(plain[i] - joined[i]) < 1e-3 for i in plain)
    new = spark.createDataFrame([(0, "q007s"), (1, "q0zys")], "doc_id long, text string")
    got = {r["doc_id"]: r["log_prob"] for r in lm_score.score(new, known, others, flat).collect()}
    assert got[1] < got[0] < 0


def test_lm_network_by_hand(spark):
    """The two-level softmax against sums over all outcomes, and the gradient against differences."""
    import pyarrow as pa

    g = np.random.default_rng(2)
    heads = np.sort(lm_score.words(pa.array([f"h{i}" for i in range(50)]))[0])
    t = lm_score._words(pa.array(["h1 h2 rare h3 h4 other h5", None, "h7", "h8 h9"]), heads)
    w = {k: g.standard_normal(s) * 0.3 for k, s in lm_score.SHAPES.items()}
    lp = lm_score.log_probs(w, t)
    for i in range(len(t.row)):
        x = np.concatenate([w["e"][t.own[t.at[i] + d]] + (w["e"][t.other[t.at[i] + d]] if t.other[t.at[i] + d] >= 0 else 0) for d in lm_score.SIDE])
        h = np.tanh(x @ w["w"] + w["b"])
        outer, inner = np.exp(h @ w["c"] + w["d"]), np.exp(np.einsum("h,chp->cp", h, w["u"]) + w["v"])
        p = outer / outer.sum() * (inner / inner.sum(axis=1, keepdims=True)).T
        assert abs(p.sum() - 1) < 1e-9 and abs(lp[i] - np.log(p.ravel()[t.kind[i]])) < 1e-5
    grad = lm_score.gradient(w, t, np.arange(len(t.row)))
    loss = lambda: -sum(np.log(_naive(w, t, i)) for i in range(len(t.row))) / len(t.row)
    for k in lm_score.SHAPES:
        top = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        was, found = w[k][top], []
        for d in (1e-5, -1e-5):
            w[k][top] = was + d
            found.append(loss())
        w[k][top] = was
        assert abs((found[0] - found[1]) / 2e-5 - grad[k][top]) < 1e-6, k


def _naive(w, t, i):
    x = np.concatenate([w["e"][t.own[t.at[i] + d]] + (w["e"][t.other[t.at[i] + d]] if t.other[t.at[i] + d] >= 0 else 0) for d in lm_score.SIDE])
    h = np.tanh(x @ w["w"] + w["b"])
    outer = np.exp(h @ w["c"] + w["d"])
    kind, place = t.kind[i] % lm_score.CLASSES, t.kind[i] // lm_score.CLASSES
    inner = np.exp(h @ w["u"][kind] + w["v"][kind])
    return outer[kind] / outer.sum() * inner[place] / inner.sum()


def test_lm_same_at_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 5000)
    rows = [(i, prose(80)) for i in range(300)] + [(None, prose(20)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({(r["doc_id"], r["n_tokens"]): r["mean_log_prob"] for r in lm_score.pseudo_likelihood(df.repartition(n)).collect()} for n in (3, 7))
    assert one.keys() == two.keys() and all(one[k] is two[k] is None or abs(one[k] - two[k]) < 1e-6 for k in one)


def test_lm_random_letters_are_unlikely(spark):
    """Documents of random letters among the given ones score below nineteen in twenty of them."""
    from ..conftest import SF

    g = np.random.default_rng(8)
    junk = [" ".join("".join(g.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(80)) for _ in range(5)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = lm_score.pseudo_likelihood(docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(junk)], "doc_id long, text string"))).toPandas().dropna()
    own, odd = (out[out["doc_id"] >= 0]["mean_log_prob"], out[out["doc_id"] < 0]["mean_log_prob"])
    assert len(odd) == 5 and odd.max() < own.quantile(0.05)


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    more = docs.select("doc_id", "text").unionByName(docs.select("doc_id", F.lit("big words <|endoftext|> " * 1500).alias("text")).limit(1).withColumn("doc_id", F.lit(999).cast("long")))
    pieces = packing.token_pieces(more, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")).collect()
    whole = defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(whole[r["doc_id"]]) and r["length"] == len(r["ids"]) and (r["piece"] == 0 or r["length"] == 2048)
        whole[r["doc_id"]] += r["ids"]
    assert all(whole[i] == [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts))
    rows = packing.pack(packing.token_pieces(more, tokenizer_file("byte_bpe_50k.json"), with_ids=False), run_rows=4).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
        assert at <= 2048
    assert len(rows) == len(pieces) and len(places) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(packing.token_pieces(empty, tokenizer_file("byte_bpe_50k.json"), with_ids=False)).count() == 0


def brute_near(texts):
    """(set size, least id reachable, whether it is that) of each text."""

    def shingles(t):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


def test_near_duplicates(docs, texts, empty):
    want = brute_near(texts)
    for leaf in (200, 3):  # small nodes, and nodes over the leaf size in parts
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, leaf=leaf, block=leaf, rounds=1 if leaf == 3 else 3).collect()}
        assert got == want
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    """Copies of one text that differ in a few words each, texts around one passage, and plain ones: every link is found."""
    g = np.random.default_rng(4)
    base, passage = prose(70).split(), prose(50)
    texts = [prose(60) for _ in range(40)] + [passage + " " + prose(int(n)) for n in g.integers(4, 40, 90)]
    for _ in range(150):
        w = list(base)
        for k in g.integers(0, 70, int(g.integers(0, 3))):
            w[k] = "new" + str(g.integers(0, 999))
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for leaf in (600, 20):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, leaf=leaf, block=leaf // 2).collect()}
        assert got == brute_near(texts)


def brute_repeats(rows, width=20):
    """(n_words, n_removed, kept text) by id, for (id, text) in the order of ids."""
    seen, out = set(), {}
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone.update(range(k, k + width))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def digests(want):
    return {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in want.items()}


def test_remove_repeats(docs, texts, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs).collect()}
    assert got == digests(brute_repeats(enumerate(texts)))
    assert substring.remove_repeats(empty).count() == 0


def test_repeats_of_blocks(spark):
    """Blocks that stand together here and apart there, so that paths end within windows in every way."""
    g = np.random.default_rng(11)
    blocks = [[f"b{b}x{i}" for i in range(int(n))] for b, n in enumerate(g.integers(6, 30, 12))] + [["s"] * 25, ["s", "t"] * 14]
    rows, fresh = [], iter(range(10**6))
    for i in range(120):
        w = []
        for _ in range(int(g.integers(1, 14))):
            w += blocks[int(g.integers(0, len(blocks)))] if g.random() < 0.7 else [f"u{next(fresh)}" for _ in range(int(g.integers(1, 45)))]
        rows.append((i, "  ".join(w[:9]) + "\n\t" + " ".join(w[9:])))
    # two blocks four times each, together once only, with equal counts and sums of places
    a, b = ([f"{x}{i}" for i in range(12)] for x in "AB")
    w = [f"z{i}" for i in range(520)]
    for block, at in ((a, (0, 160, 200, 400)), (b, (50, 90, 250, 412))):
        for p in at:
            w[p : p + 12] = block
    rows += [(200, " ".join(w)), (201, " ".join(w[395:430])), (202, "end " + " ".join(w[400:423]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats(rows)
    assert want[200][1] == 0 and want[201][1] and sum(m for _, m, _ in want.values()) > 2000
    out = substring.remove_repeats(df).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == digests(want)
    assert all(r["kept_text"] == (want[r["doc_id"]][2] if r["n_removed"] else None) for r in out)


def test_repeats_of_rows_that_share_an_id(spark, texts):
    """Rows with a null id stay whole; rows of one id, also of unlike texts, neither fail nor lose words to each other alone."""
    long = " ".join(f"q{i}" for i in range(60))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (1, "short text"), (2, "other words " + long)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert got == [(0, 60, 0), (1, 2, 0), (1, 60, 0), (1, 60, 0), (2, 62, 60)]


def test_pipeline(spark):
    import corpus_pipeline as p

    from ..conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    out = p.STAGES[-1][1](spark, kept, SF)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()


def test_pipeline_stages(spark, texts):
    """Every stage on nulls, empty texts, repeated rows and rows without an id, against brute force."""
    import corpus_pipeline as p

    from ..conftest import SF

    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, "no id here", "en", "s", 10), (0, texts[0], "en", "s", len(texts[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(p.STAGES)
    take = lambda df: {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}
    own = dict(enumerate(texts))

    kept = stage["quality"](spark, docs, SF)
    stats = {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality_rules.word_stats(docs).collect()}
    left = take(kept)
    assert kept.columns == docs.columns and all(stats[i][0] >= 10 and 100 * stats[i][1] <= 20 * stats[i][0] and own[i] == t for i, t in left.items())

    lines = stage["lines"](spark, docs, SF)
    want = {i: t for i, t in brute_lines(own.items()).items() if t == own[i] or WORD.search(t)}
    assert take(lines) == want and lines.where("doc_id is null").count() == 1
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lines.collect())

    near = stage["near"](spark, docs, SF)
    assert near.count() == len(take(near)) + 1 and take(near) == {i: own[i] for i, (_, _, k) in brute_near(texts).items() if k}

    cutout = stage["repeats"](spark, docs, SF)
    want = {i: own[i] if not m else t for i, (_, m, t) in brute_repeats(own.items()).items() if not m or t}
    assert take(cutout) == want

    packed = stage["packed"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {*own, None} and len(packed) >= len(rows)
    empty = docs.where("false")
    for name, f in p.STAGES:
        assert f(spark, empty, SF).count() == 0, name


def test_repeats_stage_keeps_a_row_for_a_row(spark):
    import corpus_pipeline as p

    from ..conftest import SF

    same, own = prose(30), [prose(25) for _ in range(3)]
    rows = [(1, same, "a", {"k": 1}), (2, f"{own[0]} {same}", "b", {"k": 2}), (2, f"{own[1]} {same}", "c", None), (2, f"{own[1]} {same}", "c", None), (3, own[2], "d", {}), (3, None, "e", {}), (4, same, "f", {}), (None, same, "g", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, m map<string, long>")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["row"]) for r in p.repeats(spark, docs, SF).collect())
    one = brute_repeats([(2, rows[1][1]), (3, None)])
    assert one[2][1] == 0
    assert [r for r in got if r[2] in "adeg"] == [(0, same, "g"), (1, same, "a"), (3, "", "e"), (3, own[2], "d")]
    assert [r[2] for r in got] == ["g", "a", *[r[2] for r in got if r[0] == 2], "e", "d"] and not any(r[2] == "f" for r in got)
    assert sorted(r[2] for r in got if r[0] == 2) in (["b"], ["b", "c", "c"])
    assert all(r[1] in (own[0], own[1], "") or r[1].startswith(own[1]) or r[1].startswith(own[0]) for r in got if r[0] == 2)
    assert p.near(spark, docs, SF).count() > 0
