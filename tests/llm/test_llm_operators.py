"""The training-data operators against brute force, with nulls, empties, repeats, extra columns and empty tables."""

import collections
import hashlib
import itertools
import math
import os
import pathlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.llm import bpe, decontaminate, embedding_dedup, html_text, langid, lm_score, ngram_join, pii, quality, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3000)]


def sentence(n, words=VOCABULARY):
    return " ".join(rng.choice(words) for _ in range(n))


def documents(spark, texts, lang=None):
    """Documents with nulls, an empty text, white space, a repeated row, and columns whose names clash with results."""
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n\t "), (len(rows) + 3, "one two"), (len(rows) + 4, "one two"), (None, "no id " + texts[0][:40])]
    rows.append(rows[0])
    return spark.createDataFrame([(i, t, lang and lang(i), None, len(t or ""), 0.5, "x") for i, t in rows], SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 language


def test_language(spark):
    sounds = {"en": "the and that with of to in".split(), "de": "der die und nicht ein zu".split(), "fr": "les des que pas une est".split(), "es": "los que una el por con".split()}
    codes = sorted(sounds)
    lang = lambda i: codes[i % 4] if i is not None and i < 400 else None
    docs, _ = documents(spark, [sentence(30, sounds[codes[i % 4]]) for i in range(400)], lang)
    made = langid.identify(docs, docs).collect()
    assert len(made) == docs.count()
    truth = [r for r in made if r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["lang_pred"] == codes[r["doc_id"] % 4] for r in truth if r["held_out"]) >= 0.97 * sum(r["held_out"] for r in truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in truth)
    assert {r["lang_pred"] for r in made if r["doc_id"] in (400, 401, 402)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in made)


def test_language_without_labels(spark):
    docs, _ = documents(spark, ["some words"])
    assert {r["lang_pred"] for r in langid.identify(docs, docs).collect()} == {"und"}
    assert langid.identify(empty(spark), empty(spark)).count() == 0


# 2 BPE


def test_bpe_equals_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["Hello world, it's 2024!", "aaaaaaaaaa aaa   aa\n\n x", "a<|endoftext|>b", "日本語 x ² ½ \x1c\x85\xa0 z", "é" * 500, "😀 don't\t\tstop", "word " * 5000, sentence(200)]
    docs, rows = documents(spark, texts)
    made = sorted((r["doc_id"] if r["doc_id"] is not None else -1, list(r["ids"]), r["decoded"]) for r in bpe.encode_decode(docs, path).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, ids, library.decode(ids, skip_special_tokens=False)))
    assert made == sorted(want)
    digest = {r["doc_id"]: r for r in bpe.digests(bpe.encode_decode(docs, path)).collect()}
    assert digest[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode(texts[0]).ids)).encode()).hexdigest()
    assert bpe.encode_decode(empty(spark), path).count() == 0


# 3 PII


def test_feistel_is_a_permutation():
    net = pii.Feistel(b"k" * 32)
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(net.once("x", n, i) for i in range(n)) == list(range(n))


def test_pii(spark):
    card, wrong = "4111 1111 1111 1111", "4111 1111 1111 1112"
    text = f"Mail a.b-9@mail.example.com or call +1 (988) 555-2485 from 42.144.35.254; card {card}, not {wrong}; 2024-02-29 is 29/02/2024, 2023-02-29 is nothing; 123-45-6789"
    docs, rows = documents(spark, [text, f"again {card} and 4111111111111111", "clean words only"])
    made = {r["doc_id"]: r for r in pii.pseudonymise(docs, ["doc_id"], b"key").collect()}
    first = made[0]
    assert first["n_found"] == 7 and wrong in first["text"] and "2023-02-29" in first["text"]
    for gone in ("a.b-9@mail.example.com", "555-2485", "42.144.35.254", card, "2024-02-29", "29/02/2024", "123-45-6789"):
        assert gone not in first["text"]
    found = pii.FOUND.findall(first["text"])
    assert len(found) == 9
    new = first["text"].split("card ")[1][:19]
    assert pii.luhn(new.replace(" ", "")[:-1]) == int(new[-1]) and new in made[1]["text"] and new.replace(" ", "") in made[1]["text"]
    iso, slashed = first["text"].split("; ")[2][:10], first["text"].split(" is ")[1][:10]
    assert iso == "-".join(reversed(slashed.split("/")))
    assert made[2]["text"] == "clean words only" and made[3]["text"] is None and made[4]["text"] == ""
    other = pii.pseudonymise(docs, ["doc_id"], b"other").where("doc_id = 0").first()["text"]
    assert other != first["text"] and pii.pseudonymise(empty(spark), ["doc_id"], b"key").count() == 0


def test_pii_dates_key_and_clashing_names(spark):
    worker, text = pii.Pseudonymiser(b"key"), "12/31/2023 and 31/12/2023 and 2023-12-31, 01/02/1850, 2150-03-04, 31.12.9999; not 31/31/2023"
    made, count = worker.replace(text)
    assert count == 6 and made.endswith("not 31/31/2023") and not any(d in made for d in ("12/31/2023", "31/12/2023", "2023-12-31", "1850", "2150-03-04", "31.12.9999"))
    us, eu, iso = made[:10], made[15:25], made[30:40]
    assert us[6:] + us[:2] + us[3:5] == eu[6:] + eu[3:5] + eu[:2] == iso.replace("-", "") and 1900 <= int(iso[:4]) < 2100
    docs, _ = documents(spark, ["mail a.b@example.com " * 20_000])
    out = pii.pseudonymise(docs, ["text", "doc_id"], pii.key_of(spark))
    assert out.columns == ["row", "text", "n_found"] and out.where("row.doc_id = 0").first()["n_found"] == 20_000
    assert pii.key_of(spark) == pii.key_of(spark) and len(pii.key_of(spark)) == 32


def test_pii_phones_of_any_area_code():
    worker = pii.Pseudonymiser(b"key")
    numbers = [f"+1 ({area}) {office}-{line}" for area in ("017", "132", "073", "988") for office in ("055", "155", "555") for line in ("7713", "1352")]
    made = [worker.replace(f"call {n} now") for n in numbers]
    assert all(count == 1 and n not in text and pii.FOUND.search(text).lastgroup == "phone" for n, (text, count) in zip(numbers, made))
    assert len({text for text, _ in made}) == len(numbers)
    assert worker.replace("dial 017.555.7713")[0][5:].replace(".", "") == worker.replace("+1 (017) 555-7713")[0][4:].replace(") ", "").replace("-", "")


# 4 substrings


def removed(rows, window):
    counts = collections.Counter()
    words = [(t or "").encode().split() for _, t in rows]
    for w in words:
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_substrings(spark):
    passage, other = sentence(60), sentence(35)
    texts = [sentence(50) + " " + passage + " " + sentence(20), passage, sentence(10) + " " + passage[: len(passage) // 2] + " " + sentence(40), other + " x " + other, "same " * 90, sentence(300)]
    near = sentence(120).split()
    for k in range(30):
        copy = near[:]
        copy[rng.randrange(120)] = f"odd{k}"
        texts.append(" ".join(copy))
    docs, rows = documents(spark, texts)
    made = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.deduplicate(docs).collect())
    assert made == collections.Counter((i, *x) for (i, _), x in zip(rows, removed(rows, 35), strict=True))
    assert substring_dedup.deduplicate(empty(spark)).count() == 0


# 5 language model


def test_lm(spark):
    texts = [sentence(40, VOCABULARY[:300]) for _ in range(300)] + ["Upper UPPER upper é"]
    docs, rows = documents(spark, texts)
    made = lm_score.scores(docs).collect()
    learned = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    counts = collections.Counter(w for _, t in learned for w in (t or "").encode().lower().split())
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = {i: [(t or "").encode().lower().split()] for i, t in rows}
    assert len(made) == len(rows)
    for r in made:
        words = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert r["base_score"] == pytest.approx(sum(base(counts[w]) for w in words) + base(len(learned)))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm_score.scores(empty(spark)).count() == 0


def test_lm_counts_words_beyond_the_code(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 6)
    g = random.Random(8)
    words = ["".join(g.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(400)]
    count = {w: 1 + 60 * (i == 0) + 5 * (i == 1) + (2 <= i < 60) for i, w in enumerate(words)}
    tokens = [w for w, c in count.items() for _ in range(c)] + [f"top{i}" for i in range(6) for _ in range(100)]
    g.shuffle(tokens)
    learned = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10][:100]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(i, " ".join(tokens[k::100])) for k, i in enumerate(learned)] + [(i, words[k]) for k, i in zip((0, 1, 2), held)]
    score = {r["doc_id"]: r["score"] for r in lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spectrum = collections.Counter([*count.values(), *[100] * 6])
    discount, new, total = lm_score.escaped_shares(spectrum, 100)
    assert total == sum(count.values()) and new + sum(c - discount for c in count.values()) / total == pytest.approx(1)
    of = lambda k: math.log10(count[words[k]] - discount)
    assert score[held[0]] - score[held[1]] == pytest.approx(of(0) - of(1), abs=0.05)
    assert score[held[1]] - score[held[2]] == pytest.approx(of(1) - of(2), abs=0.2)


def test_lm_is_a_distribution():
    g = np.random.default_rng(5)
    code = lm_score.Code(g.integers(1, 400, 600))
    leaf, contexts = g.integers(0, 600, 4000), g.integers(0, 3, (lm_score.CONTEXTS, 4000)).astype(np.uint32)
    model = lm_score.Bits(lm_score.CONTEXTS, lm_score.DEPTHS, lm_score.WORD_BITS)
    for i in range(0, 4000, 500):
        *bits, _ = lm_score.node_bits(code, leaf[i : i + 500], contexts[:, i : i + 500], True)
        model.learn(*bits)
    model.mixer.take(model.mixer.sums())
    for c in range(3):
        every = lm_score.token_log10(model, code, np.arange(600), np.full((lm_score.CONTEXTS, 600), c, np.uint32))
        assert (10.0**every).sum() == pytest.approx(1, abs=1e-3)


def test_lm_shards_add_up():
    g = np.random.default_rng(6)
    shards = [lm_score.Mixer(3, 8) for _ in range(2)]
    for m in shards:
        m.train(g.normal(size=(3, 500)).astype(np.float32), g.integers(0, 6, 500), g.integers(0, 2, 500))
    made = lm_score.Mixer(3, 8)
    made.take(sum(m.sums() for m in shards))
    share = shards[0].read[:6] / (shards[0].read + shards[1].read)[:6]
    want = shards[0].weights[:, :6] * share + shards[1].weights[:, :6] * (1 - share)
    assert np.allclose(made.weights[:, :6], want, atol=1e-5) and np.allclose(made.weights[:, 6:], 1 / 3)
    assert np.allclose(made.seen, shards[0].seen + shards[1].seen, atol=1e-4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_lm_beats_the_base_on_held_out_texts(spark):
    held = lm_score.op5_lm_score(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert held["s"] / held["n"] > held["b"] / held["n"]


# 6 benchmark


def test_decontamination(spark):
    items = [sentence(30), sentence(12), sentence(40), "too few"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (None, items[0])], "item_id long, text string")
    swapped = items[2].split()
    for k in (5, 14, 23, 33):
        swapped[k] = "changed"
    part = " ".join(items[0].split()[8:24])
    docs, _ = documents(spark, [sentence(40) + " " + items[0] + " " + sentence(30), items[1].upper(), sentence(5) + " " + " ".join(swapped), sentence(20) + " " + part, sentence(200), " ".join(items[0].split()[:6]) + " " + sentence(50)])
    for bound in (500_000, 0):
        made = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, broadcast_seeds=bound).collect()}
        assert made == {(0, 0), (1, 1), (2, 2), (3, 0)}
    short = spark.createDataFrame([(0, "a b c d e"), (1, "x y"), (2, items[0])], "item_id long, text string")
    double = spark.createDataFrame([(1, "say a b c d e now", 1), (1, sentence(40) + " " + items[0], 2), (1, sentence(60), 3), (2, "a b c d f", 4), (3, "z x", 5), (3, "x y", 6)], "doc_id long, text string, row int")
    for bound in (500_000, 0):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(double, short, broadcast_seeds=bound).collect()} == {(1, 0), (1, 2), (3, 1)}
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def substituted(n):
    """All ways to substitute a fourth of n tokens."""
    return list(itertools.combinations(range(n), n - math.ceil(0.75 * n)))


def test_masks_leave_out_no_pattern():
    for n in range(decontaminate.SHORTEST, 13):
        masks = decontaminate.MASKS if n == 12 else decontaminate.SHORT_MASKS
        places = [{at + k for k, bit in enumerate(mask) if bit == "1"} for mask in masks for at in range(n - len(mask) + 1)]
        assert all(any(place.isdisjoint(gone) for place in places) for gone in substituted(n))


def test_decontamination_with_any_tokens_substituted(spark):
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate((12, 15, 7, 8, 10))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    texts, want = [], set()
    for k, words in enumerate(items):
        part = words[:12]
        for gone in substituted(len(part)):
            want.add((len(texts), k))
            texts.append(" ".join(["before"] * 5 + ["odd" if j in gone else w for j, w in enumerate(part)] + ["after"] * 5))
        spoilt = [*part]
        for j in range(0, len(part), 3):
            spoilt[j] = "odd"
        texts.append(" ".join(spoilt))  # one token too many
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound in (500_000, 0):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, broadcast_seeds=bound).collect()} == want
    only_long = bench.where("item_id = 1")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, only_long).collect()} == {d for d, k in want if k == 1}


# 7 HTML


def test_html(spark):
    page = """<html><head><title>T</title><script>var x="</p>";</script></head><body><nav><a href=/>home</a></nav><div class="ad">buy</div>
    <article><h1>Head &amp; line</h1><p>First   paragraph<br>goes &eacute; on, with enough words in it.<p>Second &lt;b&gt; paragraph, also long enough.
    <ul><li>one<li>two</ul></article><aside>side</aside><div id="comments"><p>A reader's comment that is quite long, longer than most.</p></div><footer>foot</footer></body></html>"""
    want = "Head & line\nFirst paragraph goes é on, with enough words in it.\nSecond <b> paragraph, also long enough.\none\ntwo"
    plain = "<body><div class=top><a href=a>x</a> <a href=b>y</a></div><div><div><p>Long text of the article number one, really.</p></div><div><p>Long text of the article number two, really.</p></div></div></body>"
    pages = spark.createDataFrame([(1, "u", page, 1), (2, "u", None, 1), (3, None, "", 1), (4, "u", "<p>unclosed", 1), (5, "u", plain, 1), (5, "u", plain, 1), (6, "u", "<div>" * 4000 + "deep", 1)], "page_id long, url string, html string, text int")
    made = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert made[1]["text"] == want and made[1]["n_chars"] == len(want)
    assert [made[i]["text"] for i in (2, 3, 4, 6)] == ["", "", "unclosed", "deep"]
    assert "number one" in made[5]["text"] and "number two" in made[5]["text"]
    assert html_text.extract(pages).count() == 7 and html_text.extract(pages.limit(0)).count() == 0


def test_html_by_density():
    """Pages without article or main, wrappers with the names of other parts, comments longer than the article, broken markup."""
    text = html_text.main_text
    thin, long, more = "A shorter first section of the article, of one line and then some more of it. " * 2, "A longer second section. " * 8, "And more of it, " * 9
    ad, lines = "Buy this now, it is a great long advert text without links. " * 3, lambda *parts: "\n".join(p.strip() for p in parts)
    menu = '<div class="nav"><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div>'
    assert text(f"<body>{menu}<section><p>{thin}</p></section><section><p>{long}</p><p>{more}</p></section><div class=ad>{ad}</div></body>") == lines(thin, long, more)
    assert text(f"<body>{menu}<div id=x><h2>Head</h2><p>{long}</p><p>{more}</p></div><div><ul><li><a href=d>four</a></li><li><a href=e>five</a></li></ul></div></body>") == lines("Head", long, more)
    assert text('<div class="content has-sidebar"><article><p>text here</p></article><div class="sidebar"><p>side</p></div></div>') == "text here"
    inner = f'<div class="sidebar"><p>side text here, not so short either</p></div><div class="content"><h1>Head</h1><p>{long}</p><p>{more}</p><div class="comments"><p>{ad * 5}</p></div></div>'
    assert text(f'<body><div class="layout sidebar-left">{inner}</div><footer>foot</footer>') == lines("Head", long, more)
    assert text("<p>a</p><![foo[ x ]]>b") == "a\nb" and text("x\n<!-- a") == "x" and text("<!-->y<!--->z<!-- -- -->!") == "yz!"
    for part in ("<b>", "</i>", "<p>x", "<div class=ad>", "<li>", "<!x>", "<td>"):
        began = time.perf_counter()
        text("<b>" * 20_000 + part * 20_000 + "end")
        assert time.perf_counter() - began < 5
    assert len(text("<p>" + "long " * 400_000)) == 1_999_999


# 8 quality


def test_quality(spark):
    texts = [sentence(40) if i % 4 else " ".join(f"{w}%%%" for w in sentence(40).split()) for i in range(400)]
    docs, _ = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    made = quality.classify(docs, labels).collect()
    assert len(made) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in made)
    held = [r for r in made if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) >= 0.95
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0


# 9 embeddings


def links_of(vectors, cosine=0.9):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= cosine
    np.fill_diagonal(close, False)
    return close


def test_embeddings(spark):
    g = np.random.default_rng(2)
    centres = g.standard_normal((40, 32))
    x = np.vstack([c + 0.15 * g.standard_normal((k, 32)) for k, c in zip([1, 2, 3, 300] + [5] * 36, centres)]).astype(np.float32)
    close = links_of(x)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    x = np.vstack([x, np.tile(x[1], (400, 1))])  # equal vectors
    close = links_of(x)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(9001, None, 1), (9002, [0.0] * 32, 1), (9003, [float("nan")] * 32, 1), (9004, [1.0, None], 1), (9005, [], 1), (9006, [1.0, 1.0], 1), rows[5]]
    made = embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()
    assert len(made) == len(rows) + len(odd)
    got = {r["vec_id"]: r for r in made}
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.99 * close.sum()
    assert all(got[i]["n_links"] <= close[i].sum() for i in range(len(x)))
    assert all(got[i]["component_id"] == i and got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9001, 9007))
    for i in range(len(x)):
        reach = {i}
        while more := set(np.flatnonzero(close[list(reach)].any(0))) - reach:
            reach |= more
        assert got[i]["component_id"] == min(reach)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 10 shingles


def components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return collections.Counter((i, len(s), least.get(c)) for (i, _), s, c in zip(rows, sets, label))


def test_shingles(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("WHOLE", 32), ("GROUP_ROWS", 50), ("PART_BYTES", 400_000)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = [sentence(n) for n in (3, 4, 5, 8, 30, 200, 2000)]
    texts += [texts[5].upper(), texts[5] + " more words", " ".join(texts[6].split()[:1900])]
    for size, copies, edits in ((120, 150, 4), (120, 90, 6), (40, 20, 1)):  # families beyond one unit, partly linked
        base = sentence(size).split()
        for k in range(copies):
            copy = base[:]
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(size)] = f"odd{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    docs, rows = documents(spark, texts)
    made = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect())
    assert made == components(rows)
    kept = ngram_join.representatives(docs)
    ids = {c for _, _, c in components(rows) if c is not None}
    found = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and found.count(None) == 1 and sorted(i for i in found if i is not None) == sorted(ids)
    assert ngram_join.components(empty(spark)).count() == 0


def test_meeting_leaves_only_its_stars(spark, tmp_path):
    """Tables of a step are dropped when the next is written; they used to stay on the disk until the end."""
    docs = spark.createDataFrame([(i, sentence(40) if i % 3 else "the same words in every third row of all") for i in range(60)], "doc_id long, text string")
    rows = ngram_join.cut(ngram_join.describe(docs, 4, 85))
    tables = pathlib.Path(rows.table_path.removeprefix("file:")).parent
    before = set(tables.iterdir())
    stars = ngram_join.meeting(rows.withColumn("side", F.lit(0)))
    left = set(tables.iterdir()) - before
    assert [p.name for p in left] == [pathlib.Path(stars.table_path).name]


def test_block_keys_are_not_stored_and_name_their_rows(spark, monkeypatch):
    """The keys of all rows used to be written as a table and then shuffled with eight bytes of node each; now they travel once, by place in a block of rows."""
    written, plain = [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df: written.append(set(df.columns)) or plain(df))
    texts = [sentence(30) for _ in range(30)]
    texts += [t.upper() for t in texts[:9]] + [texts[3] + " end"]  # copies in other tasks, one of which has a near copy
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5, "doc_id")
    made = {r["doc_id"]: r["component_id"] for r in ngram_join.components(plain(docs)).collect()}
    assert made == {i: {39: 3}.get(i, i if i < 30 else i - 30) for i in range(40)}
    assert not any({"n_shingles", "keys"} <= columns for columns in written)
    monkeypatch.setattr(ngram_join, "cut", plain)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:  # one batch of more rows than a block
        rows = spark.range(0, 70_000, 1, 1).select(F.col("id").alias("node"), F.array(F.xxhash64(F.col("id") % 35_000)).alias("keys"), F.lit(1).cast("long").alias("need"), F.lit(0).alias("side"))
        table = ngram_join.gathered(rows, 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    node = {r["row"]: r["node"] for r in table if r["row"] is not None}
    assert len(node) == 70_000 and {tuple(sorted(map(node.get, r["members"]))) for r in table if r["row"] is None} == {(i, i + 35_000) for i in range(35_000)}


def test_only_doubtful_rows_of_representatives_are_shuffled(spark):
    """Texts of rows that are kept and not repeated pass by the shuffle; all columns and one copy of repeated rows stay."""
    texts = [sentence(30) for _ in range(40)]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(50, texts[3], "copy"), (7, texts[7], "s7"), (None, texts[9], "null"), (None, None, "no text"), (60, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = ngram_join.representatives(docs)
    assert collections.Counter(map(tuple, made.collect())) == collections.Counter([*rows[:40], (None, None, "no text"), (60, "", "empty")])
    assert "Union" in made._jdf.queryExecution().executedPlan().toString()


def test_shingles_block_by_block(spark, monkeypatch):
    """Families that stay large after the turns are multiplied with all their blocks."""
    for name, value in (("BLOCK_ROWS", 8), ("WHOLE", 12), ("TURNS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    base, texts = sentence(100).split(), []
    for k in range(120):
        copy = base[:]
        if k >= 60:
            for at in (10, 30, 50):  # one more template, too far from the first
                copy[at] = f"other{at}"
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(100)] = f"odd{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs, rows = documents(spark, texts)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()) == components(rows)


def test_rows_of_a_family_grow_linearly(spark):
    """Rows compared, in all turns, per near copy of one text with up to 12 substitutions: at most three, for any number of copies."""
    base, per_copy = sentence(150).split(), {}
    for size in (500, 1000, 2000):
        g, texts = random.Random(size), []
        for k in range(size):
            copy = base[:]
            for _ in range(g.randint(0, 12)):
                copy[g.randrange(150)] = f"odd{g.randrange(10**6)}"
            texts.append(" ".join(copy))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = ngram_join.cut(ngram_join.describe(docs, 4, 85))
        stars, compared, turns = ngram_join.cut(ngram_join.largest_stars(ngram_join.meeting(rows.withColumn("side", F.lit(0))))), 0, 0
        shown = rows.select("node", "key").distinct()
        while turns < ngram_join.TURNS and not stars.isEmpty():
            compared += stars.count() + stars.select("a").distinct().count()
            made = ngram_join.cut(ngram_join.compared(docs, shown, stars, 4, 85, False))
            stars, turns = ngram_join.cut(ngram_join.meeting(ngram_join.met_again(made))), turns + 1
        assert stars.isEmpty()
        per_copy[size] = compared / size
    assert max(per_copy.values()) <= 3


def test_changes_meet_every_link():
    """Brute force over random near copies of a hub: linked rows of which one is far share a key."""
    g = np.random.default_rng(7)
    for percent in (80, 85):
        for size in (12, 40, 90):
            hub = np.unique(g.integers(0, 2**60, size, dtype=np.uint64))
            pool = g.integers(2**61, 2**62, 12, dtype=np.uint64)
            rows = [np.unique(np.concatenate((g.permutation(hub)[int(g.integers(0, size // 4 + 1)) :], g.permutation(pool)[: int(g.integers(0, 10))]))) for _ in range(150)]
            found = [ngram_join.changes(r, hub, percent, 5) for r in rows]
            for (x, (fx, kx, cx)), (y, (fy, ky, cy)) in itertools.combinations(list(zip(rows, found)), 2):
                both = len(np.intersect1d(x, y))
                if (fx or fy) and not np.array_equal(x, y) and 100 * both >= percent * (len(x) + len(y) - both):
                    assert len(np.intersect1d(kx, ky) if fx and fy else np.intersect1d(cx, cy))


def test_block_keys_lose_no_pair():
    g = np.random.default_rng(4)
    for n, percent in itertools.product([*range(1, 60), 150, 400], (85, 80)):
        base = g.integers(0, 2**63, n, dtype=np.uint64)
        most = 2 * n * (100 - percent) // (100 + percent)
        for _ in range(4):
            drop, add = (int(g.integers(0, most + 1)) for _ in range(2))
            other = np.sort(np.concatenate((g.permutation(base)[drop:], g.integers(0, 2**63, add, dtype=np.uint64))))
            both = len(np.intersect1d(base, other))
            if len(other) and 100 * both >= percent * (n + len(other) - both):
                (mine, my_need), (theirs, their_need) = ngram_join.block_keys(np.sort(base), percent), ngram_join.block_keys(other, percent)
                shared = len(np.intersect1d(mine, theirs))
                assert np.array_equal(np.sort(base), other) or shared >= max(my_need, their_need)
