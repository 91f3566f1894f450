"""Corpus operators against independent, plain versions of themselves."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import html_main, language_id, lm_scoring, mixing, near_dedup, token_store
from folioframe.llm.alignment import distance_within

LOW = {65 + i: 97 + i for i in range(26)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


# -- tag-path ratios ---------------------------------------------------------------------------------------------------


class Tree(HTMLParser):
    """Well-formed pages as nested lists: [tag, attributes, children], texts as strings."""

    def __init__(self):
        super().__init__()
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in html_main.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def twin(page):
    """Blocks as (text, linked characters, path, chain of block elements), their ratios, and what is selected."""
    tree = Tree()
    tree.feed(page)
    blocks, piece = [], []

    def end(path, chain):
        text = re.sub(r"[ \t\n\r\f\v]+", " ", "".join(t for t, _ in piece)).strip(" ")
        if text:
            blocks.append((text, min(sum(len(t) for t, linked in piece if linked), len(text)), path, chain))
        piece.clear()

    def walk(node, path, chain, linked):
        for child in node[2]:
            if isinstance(child, str):
                piece.append((child, linked))
                continue
            tag, attrs, _ = child
            block = tag in html_main.BLOCK
            if block:
                end(path, chain)
            if tag in html_main.DROPPED or tag in html_main.RAW or attrs.get("role") in html_main.ROLES:
                continue
            prior = html_main.AGAINST if any(html_main.named(attrs.get(k) or "") for k in ("class", "id")) and tag not in ("html", "body", "article", "main") else html_main.FOR if tag in ("article", "main") else 1.0
            own = (*path, (tag, re.sub(r"\d+", "", attrs.get("class") or ""), prior)) if block or prior < 1 else path
            walk(child, own, (*chain, id(child)) if block else chain, linked or tag == "a")
            if block:
                end(own, (*chain, id(child)))

    walk(tree.root, (), (0,), False)
    end((), (0,))
    if not blocks:
        return ""
    order = list(dict.fromkeys(b[2] for b in blocks))
    of = lambda p: [b for b in blocks if b[2] == p]
    whole = sum(len(b[0]) for b in blocks)
    length = [sum(len(b[0]) for b in of(p)) / len(of(p)) for p in order]
    marks = [(sum(len(re.findall("[.,;:!?。，！？…]", b[0])) for b in of(p)) + 0.1) / len(of(p)) for p in order]
    fused = {}
    for i, p in enumerate(order):
        near = [(math.exp(-2 * (i - j) ** 2), j) for j in range(len(order)) if abs(i - j) <= html_main.NEAR]
        value = math.sqrt(sum(w * length[j] for w, j in near) * sum(w * marks[j] for w, j in near)) * sum(len(b[0]) - b[1] for b in of(p)) / whole
        priors = [s[2] for s in p]
        against = min((x for x in priors if x < 1), default=None)
        fused[p] = value * (against if against is not None else max(priors, default=1.0))
    most = max(fused.values())
    content = [b for b in blocks if fused[b[2]] >= html_main.SHARE * most]
    size = sum(len(b[0]) for b in content)
    deepest = max((c for b in content for c in [b[3][: k + 1] for k in range(len(b[3]))] if sum(len(x[0]) for x in content if x[3][: len(c)] == c) >= html_main.NEARLY * size), key=len)
    if any(b[3] == deepest for b in blocks):
        deepest = deepest[:-1] or deepest
    return "\n".join(b[0] for b in blocks if fused[b[2]] >= (html_main.WITHIN if b[3][: len(deepest)] == deepest else html_main.SHARE) * most)


def sentences(r, n):
    return " ".join(" ".join(r.choice(("alpha", "beta", "gamma", "delta", "of", "the")) for _ in range(r.randint(4, 9))) + r.choice((".", ",", "!", ";")) for _ in range(n))


def random_page(r):
    def part(depth):
        kind = r.random()
        if kind < 0.45 or depth > 3:
            return f"<p>{sentences(r, r.randint(1, 6))}" + (f" <a href='x'>{sentences(r, 1)}</a>" if r.random() < 0.3 else "") + "</p>"
        if kind < 0.6:
            return "<ul>" + "".join(f"<li><a href='y'>{sentences(r, 1)}</a></li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.7:
            return f"<h2>{sentences(r, 1)}</h2>"
        tag, name = r.choice((("div", ""), ("div", " class='box'"), ("div", " class='ad'"), ("section", " id='comments'"), ("article", ""), ("aside", ""), ("span", "")))
        return f"<{tag}{name}>" + "".join(part(depth + 1) for _ in range(r.randint(1, 3))) + f"</{tag}>"

    return "<html><body>" + "".join(part(0) for _ in range(r.randint(1, 6))) + "</body></html>"


def test_html_equals_its_twin():
    r = random.Random(4)
    for _ in range(400):
        page = random_page(r)
        assert html_main.main_text(page) == twin(page), page


#: Nothing here says by its name what it is: only the ratios tell the article from what stands around it.
UNNAMED = "<body><div class='one'>" + "".join(f"<div><a href='l{i}'>Some link {i}</a></div>" for i in range(8)) + "</div><div class='two'>" + "<p>A sentence of the article, with some words and marks; it goes on, and ends.</p>" * 6 + "</div><div class='three'><p>Short note</p></div></body>"
ARTICLE = "\n".join(["A sentence of the article, with some words and marks; it goes on, and ends."] * 6)


def test_html_is_selected_by_its_ratios(monkeypatch):
    assert html_main.main_text(UNNAMED) == ARTICLE
    plain = html_main.ratios
    monkeypatch.setattr(html_main, "ratios", lambda blocks: dict.fromkeys(plain(blocks), 1.0))
    assert html_main.main_text(UNNAMED) != ARTICLE
    named = UNNAMED.replace("class='one'", "class='menu'").replace("class='three'", "class='ad'").replace("<div class='two'>", "<article>").replace("</p></div><div class='ad'>", "</p></article><div class='ad'>")
    assert html_main.main_text(named) != ARTICLE  # names alone drop nothing
    monkeypatch.setattr(html_main, "ratios", plain)
    assert html_main.main_text(named) == ARTICLE
    monkeypatch.setattr(html_main, "SHARE", -1)
    assert html_main.main_text(UNNAMED) != ARTICLE


def test_html_takes_time_in_proportion():
    def seconds(n):
        page = "<div>" * n + "x, y." + "<b>" * n + "<li>a" * n + "<p>b" * n + "<a " * n
        t = time.time()
        html_main.main_text(page)
        return time.time() - t

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)


# -- language ----------------------------------------------------------------------------------------------------------


def plain_grams(text):
    t = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    out = Counter()
    for w in t.split():
        s = f" {w} "
        out.update(list(w) + [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)])
    return out


def number(gram):
    n = 0
    for c in gram:
        n = n << 21 | (1 if c == " " else ord(c) + 1)
    return n


def ranked(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:most]


def test_language_predictions_by_brute_force(spark):
    r = random.Random(2)
    stems = {"aa": "the and of weather people walking park", "bb": "der die und wetter leute gehen garten", "cc": "le la et temps gens marchent jardin"}
    rows = [(i, " ".join(r.choice(stems[k].split()) for _ in range(r.randint(1, 30))), k) for i in range(90) for k in [r.choice(list(stems))]]
    long = " ".join(r.choice(stems["bb"].split()) for _ in range(120_000))  # longer than a slice
    rows += [(100, long, None), (101, "", "aa"), (102, None, "bb"), (103, "12 !", "cc"), (104, "the der", None), (105, "the der", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(df)
    whole = defaultdict(Counter)
    for _, t, k in rows:
        if k:
            whole[k].update(plain_grams(t or ""))
    want = {k: ranked(c, language_id.RANKS) for k, c in whole.items()}
    assert {k: list(map(number, v)) for k, v in want.items()} == profiles
    for row in language_id.predict(df, profiles).collect():
        own = ranked(plain_grams(dict((i, t) for i, t, _ in rows)[row.doc_id] or ""), language_id.RANKS)
        if not own:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        far = {k: sum(min(abs(p.index(g) - i), language_id.RANKS) if g in p else language_id.RANKS for i, g in enumerate(own)) for k, p in want.items()}
        best = min(sorted(far), key=far.get)
        assert row.lang_pred == best and row.score == pytest.approx(1 - far[best] / (len(own) * language_id.RANKS))


# -- language model ----------------------------------------------------------------------------------------------------


def test_lm_scores_step_by_step(spark, monkeypatch):
    from folioframe.llm import gated_lm as G

    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "unseen words here"), (62, "w1 w2 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    caught = {}
    plain = lm_scoring.learned
    monkeypatch.setattr(G, "WORDS", 32)
    monkeypatch.setattr(G, "CLASSES", 4)
    monkeypatch.setattr(G, "SIZE", 8)

    def keep(training, text, known, start):
        caught["vocabulary"], caught["model"] = known, plain(training, text, known, start)
        caught["start"] = start
        return caught["model"]

    monkeypatch.setattr(lm_scoring, "learned", keep)
    got = {x.doc_id: x.score for x in lm_scoring.lm_scores(df, F.col("doc_id") < 50, train_docs=20).collect()}
    keys, numbers = caught["vocabulary"]
    p = {k: v.astype(np.float64) for k, v in caught["model"].items()}
    assert any((caught["start"][k] != caught["model"][k]).any() for k in p)  # it has learned from the documents
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "\n"]
    counts = Counter(w for i, t in rows if i < 50 for w in split(t))
    number_of = {}
    for w in {w for _, t in rows for w in split(t)}:
        h = lm_scoring.END_HASH if w == "\n" else lm_scoring.tokens([w.encode()])[0][0]
        at = np.searchsorted(keys, h)
        number_of[w] = int(numbers[at]) if at < len(keys) and keys[at] == h else G.OTHER
    inside = [w for w in counts if number_of[w] != G.OTHER]
    z = sum(counts.values()) - sum(counts[w] for w in inside) + len(counts) - len(inside) + 1
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for i, t in rows:
        h, before, total, k = np.zeros(G.HIDDEN), G.END, 0.0, G.HIDDEN
        for w in split(t):
            gx, gh = p["E"][before] @ p["W"] + p["b"], h @ p["U"]
            zt, rt = sigmoid(gx[:k] + gh[:k]), sigmoid(gx[k : 2 * k] + gh[k : 2 * k])
            h = (1 - zt) * np.tanh(gx[2 * k :] + rt * gh[2 * k :]) + zt * h
            c, place = divmod(number_of[w], G.SIZE)
            for x, j in ((h @ p["Wc"] + p["bc"], c), (h @ p["Ww"][c] + p["bw"][c], place)):
                total += x[j] - x.max() - math.log(np.exp(x - x.max()).sum())
            total += math.log((counts[w] + 1) / z) if number_of[w] == G.OTHER else 0.0
            before = number_of[w]
        assert got[i] == pytest.approx(total / math.log(10), rel=2e-4, abs=1e-3), i


def test_lm_learns_from_all_documents_and_beats_the_base(spark):
    r = random.Random(6)
    follow = {w: [f"w{r.randrange(200)}" for _ in range(3)] for w in (f"w{i}" for i in range(200))}

    def text(n):
        out = ["w0"]
        for _ in range(n):
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, text(80)) for i in range(700)], "doc_id long, text string").repartition(4)
    scored = lambda held: lm_scoring.lm_scores(df.filter(held), F.col("doc_id") < 600, train_docs=60).filter("doc_id >= 600").agg(F.sum("score"), F.sum("base_score")).collect()[0]
    many, few = scored("true"), scored("doc_id < 60 or doc_id >= 600")
    assert many[0] > 0.9 * many[1] and many[0] > few[0]


def test_texts_longer_than_a_slice(spark):
    r = random.Random(9)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(200_000))  # 1.5 MB
    near = long.replace("w1", "v1")
    df = spark.createDataFrame([(1, long), (2, near), (3, long), (4, "short text of a few words only")], "doc_id long, text string")
    assert {x.id: x.class_id for x in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [*library.encode(long, add_special_tokens=False).ids, 0]
    got = {x.doc_id: (x.n_tokens, x.ids_crc32) for x in token_store.token_digests(df).collect()}
    assert got[1] == got[3] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    scores = {x.doc_id: x for x in lm_scoring.lm_scores(df, F.lit(True), train_docs=4, most_tokens=100).collect()}
    assert scores[1].n_tokens == 200_001 and scores[1].score == pytest.approx(scores[3].score) and math.isfinite(scores[1].score)


# -- pipeline ----------------------------------------------------------------------------------------------------------


def make_documents(r):
    letters = "etaoinshrdlu"
    make = lambda n: " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(n))
    leak = make(24)
    rows = [(i, make(60), "en", f"s{i % 4}") for i in range(80)]
    rows += [(80 + i, rows[i][1], "en", "s0") for i in range(6)]
    rows += [(90 + i, " ".join(w if k % 12 else "edit" for k, w in enumerate(rows[10 + i][1].split())), "en", "s1") for i in range(6)]
    rows += [(100 + i, make(20) + " " + leak + " " + make(5), "en", "s2") for i in range(4)]
    rows += [(110, "12 %", None, "s0"), (111, None, "en", None), (112, "", "en", "s1"), (None, make(50), "en", None), (None, make(50), "en", "s3"), (7, make(50), "en", "s3"), rows[3], rows[3]]
    return rows, leak


def test_pipeline_by_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows, leak = make_documents(random.Random(12))
    # columns whose names the stages use themselves
    schema = "doc_id long, text string, lang string, source string, score string, lang_pred string, id int, label string, n int, rid int, place string"
    df = spark.createDataFrame([(*x, "s", "l", 1, "b", 2, 3, "p") for x in rows], schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t, s) for i, t, _, s in rows if t and re.search("[a-z]", t)]
    parent = list(range(len(kept)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    code = [np.array([zlib.crc32(w.encode()) for w in words(t)], np.uint32) for _, t, _ in kept]
    for a in range(len(kept)):
        for b in range(a):
            if distance_within(code[a], code[b], int(0.2 * max(len(code[a]), len(code[b])) + 1e-9)) is not None:
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for a, row in enumerate(kept):
        classes[find(a)].append(row)
    kept = [min(c, key=lambda x: (x[0] is None, x[0])) for c in classes.values()]
    windows = {tuple(words(leak)[k : k + 10]) for k in range(15)}
    kept = [x for x in kept if not any(tuple(words(x[1])[k : k + 10]) in windows for k in range(len(words(x[1])) - 9))]
    sizes = defaultdict(int)
    for _, t, s in kept:
        sizes[s] += len(t.split())
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} or {s: level * weight[s] for s in free}
        free = free - over if over else set()
    order = lambda i, t: hashlib.md5(f"0:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
    mixed = []
    for s in names:
        whole = math.floor(target[s] / sizes[s])
        rest = round(target[s]) - whole * sizes[s]
        for i, t, _ in sorted((x for x in kept if x[2] == s), key=lambda x: order(x[0], x[1])):
            n = len(t.split())
            part = max(0, min(n, rest))
            rest -= part
            mixed += [(i, t)] * math.floor((whole * n + part) / n + 0.5)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, [*library.encode(t, add_special_tokens=False).ids, 0]) for i, t in mixed]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline_without_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lm_takes_the_softmax_of_a_long_tail_at_once(monkeypatch):
    from folioframe.llm import gated_lm as G

    calls, plain = [], getattr(G, "log_likelihoods", None)
    monkeypatch.setattr(G, "log_likelihoods", lambda p, state, target: calls.append(len(target)) or plain(p, state, target), raising=False)
    p, r = G.fresh(500), np.random.default_rng(3)
    counts = np.array([20_000, 1, 30, 300])
    words = r.integers(1, 500, counts.sum())
    words[np.cumsum(counts) - 1] = G.END
    got = G.scores(p, words, counts)
    assert calls == [counts.sum()]  # before: one for each 32 steps, 625
    ends = np.cumsum(counts)
    assert got == pytest.approx([G.scores(p, words[e - n : e], np.array([n]), window=1)[0] for e, n in zip(ends, counts)], rel=1e-4)
