"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import alignment, decontaminate, html_main, language_id, licenses, line_dedup, lm_scoring, mixing, near_dedup, token_store, topk_search
from folioframe.llm.alignment import distance_within
from folioframe.llm.license_rules import rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, id string, label string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = {65 + i: 97 + i for i in range(26)}
PASSAGE = "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn"
LONG = " ".join(f"word{i % 997}x{i // 997}" for i in range(30_000))


def texts():
    base = [
        None, "", " ", "%%% !!!", "one", "A b\nA b\n\n c", f"Intro. {PASSAGE.upper()}, and more words follow here.", PASSAGE, "quick brown fox",
        "Licensed under the MIT license. Licensed under the MIT license.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0; GPL", "Über alles ÉTÉ été", LONG, LONG, LONG.replace("word5x0 ", ""), LONG[: len(LONG) // 2],
        "end <|endoftext|> of text", *[f"shared line\nown {i}\n SHARED LINE \n" for i in range(12)], "sha\tred", "x" * 5000,
        *(f"common start {i} " + " ".join(f"w{(i * 7 + k) % 50}" for k in range(60)) for i in range(6)),
    ]
    return base


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", "é"][i % 4], "clash", "clash", "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[7], (None, "null id text", "en", "b", "c", "c", "c")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(WORD, (t or "").translate(LOW))


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_licences(docs, empty):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(docs).collect())
    want = Counter()
    for i, t in pairs(docs):
        w = words(t)
        hits = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[(i, len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({label for _, label in hits})))] += 1
    assert got == want
    assert licenses.license_scan(empty).count() == 0


def test_licence_rules_resolve_as_brute_force(docs):
    own = {(r.doc_id, tuple((d.first_word, d.end_word, d.rank) for d in r.detections)) for r in licenses.license_scan(docs).collect()}
    for i, t in pairs(docs):
        w = words(t)
        text = "".join(f" {x} " for x in w)
        found = []
        for rule in rules():
            if rule.keyword in text:
                for m in re.finditer(rule.pattern, text):
                    s = text[: m.start()].count("  ") + (m.start() > 0)
                    found.append((s, s + len(m[1].split("  ")), rule.rank))
        kept = sorted((d for d in found if not any(o[2] < d[2] and o[0] <= d[0] and o[1] >= d[1] for o in found)), key=lambda d: (d[0], -d[1], d[2]))
        assert (i, tuple(kept)) in own
    assert len(rules()) >= 200 and len({r.rank for r in rules()}) == len(rules())


def spellings(parsed, most=4000):
    """What a rule's pattern matches, with each alternative and optional part taken both ways."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            new = [chr(arg)]
        elif op == "NOT_LITERAL":
            new = ["x"]
        elif op == "IN":
            new = [chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg]
        elif op == "SUBPATTERN":
            new = spellings(arg[-1], most)
        elif op == "BRANCH":
            new = [x for b in arg[1] for x in spellings(b, most)]
        elif op == "MAX_REPEAT":
            one = spellings(arg[2], most)
            new = [x * arg[0] for x in one] + [x * min(arg[1], arg[0] + 1) for x in one]
        else:
            raise ValueError(op)
        out = [a + b for a in out for b in dict.fromkeys(new)]
        assert len(out) <= most
    return out


def test_keywords_stand_in_all_that_their_rules_match():
    from re import _parser

    lost = {(r.label, r.keyword, x) for r in rules() for x in spellings(_parser.parse(r.pattern)) if r.keyword not in x}
    assert not lost


def test_licences_with_words_between(spark):
    rows = [(1, "It may not be reproduced without the express prior written permission of the owner."), (2, "CreativeML Open RAIL-M")]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "proprietary", 2: "openrail"}


def test_overlapping_phrase_places(spark):
    df = spark.createDataFrame([(1, "a b a b a")], "doc_id int, text string")
    row = licenses.license_scan(df, of=[], phrases=(("a b a", "x"),)).collect()[0]
    assert (row.n_base, row.first_word, row.last_word, row.labels, row.score) == (2, 0, 2, "x", 1.0)


@pytest.mark.parametrize("limit", [10**6, 1])
def test_decontamination(spark, docs, empty, limit):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "quick brown fox"), (3, None), (4, ""), (10, PASSAGE), (1, PASSAGE)], "item_id int, text string")
    grams = defaultdict(set)
    for r in bench.collect():
        w = words(r.text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            grams[tuple(w[k : k + n])].add(str(r.item_id))
    want = Counter()
    for i, t in pairs(docs):
        w, hit, items = words(t), set(), set()
        for g, own in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    items |= own
        want[(i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))] += 1
    found = decontaminate.report(decontaminate.hits(docs, bench, broadcast_rows=limit))
    assert Counter(tuple(r) for r in found.collect()) == want
    assert decontaminate.report(decontaminate.hits(empty, bench)).count() == 0
    nameless = spark.createDataFrame([(None, PASSAGE)], "item_id int, text string")
    row = next(r for r in decontaminate.report(decontaminate.hits(docs, nameless, broadcast_rows=limit)).collect() if r.doc_id == 7)
    assert (row.n_hit, row.n_items, row.contaminated) == (row.n_words, 0, True)
    assert not any(r.contaminated for r in decontaminate.report(decontaminate.hits(docs, bench.limit(0))).collect())


def test_decontaminated_documents_and_spans(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id int, text string")
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()} == {6, 7}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench, mode="spans").collect()}
    assert cut[6] == "Intro. and more words follow here." and cut[7] == "" and cut[0] is None and cut[13] == LONG


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup(docs, empty, keep, limit):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOW)
    rows = pairs(docs)
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add((i, t))
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            first.setdefault(key(line), (i, k))
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 1 and len(seen[key(x)]) >= 10 and not (keep == "first" and first[key(x)] == (i, k)) for k, x in enumerate(lines)]
        want[(i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))] += 1
    bits = line_dedup.drop_bitmaps(docs, keep=keep, broadcast_rows=limit)
    got = line_dedup.apply_bitmaps(docs, bits).select("doc_id", "_n_lines", "_n_dropped", "_kept")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert line_dedup.apply_bitmaps(empty, line_dedup.drop_bitmaps(empty)).count() == 0


def test_line_bits_beyond_one_word(spark):
    rows = [(i, "\n".join(["rare%d_%d" % (i, k) if k % 70 else "often" for k in range(200)])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = line_dedup.apply_bitmaps(df, line_dedup.drop_bitmaps(df, min_docs=3)).collect()
    assert all(r._n_dropped == 3 and r._kept == "\n".join(x for x in dict(rows)[r.doc_id].split("\n") if x != "often") for r in got)


def test_mixing(spark, docs, empty):
    rows = [(r.id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()]
    sizes = defaultdict(int)
    for _, s, n, *_ in rows:
        sizes[s] += n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted((s for s in sizes if s is not None)) + [None])}
    total, target = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    open_ = set(sizes)
    while open_:  # clamp and hand on until nothing is above its cap
        level = (total - sum(target[s] for s in sizes if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over:
            target[s] = 2.0 * sizes[s]
        if not over:
            for s in open_:
                target[s] = level * weight[s]
            break
        open_ -= over
    taken = defaultdict(int)
    for _, s, n, whole, t, k in rows:
        assert whole == sizes[s] and t == pytest.approx(target[s]) and 0 <= k <= 2 * n
        taken[s] += k
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    text = dict(pairs(docs))
    assert all(n == len(re.findall(mixing.WORD, text[i] or "")) for i, _, n, *_ in rows if i is not None)
    assert Counter(rows) == Counter((r.id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert set(mixing.mixed(docs).columns) == set(docs.columns)


def test_near_duplicates(spark, docs, empty):
    got = {r.id: r.class_id for r in near_dedup.near_duplicates(docs.filter("doc_id is not null")).collect()}
    rows = [(i, t, np.array([hash(w) & 0xFFFFFFFF for w in words(t)], np.uint32)) for i, t in sorted(set(pairs(docs.filter("doc_id is not null"))))]
    parent = {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def shingles(t):
        w = words(t)
        return set(zip(*(w[k:] for k in range(5)))) or {tuple(w)}

    for n, (i, t, a) in enumerate(rows):
        for j, u, b in rows[n + 1 :]:
            alike = t == u and t if not len(a) or not len(b) else distance_within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) is not None
            if alike:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
                p, q = shingles(t), shingles(u)
                if len(p & q) >= 0.8 * len(p | q):  # no such pair is lost
                    assert got[i] == got[j], (i, j)
    for i, *_ in rows:
        assert find(got[i]) == find(i), i  # and nothing is joined that alignment would not join
    assert near_dedup.near_duplicates(empty).count() == 0
    stay = near_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == sorted(set(got.values()))
    assert near_dedup.near_duplicates(docs).count() == docs.count()


def test_near_duplicates_with_edits_and_a_common_passage(spark):
    g = np.random.default_rng(3)
    make = lambda n: [f"w{x}" for x in g.integers(0, 10**6, n)]
    passage, rows = make(60), []
    for k in range(40):
        own = make(120) + passage
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(x if g.random() > 0.03 else "edit" for x in own))]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    classes = {r.id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert classes == {i: i - i % 2 for i, _ in rows}


def scattered(g, n, share, k):
    own = [f"w{x}" for x in g.integers(0, 10**6, n)]
    at = set(g.choice(n, max(1, int(n * share)), replace=False).tolist())
    return " ".join(own), " ".join(f"edit{k}x{i}" if i in at else x for i, x in enumerate(own))


def test_near_duplicates_with_scattered_edits(spark):
    """Short texts and those with a tenth of their words replaced are all found; of longer ones with a sixth replaced, which
    leaves a Jaccard similarity of five-word shingles of some 0.25, 64 functions find some 95 in 100."""
    g = np.random.default_rng(5)
    cases = [((6, 10, 25)[k % 3], 0.17) for k in range(60)] + [((60, 100, 300)[k % 3], 0.1) for k in range(60)] + [((60, 100, 300)[k % 3], 0.17) for k in range(90)]
    rows = [(2 * k + j, t) for k, (n, share) in enumerate(cases) for j, t in enumerate(scattered(g, n, share, k))]
    classes = {r.id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(classes[i] == i - i % 2 for i in range(240))
    found = sum(classes[i] == i - 1 for i in range(241, 420, 2))
    assert found >= 0.9 * 90 and all(classes[i] in (i, i - i % 2) for i in classes)


def test_near_duplicates_behind_rejected_hubs(spark):
    from pyspark.sql import types as T

    # one key for all: unrelated texts come first, and the pairs are found behind them
    g = np.random.default_rng(6)
    texts = [g.integers(0, 2**32, 50, dtype=np.uint32) for _ in range(30)]
    near = [np.where(np.arange(50) == 7, np.uint32(1), t) for t in texts[20:]]
    rows = [(1, i, 50, t.tobytes()) for i, t in enumerate([*texts, *near])]
    df = spark.createDataFrame([(k, i, n, bytearray(w)) for k, i, n, w in rows], T.StructType([T.StructField("k", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("w", T.BinaryType())]))
    linker = near_dedup.Linker(df.select("id", F.col("w").alias("words")), 0.8)
    near_dedup.until_settled(linker, df.select("k", "id", "n"))
    assert sorted(map(tuple, linker.labels.filter("v <> label").collect())) == [(30 + i, 20 + i) for i in range(10)]


def test_rows_without_or_with_the_same_id_are_no_duplicates(spark):
    g = np.random.default_rng(8)
    make = lambda n: " ".join(f"w{x}" for x in g.integers(0, 10**6, n))
    texts = [make(40) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:10]] + [(9, texts[0] + " more"), (7, texts[9]), (8, texts[10]), (8, texts[11]), (10, texts[11])]
    stay = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    # a row that has an id stands for its class rather than one that has none
    assert sorted((r.text for r in stay)) == sorted([texts[0] + " more", *texts[1:]])
    assert sum(r.doc_id is None for r in stay) == 4 and sum(r.doc_id == 7 for r in stay) == 5


def test_ids_of_any_type_and_hot_repeats(spark):
    g = np.random.default_rng(8)
    make = lambda n: " ".join(f"w{x}" for x in g.integers(0, 10**6, n))
    texts = [make(40) for _ in range(6)]
    rows = [("b", texts[0], 1), ("a", texts[0] + " more", 2), (None, texts[1], 3), (None, texts[2], 4), (None, None, 5), ("", texts[3], 6), ("x", texts[4], 7), ("x", texts[5], 8)] + [(None, texts[1], 9)] * 40
    df = spark.createDataFrame(rows, "doc_id string, text string, place int")
    got = Counter((r.id, r.rep, r.class_id) for r in near_dedup.near_duplicates(df).collect())
    assert got == {("a", "a", "a"): 1, ("b", "b", "a"): 1, (None, None, None): 43, ("", "", ""): 1, ("x", "x", "x"): 2}
    stay = near_dedup.deduplicated(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id or "-", r.text or "") for r in stay.collect()) == sorted([("a", texts[0] + " more"), ("-", texts[1]), ("-", texts[2]), ("-", ""), ("-", texts[3]), ("x", texts[4]), ("x", texts[5])])


def test_words_that_a_rolling_hash_confuses():
    from folioframe.llm.wordarrays import IN_TOKEN, words_of

    x = "a"
    while len(x) < 4096:
        x += x.translate({97: 98, 98: 97})
    y = x.translate({97: 98, 98: 97})
    h = words_of([f"{x} {y} {x[:-1]} {y[:17]} {x[:17]} {y[:9]} {x[:9]}".encode(), b"a a\0 a\0\0"], IN_TOKEN)[0]
    assert len(set(h.tolist())) == len(h)
    assert words_of([f"Ab {x} aB {x.upper()}".encode()])[0].tolist() == words_of([f"ab {x} ab {x}".encode()])[0].tolist()


def test_banded_distance(monkeypatch):
    g = np.random.default_rng(0)
    for _ in range(500):
        a, b = (g.integers(0, 3, g.integers(0, 12)).astype(np.uint32) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + int(x != y)))
            row = new
        k = int(g.integers(0, 8))
        assert distance_within(a, b, k) == (row[-1] if row[-1] <= k else None)
        monkeypatch.setattr(alignment, "OFTEN", int(g.integers(0, 4)))


def test_token_store(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = pairs(docs)
    enc = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    got = token_store.token_digests(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enc)
    at = 0
    order = sorted(got, key=lambda r: r.start)
    for r in order:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_store.token_digests(empty).count() == 0


def test_token_store_restores_and_notices_damage(spark, docs):
    import public_tokenizers

    from folioframe.llm.common import work_path
    from folioframe.llm.fasttokens import encoder

    path, tokenizer = work_path(spark, "store-test"), public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, path, tokenizer)
    decode = encoder(tokenizer).library.decode
    back = Counter((r.doc_id, decode(r.ids[:-1], skip_special_tokens=False)) for r in token_store.restore(spark, path).collect())
    assert back == Counter((i, t or "") for i, t in pairs(docs))
    chunks = token_store.store_table(spark, path, "chunks", token_store.STAGED.format(id="long")).filter("kind = 'c'")
    assert chunks.count() == chunks.select("key").distinct().count()
    harmed = chunks.withColumn("data", F.expr("concat(data, unhex('0000'))")).limit(1)
    with pytest.raises(Exception, match="damaged"):
        harmed.select("key", "data", "n", "width").mapInArrow(token_store.checked, "key binary, cn long, crc long").collect()


def test_fast_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from folioframe.llm.fasttokens import encoder

    e = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    g = np.random.default_rng(1)
    some = ["".join(g.choice(list("ab1'stlre  \n\t.,-éÜ!"), g.integers(0, 40))) for _ in range(2000)] + ["日本 'a", "x\x00y", "we'reX 'll<|endoftext|>", "\u0085 a"]
    some += ["a<|endoftext|>b", "<|endoftext|>", "", "a" * 17 + "b", "a" * 18, "é" * 40, " " * 33 + "x", ("long text, " * 110_000) + "end", "x" * 70]
    x = "a"
    while len(x) < 4096:  # equal under any rolling hash modulo 2^64
        x += x.translate({97: 98, 98: 97})
    some += [x, x.translate({97: 98, 98: 97}), x[:2048]]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [x.ids for x in plain.encode_batch(some, add_special_tokens=False)]
    assert want[some.index("a<|endoftext|>b")] == [64, 50256, 65]
    for one in some[-3:]:  # each after the others' pieces are known
        assert e.encode([one])[0].tolist() == want[some.index(one)]
    ids, n = e.encode(some)
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_language(spark, docs, empty):
    en = "the weather is fine today and the people are walking in the park with their children and dogs"
    fr = "le temps est beau aujourd hui et les gens se promènent dans le parc avec leurs enfants et chiens"
    train = spark.createDataFrame([(i, x, l) for i, (x, l) in enumerate([(en, "en"), (fr, "fr")] * 20)] + [(99, en, None)], "doc_id int, text string, lang string")
    profiles = language_id.learn(train)
    assert set(profiles) == {"en", "fr"} and all(len(p) <= 300 for p in profiles.values())
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, profiles).collect()}
    assert got[0] == got[1] == got[3] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    probe = spark.createDataFrame([(1, "the children are in the park"), (2, "les enfants sont dans le parc"), (3, "123 456")], "doc_id int, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(probe, profiles).collect()} == {1: "en", 2: "fr", 3: "und"}
    assert language_id.learn(empty) == {} and {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.predict(empty, profiles).count() == 0


def test_language_grams_by_brute_force():
    some = ["Ab c", "", "é!é", "x" * 400]
    got, counts = language_id.grams(some)
    at = 0
    for t, n in zip(some, counts):
        plain = " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " " if re.search(r"[^\W\d_]", t) else ""
        one = [c for c in plain if c != " "]
        two = [plain[i : i + 2] for i in range(len(plain) - 1) if plain[i : i + 2].strip()]
        three = [plain[i : i + 3] for i in range(len(plain) - 2) if plain[i + 1] != " "]
        unpack = lambda g: "".join(" " if v == 1 else chr(v - 1) for v in ((g >> 42) & 0x1FFFFF, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if v)
        assert Counter(unpack(int(g)) for g in got[at : at + n]) == Counter(one + two + three)
        at += n


@pytest.mark.parametrize("block_rows, summaries", [(512, 1024), (7, 3)])
def test_topk(spark, block_rows, summaries):
    g = np.random.default_rng(5)
    rows = [(i, [float(v) for v in g.normal(0, 0.2, 6)], "clash", 1) for i in range(300)] + [(1000 + i, [0.5] * 6, "c", 1) for i in range(60)]
    rows += [(2000, None, "", 1), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], "", 1), (2040, [float("nan")] * 6, "", 1), (2060, [float("inf")] * 6, "", 1), (2080, [], "", 1), (40, rows[40][1], "", 1), (3000, [1.0, 2.0], "", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int")
    good = [(i, [math.floor(64 * float(np.float32(v))) for v in x]) for i, x, *_ in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    want = Counter()
    for i, q in {(i, tuple(x)) for i, x in good if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in good if j != i and len(x) == len(q))[:20]
        want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    got = Counter(tuple(r) for r in topk_search.top_k(df, pivots=4, block_rows=block_rows, summaries=summaries).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_topk_huge_components_and_ids_with_several_vectors(spark):
    rows = [(0, [1e30, 1.0]), (0, [0.0, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 5.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    big = 2**63 - 1
    assert got == sorted([(0, 1, 1, big), (0, 2, 3, 2**53 * 64 + 64 * 64), (0, 3, 2, -big - 1), (0, 1, 2, 5 * 64 * 64), (0, 2, 1, 2 * 64 * 64), (0, 3, 3, 64 * 64)])


def test_topk_visits_fewer_blocks_than_there_are(spark, monkeypatch):
    g = np.random.default_rng(4)
    centres = g.normal(0, 2, (16, 8))
    rows = [(i, [float(x) for x in centres[i % 16] + g.normal(0, 0.05, 8)]) for i in range(3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept, lists = topk_search.drop_all, []
    monkeypatch.setattr(topk_search, "drop_all", lambda *t: lists.extend(x.count() for x in t if "bound" in x.columns) or kept(*t))
    topk_search.top_k(df, block_rows=20, k=5).count()
    assert lists and lists[0] < 0.3 * 160 * 160  # queries times blocks


def test_topk_large_numbers():
    a = np.array([[2**40, 3], [1, 2**31]], np.int64)
    assert topk_search.products(a[:, :1] // 2**10, a[:, :1] // 2**10).tolist() == [[2**60, 0], [0, 0]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body><!-- no -->
<nav><ul><li><a href="/">Home</a><li>Menu</ul></nav><div class="ad banner">Buy &amp; buy</div><div id=cookie-notice>We use cookies</div>
<article><h1>A &lt;title&gt; here</h1><p>First   paragraph,
 with <b>bold</b> and a <a href="x">link</a>.<p>Second&nbsp;one; it ends.<br>New line.</p><ul><li>item one<li>item two</ul><table><tr><td>cell<td>other</table>
<aside>Related</aside><form>Name <input></form></article><section class="comments"><p>Nice, really nice!</p></section><footer>&copy; us</footer></body>"""


def test_html(spark):
    assert html_main.main_text(PAGE) == "A <title> here\nFirst paragraph, with bold and a link.\nSecond\xa0one; it ends.\nNew line.\nitem one\nitem two\ncell\nother"
    cases = [(1, PAGE), (2, None), (3, ""), (4, "plain text"), (5, "<p>a</p></div></p><p>b"), (6, "<" * 3000), (7, "<div>" * 3000 + "deep, very deep text." + "</div>" * 3000), (8, '<p title="a>b">x</p>'), (9, "<script>never ends")]
    df = spark.createDataFrame([(i, "u", h, "clash") for i, h in cases], "page_id int, url string, html string, text string")
    got = {r.page_id: r for r in html_main.extract(df).collect()}
    assert [got[i].text for i in (2, 3, 4, 5, 7, 8, 9)] == ["", "", "plain text", "a\nb", "deep, very deep text.", "x", ""]
    assert all(r.n_chars == len(r.text) for r in got.values()) and html_main.extract(df.limit(0)).count() == 0


def test_html_keeps_all_parts_of_an_article():
    line = "A sentence of the article, with some words and marks; it goes on, and ends."
    part = lambda n, k: "<h2>Part</h2>" + "".join(f"<p>{i} {line}</p>" for i in range(k, k + n))
    for page in (f"<body><article><section>{part(6, 0)}</section><section>{part(4, 6)}</section></article></body>", f"<body><section>{part(6, 0)}</section><section>{part(4, 6)}</section></body>"):
        got = html_main.main_text(page).split("\n")
        assert [x for x in got if x != "Part"] == [f"{i} {line}" for i in range(10)]
    got = html_main.main_text(f"<body><div><p>a {line}</p><p>b {line * 9}<br>c {line * 9}</p><p>d {line}</p></div></body>").split("\n")
    assert [x[0] for x in got] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("name", ["class='container with-sidebar'", "class='post tag-news'", "id='related-work'", "class='entry no-comments'", "class='widget'"])
def test_html_names_of_wrappers(name):
    line = "A sentence of the article, with some words and marks; it goes on, and ends."
    got = html_main.main_text(f"<body><div class='sidebar-left'><p>Aside, and short.</p></div><div {name}>" + f"<p>{line}</p>" * 5 + "</div><div id='comments'><p>Nice, really nice!</p></div></body>")
    assert got == "\n".join([line] * 5)


def test_html_small_section_with_a_listed_word():
    line = "A sentence of the article, with some words and marks; it goes on, and ends."
    got = html_main.main_text(f"<body><article>{f'<p>{line}</p>' * 5}<section id='related-work'><p>Others, too, did this.</p></section></article></body>")
    assert got.endswith("Others, too, did this.")


@pytest.mark.parametrize("head", [10**6, 8])
def test_lm(spark, docs, empty, head):
    marked = docs.withColumn("held_out", F.coalesce(language_id.remainder(F.col("doc_id"), 7) == 2, F.lit(False)))
    got = lm_scoring.lm_scores(marked, ~F.col("held_out"), keep=("held_out",), head=head, train_docs=30).collect()
    rows = [(i, t, i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in pairs(docs)]
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "\n"]
    c = Counter(w for _, t, out in rows if not out for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out, len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 4)) for i, t, out in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if head == 8:
        whole = lm_scoring.lm_scores(marked, ~F.col("held_out"), keep=("held_out",), train_docs=30).collect()
        assert sorted(round(r.score, 2) for r in got) == sorted(round(r.score, 2) for r in whole)
        assert lm_scoring.lm_scores(empty, F.lit(True)).count() == 0


def test_lm_is_a_distribution_and_carries_state():
    from folioframe.llm import gated_lm as G

    g = np.random.default_rng(2)
    seen = [np.append(np.tile([2, 3, 4, 5], 30), G.END) for _ in range(40)]
    p = G.train(seen, 6, epochs=2)
    one = [np.array([w, G.END]) for w in range(1, 6)] + [np.array([G.END])]
    first = [G.scores(p, np.array([w]), np.array([1]))[0] for w in range(6)]
    assert sum(np.exp(first)) == pytest.approx(1, abs=1e-4) and len(one) == 6
    long = np.append(g.integers(2, 6, 300), G.END)
    assert G.scores(p, long, np.array([301]), window=7)[0] == pytest.approx(G.scores(p, long, np.array([301]), window=400)[0], rel=1e-4)
    good, bad = seen[0], np.append(np.tile([5, 2, 4, 3], 30), G.END)
    s = G.scores(p, np.concatenate([good, bad]), np.array([121, 121]))
    assert s[0] > s[1]


def test_lm_gradients(monkeypatch):
    from folioframe.llm import gated_lm as G

    monkeypatch.setattr(G, "F32", np.float64)
    g = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in G.fresh(1000).items()}
    x, y, h = g.integers(0, 60, (4, 3)), g.integers(0, 1000, (4, 3)), g.normal(0, 0.3, (3, G.HIDDEN))
    grads = G.window_gradients(p, x, y, h)[1]
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        held = p[k][at]
        p[k][at] = held + 1e-5
        up = G.window_gradients(p, x, y, h)[0]
        p[k][at] = held - 1e-5
        assert (up - G.window_gradients(p, x, y, h)[0]) / 2e-5 == pytest.approx(grads[k][at], rel=1e-4)
        p[k][at] = held


def test_components(spark):
    from folioframe.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300)] + [(500, 500 + i) for i in range(1, 30)]
    for few in (10_000, 0):
        got = {r.v: r.label for r in components(spark.createDataFrame(chain, "a long, b long"), few=few).collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100} | {500 + i: 500 for i in range(30)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    g = np.random.default_rng(9)
    make = lambda n: " ".join("".join(g.choice(list("etaoinshr"), 6)) for _ in range(n))
    leak = make(30)
    rows = [(i, make(80), "en", "abc"[i % 3], 0) for i in range(30)]
    rows += [(30, rows[0][1], "en", "a", 0), (31, rows[1][1] + " extra", "en", "b", 0), (32, make(20) + " " + leak, "en", "c", 0), (33, "!!! 123", None, "a", 0), (34, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "t")
        seen[name] = [r.doc_id for r in docs.collect()]
        assert docs.columns == columns
    assert set(seen["language"]) == set(range(33)) and set(seen["near_dedup"]) == set(range(30)) | {32} and set(seen["decontaminate"]) == set(range(30))
    assert max(Counter(seen["mix"]).values()) <= 2 and len(seen["mix"]) > 30
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in final) == Counter(seen["mix"]) and {r.start for r in final} >= {0}
