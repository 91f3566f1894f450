"""Links under keys that many unrelated texts share."""

import random

import numpy as np

from folioframe.llm import near_dedup
from folioframe.llm.alignment import distance_within


def test_no_pair_under_a_key_of_many_texts_is_left_out(spark):
    r = random.Random(4)
    passage, texts = [r.randrange(1 << 32) for _ in range(40)], {}
    for i in range(30):
        own = [r.randrange(1 << 32) for _ in range(r.randint(40, 200))]
        texts[2 * i] = passage + own
        near = list(own)
        for at in r.sample(range(len(own)), int(0.19 * len(own))):
            near[at] = r.randrange(1 << 32)
        texts[2 * i + 1] = passage + near
    members = spark.createDataFrame([(7, 0, i, len(t)) for i, t in texts.items()], "k long, f int, id long, n long")
    table = spark.createDataFrame([(i, bytearray(np.array(t, np.uint32).tobytes())) for i, t in texts.items()], "id long, words binary")
    labels = {x.v: x.label for x in near_dedup.link_all(members, table, 0.8).labels.collect()}
    assert labels == {i: i - i % 2 for i in texts}


def test_alike_texts_share_a_rare_pair():
    r = random.Random(5)
    for _ in range(300):
        a = np.array([r.randrange(30) for _ in range(r.randint(5, 60))], np.uint32)
        b = list(a)
        for _ in range(int(0.2 * len(a))):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 1)] = [r.randrange(30)] * r.randint(0, 1)
        b = np.array(b, np.uint32)
        if distance_within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) is None or (a.shape == b.shape and (a == b).all()):
            continue
        shown = []
        for x in (a, b):
            h = np.sort(near_dedup.pair_hashes(x.tobytes()))
            shown.append(set(h[: len(h) - near_dedup.least_shared(len(x), 0.8) + 1].tolist()))
        assert shown[0] & shown[1]


def test_pipeline_stage_keeps_one_of_each_pair_behind_a_passage(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(near_dedup, "FEW", 2)
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(7))
    passage, rows = [word() for _ in range(60)], []
    for i in range(12):
        own = [word() for _ in range(60)]
        near = [word() if k % 6 == 3 else w for k, w in enumerate(own)]
        rows += [(2 * i, " ".join(passage + own), "en"), (2 * i + 1, " ".join(passage + near), "en")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(x.doc_id for x in out.collect()) == [2 * i for i in range(12)]


def test_texts_that_are_mostly_two_words_are_compared_without_a_join_of_all(spark, monkeypatch):
    r = random.Random(7)
    texts = {i: [r.randrange(1 << 32) for _ in range(r.randint(12, 60))] + [1, 2] * 40 for i in range(160)}
    for i in range(0, 160, 8):
        texts[i + 1] = [*texts[i][:-6], 5, 6]
    alike = {i: i for i in texts}
    for a in texts:
        for b in range(a):
            if distance_within(np.array(texts[a]), np.array(texts[b]), int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9)) is not None:
                low, high = sorted((alike[a], alike[b]))
                alike = {k: low if v == high else v for k, v in alike.items()}
    assert 50 < len(set(alike.values())) < 150
    joined, met = [], near_dedup.met_hubs
    monkeypatch.setattr(near_dedup, "met_hubs", lambda *a: joined.append(met(*a)) or joined.append(joined.pop().localCheckpoint()) or joined[-1])
    members = spark.createDataFrame([(7, 0, i, len(t)) for i, t in texts.items()], "k long, f int, id long, n long")
    table = spark.createDataFrame([(i, bytearray(np.array(t, np.uint32).tobytes())) for i, t in texts.items()], "id long, words binary")
    labels = {x.v: x.label for x in near_dedup.link_all(members, table, 0.8).labels.collect()}
    assert {i: labels.get(i, i) for i in texts} == alike
    assert sum(x.count() for x in joined) < 8 * len(texts)


def test_blocks_hold_every_pair_that_may_be_alike():
    r = random.Random(8)
    dealt = near_dedup.blocks_of({c: r.randrange(1, 10**6) for c in range(45)}, 0.8)
    assert all(k >= 1 for k in dealt.values())
    width = np.log(1 / 0.8) + 1e-6
    for n in range(1, 30000):
        m = n - int(0.2 * n + 1e-9)
        assert np.floor(np.log(n) / width) - np.floor(np.log(m) / width) <= 1
