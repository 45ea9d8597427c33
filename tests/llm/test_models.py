"""Near-duplicates, language identification, language model, fingerprints, pipeline."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import fingerprints, language_id, maxent_lm, near_dedup


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_classes_are_those_of_all_similar_pairs(spark):
    """Brute force: weighted Jaccard of all pairs, with the same document frequencies."""
    docs = documents(spark)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in near_dedup.query(spark, SF).collect()}
    idf = near_dedup.inverse_frequencies(*near_dedup.document_frequencies(table))
    bags = {}
    for i, r in docs.items():
        found, weights = near_dedup.weighted(" ".join(r["text"].split()).encode(), idf)
        bags[i] = dict(zip(found.tolist(), weights.tolist(), strict=True))
    ids, root = sorted(docs), {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = bags[a], bags[b]
            low = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            if low >= 0.8 * (sum(x.values()) + sum(y.values()) - low) - 1e-9:
                root[max(top(a), top(b))] = min(top(a), top(b))
            if docs[a]["text"].split() == docs[b]["text"].split():
                assert got[a]["copy_id"] == got[b]["copy_id"]
    assert {i: got[i]["class_id"] for i in ids} == {i: top(i) for i in ids}


def test_rows_that_share_an_id(spark):
    rows = [(1, "one text of its own that stays alone here"), (1, "another text with the same id as the first one"), (1, "another text  with the same id as the first one"), (2, "one text of its own that stays alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.classes(docs).collect()) == [(1, 1, 1)] * 3 + [(2, 1, 1)]
    kept = [" ".join(r["text"].split()) for r in near_dedup.representatives(docs).collect()]
    assert sorted(kept) == sorted([rows[0][1], rows[1][1]])


def test_samples_meet_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 300).astype(np.uint64)
    hits = []
    for _ in range(60):
        a = np.sort(np.concatenate([common, rng.integers(0, 2**63, 60).astype(np.uint64)]))
        b = np.sort(np.concatenate([common, rng.integers(0, 2**63, 60).astype(np.uint64)]))
        x, y = (near_dedup.sample(s, np.full(len(s), 3.0, np.float32)) for s in (a, b))
        hits.append((x == y).mean())
    assert abs(np.mean(hits) - 300 / 420) < 0.04


def test_a_hot_group_of_near_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*words[: k % 100 + 5], f"edit{k}", *words[k % 100 + 6 :]])) for k in range(300)] + [(1000 + k, f"other {k} text number {k} with words {k * 7} of its {k * 3} own") for k in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(300)} == {0} and len({got[1000 + k] for k in range(50)}) == 50


def test_pairs_within_a_hot_bucket_are_found(spark):
    """Texts that share a long passage and lie just below the limit; eight planted pairs share half of the rest too."""
    passage = [f"p{i}" for i in range(180)]
    rows = [(k, " ".join([*passage, *(f"{k // 2 if k < 16 else k}own{i}" for i in range(14)), *(f"{k}rest{i}" for i in range(10))])) for k in range(600)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: k - k % 2 if k < 16 else k for k in range(600)}


def test_components_and_roots(spark):
    """A hub, a long path, a circle, random links in both directions and repeated; trees of several depths."""
    rng = np.random.default_rng(2)
    links = [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 640)] + [(700, 701), (701, 702), (702, 700), (701, 700)] + [(int(a), int(b)) for a, b in rng.integers(0, 200, (140, 2)) if a != b]
    root = {x: x for link in links for x in link}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    name = "{:05d}".format
    frame = lambda rows: spark.createDataFrame([(name(a).encode(), name(b).encode()) for a, b in rows], "a binary, b binary").repartition(3)
    labels = lambda found: {int(r["node"]): int(r["label"]) for r in found.collect()}
    assert labels(near_dedup.components(frame(links))) == {x: top(x) for x in root}
    up = [(k, k // 3) for k in range(1, 60)] + [(k, k - 1) for k in range(101, 130)]
    assert labels(near_dedup.roots(frame(up))) == {k: 0 if k < 60 else 100 for k, _ in up}


def test_near_dedup_runs_few_tasks(spark):
    """Each task of a shuffle leaves files: with hundreds of partitions they and the event log, not rows, fill the disk."""
    rows = [(k, " ".join(["common", *(f"g{k // 6}w{i}" for i in range(40)), *(f"e{k}x{i}" for i in range(k % 6 // 2))])) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few tasks", "few tasks")
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    finally:
        sc._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: k - k % 6 for k in range(240)}
    stages = {i for j in sc.statusTracker().getJobIdsForGroup("few tasks") for i in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for i in stages if (x := sc.statusTracker().getStageInfo(i)))
    assert 0 < tasks < 1400


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    idf = near_dedup.inverse_frequencies(rng.integers(0, 1000, 1 << near_dedup.FEATURE_BITS), 1000)
    for n in (1, 4, 5, 40, 300):
        for _ in range(40):
            common = rng.integers(0, 2**64, n, dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, rng.integers(0, 2**64, rng.integers(0, n // 8 + 1), dtype=np.uint64)])) for _ in "ab"]
            a, b = ((x, rng.integers(1, 3, len(x)).astype(np.float32) * idf[(x >> np.uint64(64 - near_dedup.FEATURE_BITS)).astype(np.int64)]) for x in sets)
            if near_dedup.similarity(a, b) >= near_dedup.SIMILARITY:
                (x, left), (y, other) = near_dedup.prefix(*a, idf), near_dedup.prefix(*b, idf)
                assert len(np.intersect1d(x, y))
                i = int(np.isin(x, y).argmax())  # the first common shingle
                common = min(left[i], other[int(np.flatnonzero(y == x[i])[0])])
                assert common >= 0.8 / 1.8 * (a[1].sum(dtype=float) + b[1].sum(dtype=float)) * (1 - 1e-5)


def test_near_dedup_odd_rows(odd, empty, clashing):
    got = near_dedup.classes(odd.select("doc_id", "text")).collect()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == 11 and by[1] == by[5] == by[7] == 1 and by[2] == by[3] == by[6] == 2 and by[None] < 0
    kept = near_dedup.representatives(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(set(by.values()))
    assert near_dedup.classes(empty.select("doc_id", "text")).count() == 0


def test_language_held_out_accuracy(spark):
    docs = documents(spark)
    got = language_id.query(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(odd, empty, clashing):
    model = language_id.train(clashing)
    got = {r["doc_id"]: r for r in language_id.predict(odd, model, ["doc_id"]).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[6]["lang_pred"] == "und" and got[4]["lang_pred"] in ("en", "de") and len(language_id.predict(odd, model, ["doc_id"]).collect()) == 11
    nothing = language_id.train(empty)
    assert all(r["lang_pred"] == "und" for r in language_id.predict(odd, nothing, ["doc_id"]).collect()) and language_id.predict(empty, model, ["doc_id"]).count() == 0


def test_more_than_two_hundred_languages(spark):
    """Each language has letters of its own; all are learnt and predicted, also when features are folded."""
    name = lambda k: f"q{k:03d}"
    text = lambda k, j: " ".join(chr(0x4E00 + 11 * k + (i * 3 + j) % 11) * (1 + i % 3) for i in range(30))
    rows = [(1000 * k + j, text(k, j), name(k)) for k in range(230) for j in range(5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [name(k) for k in range(230)] and model.weights.size <= language_id.WEIGHTS + 230
    assert np.mean([model.predict(text(k, 7))[0] == name(k) for k in range(230)]) > 0.9


def test_language_scores_by_a_plain_scorer(spark):
    """The same weights through dictionaries and loops."""
    docs = documents(spark)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(table.select("doc_id", "text", "lang"))
    for text in [docs[i]["text"] for i in sorted(docs)[:12]] + ["a", "", "1 2"]:
        solid = " ".join(["", *re.findall(r"[^\W\d_]+", text.lower()), ""]) if re.search(r"[^\W\d_]", text) else None
        want = model.predict(text)
        if solid is None:
            assert want == ("und", 0.0)
            continue
        solid = solid if not text[-1:].isalpha() else solid[:-1]
        counts = Counter()
        for n in (1, 2, 3):
            for i in range(len(solid) - n + 1):
                h = 0
                for c in solid[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
                counts[int(language_id._feature(np.array([h], np.uint64), n)[0])] += 1
        x = {k: v * model.idf[k] for k, v in counts.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        logits = [(sum(v / length * float(model.weights[k][j]) for k, v in x.items()) + float(model.weights[-1][j])) / model.heat for j in range(len(model.languages))]
        e = [math.exp(v - max(logits)) for v in logits]
        best = max(range(len(e)), key=lambda j: e[j])
        assert want[0] == model.languages[best] and abs(want[1] - e[best] / sum(e)) < 1e-4


def test_equally_likely_languages_go_to_the_first_by_name():
    model = language_id.Model(["aa", "bb"], np.ones(1 << language_id.FEATURE_BITS), np.zeros(((1 << language_id.FEATURE_BITS) + 1, 2)), 1.0)
    assert model.predict("word") == ("aa", 0.5)


def test_grams_don_t_depend_on_blocks(monkeypatch):
    text = "Abc déf, x1 " * 300
    whole = language_id.counts_of(text)
    monkeypatch.setattr(language_id, "BLOCK", 17)
    assert (language_id.counts_of(text) == whole).all()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def check_base(rows, docs):
    train = Counter()
    for i, t in docs:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            train.update([*words(t), "\n"])
    n, v = sum(train.values()), len(train)
    want = sorted((len(ws), sum(train[w] > 0 for w in ws), round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for ws in ([*words(t), "\n"] for _, t in docs))
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want and {r["train_tokens"] for r in rows} == {n}


def test_lm_base_by_brute_force_and_gain(spark, monkeypatch):
    docs = [(i, r["text"]) for i, r in documents(spark).items()]
    for hot in (1 << 18, 200):
        monkeypatch.setattr(maxent_lm, "HOT", hot)
        got = maxent_lm.query(spark, SF).collect()
        check_base(got, docs)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def small_model(monkeypatch, words, hot):
    """A model trained on a few texts, and the counts of their tokens."""
    monkeypatch.setattr(maxent_lm, "STEP_TOKENS", 64)
    rng = np.random.default_rng(0)
    texts = [" ".join(words[int(i)] for i in np.minimum(rng.geometric(0.05, 40) - 1, len(words) - 1)) for _ in range(60)]
    counts = Counter(int(h) for t in texts for h in maxent_lm.tokens(t))
    kept = sorted(h for h, _ in counts.most_common(hot))
    rest = {}
    for h, c in counts.items():
        if h not in kept:
            n, v = rest.get((h >> 40) % maxent_lm.SLOTS, (0, 0))
            rest[(h >> 40) % maxent_lm.SLOTS] = n + c, v + 1
    model = maxent_lm.Model(np.array(kept, np.uint64), np.array([counts[h] for h in kept]), rest)
    model.begin()
    model.steps([maxent_lm.tokens(t) for t in texts], 0.3)
    return model, counts, rest, texts


def plain_log10(model, rest, counts, tokens, i):
    """log10 P of a token of a text by loops over the same weights."""
    one, two = (tokens[i - 1] if i else 1), (tokens[i - 2] if i > 1 else 1)
    mixed = lambda x: int(maxent_lm.mix(np.array([x % 2**64], np.uint64))[0])
    features = [mixed(one), mixed(one * 3 + two), mixed(two ^ 0x5DEECE66D)]
    at = {int(h): k for k, h in enumerate(model.hot)}
    h = tokens[i]
    kind, slot = (int(model.kinds[at[h]]), int(model.slots[at[h]])) if h in at else (maxent_lm.CLASSES - 1, (h >> 40) % maxent_lm.SLOTS)
    total = 0.0
    for layer, rows, condition, wanted in (
        (model.classes, [f >> 50 for f in features], 0, kind),
        (model.members, [mixed(f + kind * 0x9E3779B97F4A7C15) >> 50 for f in features], kind, slot),
    ):
        x = [sum(float(layer.weights[r][j]) for r in rows) + float(layer.bias[condition][j]) for j in range(layer.weights.shape[1])]
        total += x[wanted] - max(x) - math.log(sum(math.exp(v - max(x)) for v in x))
    total /= math.log(10)
    if h in at:
        same = sum(int(model.hot_counts[k]) for k in range(len(model.hot)) if (model.kinds[k], model.slots[k]) == (kind, slot))
        return total + math.log10(counts[h] / same)
    n, v = rest.get(slot, (0, 0))
    return total + math.log10((counts.get(h, 0) + 0.5) / (n + 0.5 * (v + 1)))


def test_lm_probabilities_sum_to_one(monkeypatch):
    for words, hot in ((["a", "b", "c"], 3), ([f"w{i}" for i in range(120)], 60), ([f"w{i}" for i in range(120)], 0)):
        model, counts, rest, texts = small_model(monkeypatch, words, hot)
        before = [int(h) for h in maxent_lm.tokens(texts[0])[:5]]
        seen = sum(10 ** plain_log10(model, rest, counts, [*before, h], 5) for h in counts)
        # the half count of each cold slot is for what no training text holds
        unseen = 0.0
        for slot in range(maxent_lm.SLOTS):
            h = next(x for x in (slot << 40 | k for k in range(1, 99)) if x not in counts)
            unseen += 10 ** plain_log10(model, rest, counts, [*before, h], 5)
        assert abs(seen + unseen - 1) < 1e-4, (hot, seen, unseen)


def test_lm_scores_by_plain_loops(spark):
    """The query's model again through loops, for some texts; and the same scores from other partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    models = []
    plain = maxent_lm.scored

    def kept(docs, model, counts, total, distinct):
        models.append((model, {r["h"] % 2**64: r["c"] for r in counts.collect()}))
        return plain(docs, model, counts, total, distinct)

    maxent_lm.scored = kept
    try:
        got = {r["doc_id"]: r for r in maxent_lm.train_and_score(docs.repartition(3)).collect()}
        again = {r["doc_id"]: r for r in maxent_lm.train_and_score(docs.coalesce(1)).collect()}
    finally:
        maxent_lm.scored = plain
    assert all(abs(got[i]["score"] - again[i]["score"]) < 1e-6 for i in got) and (models[0][0].flat() == models[1][0].flat()).all()
    model, counts = models[0]
    hot, rest = {int(h) for h in model.hot}, {}
    for h, c in counts.items():
        if h not in hot:
            n, v = rest.get((h >> 40) % maxent_lm.SLOTS, (0, 0))
            rest[(h >> 40) % maxent_lm.SLOTS] = n + c, v + 1
    for r in sorted(docs.collect(), key=lambda r: len(r["text"]))[5:60:18]:
        h = [int(x) for x in maxent_lm.tokens(r["text"])]
        assert got[r["doc_id"]]["score"] == pytest.approx(sum(plain_log10(model, rest, counts, h, i) for i in range(len(h))), abs=1e-3)


def test_lm_features_of_short_texts_by_plain_loops():
    rng = np.random.default_rng(1)
    for sizes in ([1], [2], [1, 1, 2, 1], [3, 1, 1], [2, 3, 5, 1], [7, 2]):
        texts = [rng.integers(1, 2**63, n).astype(np.uint64) for n in sizes]
        want = []
        for t in texts:
            h = [1, 1, *map(int, t)]
            want += [[h[i - 1], (h[i - 1] * 3 + h[i - 2]) % 2**64, h[i - 2] ^ 0x5DEECE66D] for i in range(2, len(h))]
        got = maxent_lm.contexts(np.concatenate(texts), maxent_lm.starts_of(np.array(sizes)))
        assert (got == maxent_lm.mix(np.array(want, np.uint64).T)).all(), sizes


def test_lm_sums_of_gradients_by_plain_loops():
    rng = np.random.default_rng(2)
    kinds = {"one": np.zeros(3000), "single": np.array([5]), "distinct": rng.permutation(3000), "frequent": np.minimum(rng.zipf(1.3, 3000), 16_383), "even": rng.integers(0, 300, 3000)}
    for name, at in kinds.items():
        at = at.astype(np.int64)
        x = rng.standard_normal((len(at), 32)).astype(np.float32)
        want = {}
        for i, k in enumerate(at.tolist()):
            want[k] = want.get(k, 0) + x[i].astype(np.float64)
        own, got = maxent_lm.sums_by_place(x, at)
        assert sorted(own.tolist()) == sorted(want) and np.allclose(got, [want[k] for k in own.tolist()], atol=1e-3), name


def test_lm_probabilities_beyond_the_range_of_exponentials(monkeypatch):
    """Sums of weights far above or below: the same probabilities and steps as at zero."""
    rng = np.random.default_rng(3)
    rows, none, wanted = rng.integers(0, maxent_lm.FEATURES, (3, 500)), np.zeros(500, np.int64), rng.integers(0, 32, 500)
    got = []
    for far in (0.0, 500.0, -500.0):
        layer = maxent_lm.Layer(1, 32)
        layer.begin()
        layer.bias[0] = np.linspace(-3, 0, 32) + far
        logs = layer.logs(rows, none, wanted)
        layer.step(rows, none, wanted, 0.3)
        got.append((logs, layer.weights))
    assert np.isfinite(got[0][0]).all() and all(np.allclose(x, y, atol=1e-4) for other in got[1:] for x, y in zip(got[0], other, strict=True))


def test_lm_step_takes_less_than_segment_sums_alone(spark):
    """A whole gradient step against nothing but sums of sorted rows by np.add.reduceat, as often as the step needs them."""
    rng = np.random.default_rng(4)
    n = maxent_lm.STEP_TOKENS
    found = [maxent_lm.tokens(r["text"]) for _, r in sorted(documents(spark).items())]
    features = maxent_lm.contexts(np.concatenate(found), maxent_lm.starts_of(np.array([len(x) for x in found])))[:, :n]
    assert features.shape == (3, n)
    kinds, wanted = rng.integers(0, 32, n), rng.integers(0, 32, n)
    rows = maxent_lm.slot_rows(features, kinds)
    layer, x = maxent_lm.Layer(32, 32), rng.standard_normal((n, 32)).astype(np.float32)
    layer.bias[:] = 0
    layer.begin()

    def segments():
        for at in (*rows, kinds):
            order = np.argsort(at.astype(np.uint16), kind="stable")
            np.add.reduceat(x.take(order, 0), np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)

    def least(f):
        took = []
        for _ in range(15):
            begin = time.process_time()
            f()
            took.append(time.process_time() - begin)
        return min(took)

    assert least(lambda: layer.step(rows, kinds, wanted, 0.01)) < least(segments)


def test_lm_of_tokens_that_are_all_equally_frequent(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HOT", 64)
    counts = spark.range(400).select(F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("c"))
    h, c = maxent_lm.hot_tokens(counts)
    assert 10 <= len(h) <= 64 and (np.diff(h.astype(np.float64)) > 0).all() and (c == 1).all()


def test_lm_odd_rows(odd, empty):
    fold = ((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == 1).alias("held_out")
    got = maxent_lm.train_and_score(odd.select("doc_id", "text", fold)).collect()
    check_base(got, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert len(got) == 11 and maxent_lm.train_and_score(empty.select("doc_id", "text", fold)).count() == 0


def check_fingerprints(rows, docs):
    parts = lambda t: {p for p in re.findall(fingerprints.PARAGRAPH, t) if re.search(r"[^\x20\x09-\x0D]", p)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for k, (_, t) in enumerate(docs):
        follows = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + follows[: len(t) // 2]
        want.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(parts(t), parts(edited)), 9), round(like(parts(t), parts(follows)), 9)))
    assert sorted((r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows) == sorted(want)


def test_fingerprints_by_brute_force(spark):
    check_fingerprints(fingerprints.query(spark, SF).collect(), sorted((i, r["text"]) for i, r in documents(spark).items()))


def test_fingerprints_over_many_ranges_and_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    plain = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = fingerprints.fingerprinted(fingerprints.with_next(odd)).collect()
    check_fingerprints(got, plain)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 5, 7)}) == 1
    assert fingerprints.fingerprinted(fingerprints.with_next(empty)).count() == 0
    assert fingerprints.fingerprinted(fingerprints.with_next(odd.filter("doc_id = 1"))).first()["near_next"] == 1.0


def test_sketches_peel_what_differs(spark):
    rng = np.random.default_rng(3)
    a = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    b = a[4:] + [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 3)]
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    found = df.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))), F.lit(24)).alias("f")).first()["f"]
    assert set(found) == set(a) ^ set(b)
    many = spark.createDataFrame([(a, [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)])], "a array<long>, b array<long>")
    f, d = many.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))), F.lit(24)), fingerprints.different(F.col("a"), F.col("b"))).first()
    assert f is None and d == 80


def test_lm_and_fingerprints_with_clashing_columns(odd, clashing):
    fold = ((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == 1).alias("held_out")
    pick = lambda df: maxent_lm.train_and_score(df.select("doc_id", "text", fold))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(pick(clashing).select("doc_id", "n_tokens", "n_known", "base_score")) == key(pick(odd).select("doc_id", "n_tokens", "n_known", "base_score"))
    of = lambda df: fingerprints.fingerprinted(fingerprints.with_next(df.select("doc_id", "text"))).select("doc_id", "fingerprint", "near_edited", "near_next")
    assert key(of(clashing)) == key(of(odd))
