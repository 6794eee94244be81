"""Operators that learn: against plain code where there is one, else by held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from pagetide.llm import language, lm_score, queries, toxicity
from tests.llm.conftest import SF_DIR

LARGER = "/root/testdata/sf0.01"


def plain_phrases(text, sample):
    count = 0
    for k in range(0, len(text), language.SEGMENT):
        part, at = text[k : k + language.SEGMENT], 0
        while at < len(part):
            end = at + 1
            while end < len(part) and part[at : end + 1] in sample:
                end += 1
            count, at = count + 1, end
    return count


def test_cross_parsing_counts_longest_matches():
    rng = random.Random(2)
    samples = tuple((lang, bytes(rng.choice(letters) for _ in range(300))) for lang, letters in (("a", b"abc "), ("b", b"bcde")))
    texts = [bytes(rng.choice(b"abcde z") for _ in range(rng.randint(1, 1200))) for _ in range(40)]
    want = [[plain_phrases(t, s) for _, s in samples] for t in texts]
    assert language.Parser(samples).phrases(texts).tolist() == want
    # The same from sorted edges, as with many languages.
    assert language.Parser(samples, cells=0).phrases(texts).tolist() == want


def test_language_sample_counts_copies_once_and_all_languages_alike(spark):
    rows = [(k, "aa", f"{chr(97 + k % 26)}{chr(97 + k // 26)}word " * 400) for k in range(70)] + [(100 + k, "bb", "one copied text " * 50) for k in range(300)] + [(500 + k, f"l{k:03}", "x") for k in range(60)]
    docs = spark.createDataFrame(rows + [(900, None, "no"), (901, "cc", None)], "doc_id long, lang string, text string")
    sample = dict(language.learn(docs, folds=1, held_out=1))
    assert len(sample["bb"]) <= language.SAMPLE_CHARS and set(sample) == {"aa", "bb"} | {f"l{k:03}" for k in range(60)}
    assert len({w for w in sample["aa"].split() if len(w) == 6}) == language.SAMPLE_TEXTS
    assert language.SAMPLE_TEXTS * (language.SAMPLE_CHARS - 2) <= len(sample["aa"]) <= language.SAMPLE_TEXTS * (language.SAMPLE_CHARS + 1)
    assert sample == dict(language.learn(docs.repartition(7, "text"), folds=1, held_out=1))


def test_language_on_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op7_language"](spark, LARGER).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_undetermined_texts(spark, odd):
    rows = {r["doc_id"]: r for r in language.identified(odd).collect() if r["doc_id"] is not None}
    assert {rows[k]["lang_pred"] for k in (1, 2, 3, 7)} == {"und"} and rows[9]["lang_pred"] == "de"


def test_language_stage_keeps_clean_documents(spark, given):
    docs, _ = given
    assert language.in_a_language(docs).count() == docs.count()


def test_toxicity_on_held_out_documents(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = queries.QUERIES["op9_toxicity"](spark, LARGER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([b > g for b in bad for g in good]) > 0.85 and np.mean(np.array(good) < 0.5) > 0.97


def test_sparse_weights_find_a_marked_word():
    words = [f"w{k}" for k in range(300)]
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=30) + ["marked"] * (k % 3 == 0)) for k in range(300)]
    model = toxicity.Ftrl(1 << toxicity.HASH_BITS)
    features = [np.unique(f) for f in toxicity.Hasher()(texts)]
    for _ in range(toxicity.EPOCHS):
        for k, f in enumerate(features):
            model.learn(f, int(k % 3 == 0))
    weights = model.weights(np.arange(len(model.z))).astype(np.float32)
    assert ((toxicity._scores(["w1 w2 marked w3", "w4 w5 w6"], weights) >= 0.5) == [True, False]).all()
    assert (weights != 0).sum() < 2000


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(8)
    rows = [(sorted(rng.sample(range(40), rng.randint(0, 12))), rng.randint(0, 1)) for _ in range(120)]
    model = toxicity.Ftrl(40)
    z, n = [0.0] * 41, [0.0] * 41

    def weight(i):
        l1 = 0.0 if i == 40 else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for found, label in rows * 3:
        model.learn(np.array(found, np.int32), label)
        w = {i: weight(i) for i in [*found, 40]}
        error = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in w:
            z[i] += error - ((n[i] + error**2) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
            n[i] += error**2
    assert model.weights(np.arange(41)) == pytest.approx([weight(i) for i in range(41)])


def test_toxicity_fit_takes_whole_texts_of_documents_that_are_there(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCUMENTS", 60)
    rng = random.Random(3)
    # The marked word stands behind more features than any cut would leave.
    filler = [f"f{k}" for k in range(3000)]
    rows = [(k, " ".join(rng.sample(filler, 1500)) + (" marked" * 2 if k % 2 else "")) for k in range(60)]
    docs = spark.createDataFrame(rows + [(k, t + " again") for k, t in rows[:20]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2) if k < 60 else 1) for k in range(4000)], "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels, folds=1, held_out=1)
    assert (weights == toxicity.learn(docs.repartition(9, "text"), labels, folds=1, held_out=1)).all()
    assert ((toxicity._scores(["some marked", "some other"], weights) >= 0.5) == [True, False]).all()


def test_toxicity_stage_keeps_clean_documents(spark, given):
    docs, texts = given
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r["doc_id"] for r in toxicity.not_toxic(docs, labels).select("doc_id").collect()}
    marked = {r["doc_id"] for r in toxicity.scored(docs, labels).filter("predicted = 1").collect()}
    assert kept == set(texts) - marked
    assert toxicity.not_toxic(docs, labels.limit(0)).count() == docs.count()


def test_network_is_a_distribution():
    net = lm_score.Network.start(np.arange(1.0, lm_score.VOCABULARY + 1))
    around = np.tile(np.array([[1, 2, 3, 4]]), (lm_score.VOCABULARY, 1))
    assert np.exp(net.log_probabilities(around, np.arange(lm_score.VOCABULARY))).sum() == pytest.approx(1, abs=1e-3)


def test_training_gradient_lowers_the_loss():
    rng = np.random.default_rng(1)
    net = lm_score.Network.start(np.ones(lm_score.VOCABULARY))
    squares = lm_score.Network(np.zeros(lm_score.Network.size(), np.float32))
    words = rng.integers(0, 50, 2000) * 70
    around = np.stack([(words + k) % lm_score.VOCABULARY for k in (1, 2, 3, 4)], axis=1)
    before = net.log_probabilities(around, words).mean()
    for k in range(0, 2000, 200):
        net.learn(around[k : k + 200], words[k : k + 200], squares)
    assert net.log_probabilities(around, words).mean() > before + 2


def test_lm_prefers_running_text_to_shuffled_words(spark):
    rng = random.Random(6)
    phrase = "the old house stands by the river and the road runs past the mill"
    rows = [(k, " ".join([phrase] * 30)) for k in range(60)] + [(100 + k, " ".join(rng.sample((phrase + " ").split() * 30, 400))) for k in range(10)]
    score = {r["doc_id"]: r["score"] for r in lm_score.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[0] > max(score[k] for k in range(100, 110)) and score[0] == score[59]


def test_pipeline_runs_as_registered(spark):
    rows = entry.queries()["pipeline"](spark, SF_DIR)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


def test_vocabulary_holds_the_most_frequent_words(spark, given):
    from collections import Counter

    docs, texts = given
    n = Counter(lm_score._word(c) for t in texts.values() for c in t.encode().split())
    found = lm_score.vocabulary(docs)
    want = sorted(n.items(), key=lambda x: (-x[1], x[0]))[: lm_score.VOCABULARY - lm_score.RARE]
    assert found.number == {w: k for k, (w, _) in enumerate(want)}
    assert found.counts.sum() == pytest.approx(lm_score.VOCABULARY + sum(n.values()))


def test_words_outside_the_vocabulary_are_scored_by_their_own_counts(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(9)
    known = [f"k{k}" for k in range(lm_score.VOCABULARY - lm_score.RARE)] * 6
    rare = [f"r{k}" for k in range(3000)] + [f"s{k}" for k in range(500)] * 4
    words = known + rare
    rng.shuffle(words)
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)] + ["r1 r2 r3 r4", "s1 s2 s3 s4", "", None]
    monkeypatch.setattr(lm_score, "learn", lambda docs, words: lm_score.Network.start(words.counts).flat)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_score.scored(docs).collect()}
    n = Counter(w for t in texts for w in (t or "").split())
    shared = Counter()
    for w, times in n.items():
        shared[zlib.crc32(w.encode()) % lm_score.RARE] += times if w[0] != "k" else 0
    total = sum(n.values()) + lm_score.VOCABULARY

    def p(w):
        entry = zlib.crc32(w.encode()) % lm_score.RARE
        return (n[w] + 1) / total if w[0] == "k" else (shared[entry] + 1) / total * n[w] / shared[entry]

    assert got == pytest.approx({k: sum(np.log(p(w)) for w in (t or "").split()) for k, t in enumerate(texts)}, abs=0.05)
    assert got[len(texts) - 4] < got[len(texts) - 3]


def test_every_word_is_learned_once_over_the_rounds(monkeypatch):
    from collections import Counter
    from types import SimpleNamespace as Sent

    import pyarrow as pa

    texts = ["one", "two three", None, " ".join(f"w{k}" for k in range(3000)), "four five six seven"]
    words = sorted({w for t in texts for w in (t or "").split()})
    numbers = lm_score.Vocabulary([w.encode() for w in words], [1] * len(words), np.zeros(lm_score.RARE))
    learned, weights = [], 0
    monkeypatch.setattr(lm_score.Network, "learn", lambda net, around, at, squares: learned.append(at.tolist()))
    start = lm_score.Network.start(numbers.counts).flat
    for k in range(lm_score.ROUNDS):
        before = sum(map(len, learned))
        blocks = lm_score._numbered(iter([pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})]))
        found = list(lm_score._train(Sent(value=numbers), Sent(value=start), k)(blocks))
        weights += found[0].column("weight")[0].as_py()
        assert 0.4 < (sum(map(len, learned)) - before) / len(words) < 0.6
    assert Counter(x for part in learned for x in part) == Counter(range(len(words))) and weights == len(words)


def test_numbered_blocks_hold_all_words_of_all_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_score, "BLOCK_CHARS", 20)
    texts = ["One, two", None, "", " \t", "two two (one) !!", "x " * 40, "\u00e9t\u00e9 two"]
    ids = [3, None, 3, 5, 7, 8, 9]
    got = []
    for found, sizes, seeds, words, seen in lm_score._unpacked(lm_score._numbered(iter([pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts)})]))):
        assert len(set(words)) == len(words) and sizes.sum() == len(seen)
        ends = np.cumsum(sizes)
        got += [(i, int(s), [words[k] for k in seen[e - n : e]]) for i, s, n, e in zip(found.to_pylist(), seeds, sizes, ends, strict=True)]
    want = [(i, zlib.crc32((t or "").encode()), [lm_score._word(c) for c in (t or "").encode().split()]) for i, t in zip(ids, texts, strict=True)]
    assert got == want


def test_words_travel_packed_by_bucket_and_are_counted_over_all_blocks(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from pagetide.llm.words import unpack_words

    monkeypatch.setattr(lm_score, "BLOCK_CHARS", 2000)
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.expovariate(0.002))}" for _ in range(300)) for _ in range(12)] + [None, ""]
    blocks = list(lm_score._numbered(iter([pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})])))
    sent = pa.Table.from_batches(list(lm_score._count(4)(iter(blocks))))
    assert len(blocks) > 5 and sent.num_rows <= 4 * len(blocks)
    want = Counter(w.encode() for t in texts for w in (t or "").split())
    found, top = {}, []
    for bucket in range(4):
        total = lm_score._total(sent.filter(pa.compute.equal(sent["bucket"], bucket))).to_pylist()[0]
        words = unpack_words(total["words"])
        assert not set(words) & set(found)
        found |= zip(words, np.frombuffer(total["n"], np.int64).tolist(), strict=True)
        top.append(list(zip(total["top"], total["top_n"], strict=True)))
        assert top[-1] == sorted(zip(words, np.frombuffer(total["n"], np.int64).tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    assert found == want


def test_slope_of_a_step_equals_differences_of_the_loss():
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 50, lm_score.VOCABULARY).astype(float)
    around, words = rng.integers(0, lm_score.VOCABULARY, (40, 4)), rng.integers(0, lm_score.VOCABULARY, 40)
    around[:, 0] = 17
    net, squares = lm_score.Network.start(counts), lm_score.Network(np.zeros(lm_score.Network.size(), np.float32))
    net.to_class[:] = rng.normal(0, 0.3, net.to_class.shape)
    net.to_word[:] = rng.normal(0, 0.3, net.to_word.shape)
    start = lm_score.Network(net.flat.astype(np.float64))
    net.learn(around, words, squares)
    # The first step of Adagrad leaves the squared slope in `squares` and goes against its sign.
    for name, at in (("embed", (17, 3)), ("place", (0, 5)), ("to_class", (2, 9)), ("class_bias", (4,)), ("to_word", (int(words[0]) // 64, 7, int(words[0]) % 64)), ("word_bias", (int(words[1]) // 64, int(words[1]) % 64))):
        losses = []
        for change in (1e-5, -1e-5):
            moved = lm_score.Network(start.flat.copy())
            getattr(moved, name)[at] += change
            losses.append(-moved.log_probabilities(around, words).sum())
        slope = (losses[0] - losses[1]) / 2e-5
        assert getattr(squares, name)[at] == pytest.approx(slope**2, rel=1e-2, abs=1e-6)
        assert np.sign(getattr(net, name)[at] - getattr(start, name)[at]) == -np.sign(slope)


def test_the_fit_of_toxicity_hands_its_memory_back(spark, monkeypatch):
    wrapped = []
    monkeypatch.setattr(toxicity, "releasing", lambda run: wrapped.append(run.__name__) or run)
    docs = spark.createDataFrame([(k, f"w{k % 2} w{k % 2} v") for k in range(40)], "doc_id LONG, text STRING")
    toxicity.learn(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))
    assert wrapped == ["_hashed", "_fit"]
