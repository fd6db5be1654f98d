import zlib
from collections import Counter

import numpy as np

from sparkloom.llm import toxicity
from sparkloom.llm.toxicity import DECAY, GAP, Machine, Scorer, _kernel, _kernel_columns, _svm, codes_of, harmless_documents, nystroem, op9_string_kernel, points, read, scored, sentences, toxic_sentences, train

SF = "/root/testdata/sf0.1"  # smaller tables have too few toxic labels to learn or to measure by


def auc(pairs):
    pairs = sorted(pairs)
    ranks, k = 0.0, 0
    while k < len(pairs):
        j = k
        while j < len(pairs) and pairs[j][0] == pairs[k][0]:
            j += 1
        ranks += sum(y for _, y in pairs[k:j]) * (k + j + 1) / 2
        k = j
    ones = sum(y for _, y in pairs)
    return (ranks - ones * (ones + 1) / 2) / (ones * (len(pairs) - ones))


def test_held_out_documents(spark):
    rows = op9_string_kernel(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(held) > 0.9
    toxic = [s >= 0.5 for s, y in held if y]
    clean = [s >= 0.5 for s, y in held if not y]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.05 * len(clean)


CLEAN = [f"you are such a friend, the {a} was {b} and we went home by the river {k}" for k, (a, b) in enumerate([(x, y) for x in ("weather", "dinner", "music", "garden", "letter", "window") for y in ("fine", "plain", "quiet", "bright", "lovely")])]


def test_mangled_insults_score_high():
    machine = train([f"blorgface {t}" for t in CLEAN], CLEAN * 2)
    score = lambda w: float(machine.probability(machine.margins([w]))[0])
    assert min(map(score, ("blorgface", "blo.rgface", "blorrgface", "bl0rgface", "blorgfaces"))) > 0.5
    assert max(map(score, ("garden", "boring", "letter", "surface"))) < 0.5


def score_text(machine, text):
    return float(Scorer(machine)([text])[0])


def test_insults_across_spaces_score_high():
    machine = train([f"blorgface {t}" for t in CLEAN], CLEAN * 2)
    assert min(score_text(machine, f"{CLEAN[3]} {w} again") for w in ("blorg face", "blo rgface", "bl org face")) > 0.5
    assert max(score_text(machine, t) for t in CLEAN) < 0.5


def test_insults_of_ordinary_words_score_high():
    """Each word is in clean texts as often; only side by side are they an insult."""
    clean = [f"{t} empty by the {k} head" for k, t in enumerate(CLEAN)] + [f"head {t} {k} empty" for k, t in enumerate(CLEAN)]
    machine = train([f"{t} empty head {k}" for k, t in enumerate(CLEAN)], clean)
    assert sum(score_text(machine, f"{t} empty head and more") > 0.5 for t in CLEAN) >= 0.9 * len(CLEAN)
    assert sum(score_text(machine, t) > 0.5 for t in clean) <= 0.05 * len(clean)


def test_windows_equal_words():
    rng = np.random.default_rng(3)
    machine = Machine(rng.normal(size=64**3), 0.25)
    texts = [["du", "mb"], ["a", "b"], ["abc", "d"], ["stu", "p", "id"], [], ["lone"], ["x" * 60, "y"], ["é", "漢字", "q" * 30]]
    got = machine.best_joined([(words, [0] * len(words)) for words in texts])
    for words, (margin, word) in zip(texts, got):
        joined = {w for i in range(len(words)) for j in (i + 2, i + 3) if j <= len(words) and len(w := "".join(words[i:j])) <= 48}
        if not joined:
            assert (margin, word) == (-2.0, None)
            continue
        # A window's length counts a subsequence in several places as several; short ones are told as words.
        plain = {w: (machine.margins([w])[0] if len(w) < 4 else (sum(v * machine.weights[c] for c, v in places(w)) / np.sqrt(sum(v * v for _, v in places(w))) + machine.bias)) for w in joined}
        assert abs(margin - max(plain.values())) < 1e-9 and plain[word] == max(plain.values())


def test_windows_stay_inside_sentences():
    machine = Machine(np.zeros(64**3), 1.0)
    words, numbers = ["ab", "cd", "ef", "gh"], [0, 0, 1, 1]
    assert machine.best_joined([(words, numbers)])[0][1] in ("abcd", "efgh")
    machine.weights[codes_of(points("def")) @ [4096, 64, 1]] = 5.0
    assert machine.best_joined([(words, numbers)])[0][0] == 1.0 and machine.best_joined([(words, [0] * 4)])[0][0] > 1.0
    text = "One thing. two id. iot! Next one?\nthe last.  "
    assert sentences(text) == ["One thing. two id. iot!", "Next one?", "the last.  "]
    assert read(text) == ("one thing. two id. iot! next one? the last.".split(), [0, 0, 0, 0, 0, 1, 1, 2, 2])
    assert sentences(None) == sentences(" \n ") == [] and read(None) == ([], [])


def places(word):
    """(code, weight) of each subsequence of three characters of a marked word, by loops."""
    c = [62, *(ord(x) - 96 if "a" <= x <= "z" else 27 + ord(x) % 35 for x in word), 63]
    n = len(c)
    return [((c[i] * 64 + c[j]) * 64 + c[k], DECAY ** (k - i - 2)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + 3 + GAP))]


def described(word):
    out = Counter()
    for code, value in places(word):
        out[code] += value
    size = sum(v * v for v in out.values()) ** 0.5
    return {code: v / size for code, v in out.items()}


WORDS = ["a", "ab", "aaaaaaa", "banana", "insult", "in-sult", "inssult", "nsult", "über", "漢字かな", "x" * 24, "abababababab", "sultin"]


def test_kernel_equals_a_plain_sum_over_subsequences():
    plain = [described(w) for w in WORDS]
    gram = np.array([[sum(v * b.get(code, 0.0) for code, v in a.items()) for b in plain] for a in plain])
    assert np.allclose(_kernel(WORDS, *_kernel_columns(WORDS)), gram, atol=1e-12) and np.allclose(np.diag(gram), 1)
    some = WORDS[3:8]
    assert np.allclose(_kernel(WORDS, *_kernel_columns(some)), gram[:, 3:8], atol=1e-12)
    assert gram[4, 6] > gram[4, 3] and gram[4, 5] > gram[4, 12]  # gaps and inserted characters stay near


def test_nystroem_keeps_the_kernel_with_landmarks():
    gram = _kernel(WORDS, *_kernel_columns(WORDS))
    marks = WORDS[2:9]
    where, matrix, onto = nystroem(marks)
    z = _kernel(WORDS, where, matrix) @ onto
    assert np.allclose(z @ z[2:9].T, gram[:, 2:9], atol=1e-6)
    others = np.linalg.pinv(gram[2:9, 2:9])
    assert np.allclose(z @ z.T, gram[:, 2:9] @ others @ gram[2:9], atol=1e-6)


def test_svm_is_at_its_minimum():
    rng = np.random.default_rng(2)
    z, y, cost = rng.normal(size=(60, 5)), rng.choice([-1.0, 1.0], 60), rng.uniform(0.5, 2, 60)
    w = _svm(z, y, cost)
    x = np.hstack([z, np.ones((60, 1))])
    ridge = np.array([1.0] * 5 + [1e-3])
    loss = lambda v: (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() + (ridge * v * v).sum()
    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=6)) for _ in range(50))


def test_folded_weights_equal_the_machine_over_landmarks():
    """A word's margin by the table is that of its Nyström numbers."""
    toxic, clean = [f"blorgface {t}" for t in CLEAN], CLEAN * 2
    seen = {}
    known, own = toxicity._svm, toxicity.nystroem
    try:
        toxicity.nystroem = lambda marks: seen.setdefault("maps", []).append(own(marks)) or seen["maps"][-1]
        toxicity._svm = lambda *a: seen.setdefault("w", []).append(known(*a)) or seen["w"][-1]
        machine = train(toxic, clean)
    finally:
        toxicity._svm, toxicity.nystroem = known, own
    k = len(seen["w"]) - 1 if machine.joined is None else len(seen["w"]) // 2 - 1
    (where, matrix, onto), w = seen["maps"][k], seen["w"][k]
    assert np.allclose(machine.margins(WORDS), _kernel(WORDS, where, matrix) @ onto @ w[:-1] + w[-1], atol=1e-9)


def test_the_most_toxic_texts_do_not_tie():
    machine = train([f"blorgface {t}" for t in CLEAN], CLEAN * 2)
    strong = Machine(machine.weights * 4, machine.bias)
    assert len(set(Scorer(strong)(["blorgface", "blorgfaces", "blor-gface"]).tolist())) == 3


def test_toxic_sentences(spark):
    docs, rows = awkward(spark)
    labels = spark.createDataFrame([(k, 0) for k in range(30)] + [(100 + k, 1) for k in range(30)], "doc_id long, toxic int")
    more = docs.union(spark.createDataFrame([(300, "All is well here. Blorgface you are!\nnothing more", "x", 1.0)], docs.schema))
    got = toxic_sentences(more, labels)
    assert got.columns == ["doc_id", "sentence_no", "sentence", "sentence_score"]
    found = [tuple(r)[:3] for r in got.where("doc_id = 300").collect()]
    assert found == [(300, 1, "Blorgface you are!")]
    assert {r.doc_id for r in got.collect()} == {*range(100, 130), None, 203, 204, 300}


def awkward(spark):
    rows = [(k, t) for k, t in enumerate(CLEAN)] + [(100 + k, t + " blorgface") for k, t in enumerate(CLEAN)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "you blorgface"), (203, "b l o r g f a c e you are"), (204, "fine " * 200_000 + "blorgface"), (204, "fine " * 200_000 + "blorgface"), (205, "z" * 100_000)]
    return spark.createDataFrame([(*r, "mine", 3.0) for r in rows], "doc_id long, text string, lang string, score double"), rows


def test_nulls_long_texts_repeats_and_clashing_columns(spark):
    docs, rows = awkward(spark)
    labels = spark.createDataFrame([(k, 0) for k in range(30)] + [(100 + k, 1) for k in range(30)] + [(5, None), (None, 1), (100, 0)], "doc_id long, toxic int")
    got = scored(docs, labels).collect()
    assert len(got) == len(rows)
    score = {}
    for r in got:
        assert score.setdefault(r.doc_id, r.score) == r.score
    assert score[200] == score[201] == score[202] < 0.5 and score[204] > 0.5 and score[203] > 0.5 and score[None] > 0.5 and score[205] < 0.5
    kept = harmless_documents(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {3.0}
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 200, 201, 202, 205]


def test_without_labels_or_documents(spark):
    docs, rows = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in scored(docs, none).collect()} == {0.5}
    assert scored(docs.limit(0), none).collect() == [] and harmless_documents(docs.limit(0), none).collect() == []


def test_all_documents_are_harmless_without_labels(spark):
    docs, rows = awkward(spark)
    for labels in ([], [(1, None)], [(999, 1)]):
        got = harmless_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert got.columns == docs.columns and got.count() == len(rows)
