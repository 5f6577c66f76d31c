"""Language ID and toxicity: exact parts against brute force, held-out accuracy, odd inputs."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"


def phrases(train, text):
    """Greedy longest matches, counted directly; a symbol that the training text lacks is a phrase of its own."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        n, at = n + 1, at + size
    return n


def test_parser_counts_phrases():
    rng = random.Random(1)
    train = {k: "".join(rng.choice(a) for _ in range(600)) for k, a in (("x", "abcd "), ("y", "abce"))}
    p = language.Parser(train, chars=400)
    letters = "abcde"
    texts = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 1200))) for _ in range(30)]
    got = p.phrases([p.symbol[language.normalise(language.points(t))] for t in texts])
    for j, lang in enumerate(p.langs):
        learned = "".join(chr(c) if c else " " for c in language.normalise(language.points(train[lang])))[: min(400, *(2 * len(language.normalise(language.points(v))) // 3 for v in train.values()))]
        for i, t in enumerate(texts):
            assert got[i, j] == phrases(learned, t), (lang, letters)


def test_phrases_cross_blocks():
    """Long repeats of the learned text: phrases longer than blocks, whose ends come late in the next ones."""
    rng = random.Random(3)
    x = "".join(rng.choice("abcd") for _ in range(6000))
    p = language.Parser({"x": x, "y": "".join(rng.choice("abcd") for _ in range(6000))}, chars=4000)
    texts = [x[:4000], x[700:3900] + "e" + x[5:1800], "a" + x[100:2600] * 2, x[3000:3400], "b" * 3000, x[10 : 10 + language.BLOCK], x[10 : 11 + language.BLOCK]]
    got = p.phrases([p.symbol[language.normalise(language.points(t))] for t in texts])
    assert got[:, 0].tolist() == [phrases(x[:4000], t) for t in texts]


def test_languages_of_several_scripts():
    """Chinese, Japanese, Korean, Russian, Greek and English with little text each."""
    texts = {
        "zh": "今天天气很好，我们去公园散步。孩子们在湖边玩耍，老人们在树下下棋。中午我们在小饭馆吃面条，下午去书店买了几本新书。晚上回家以后，我给朋友写了一封长信，告诉他最近的工作和生活。明天我还要早起上班，所以今晚想早点休息。",
        "ja": "今日は天気がとても良いので、公園へ散歩に行きました。子供たちは湖のそばで遊んでいて、お年寄りは木の下で将棋を指していました。昼には小さな食堂でうどんを食べ、午後は本屋で新しい本を何冊か買いました。夜は家に帰って友達に長い手紙を書きました。",
        "ko": "오늘은 날씨가 아주 좋아서 공원으로 산책을 갔습니다. 아이들은 호숫가에서 놀고 노인들은 나무 아래에서 장기를 두고 있었습니다. 점심에는 작은 식당에서 국수를 먹고 오후에는 서점에서 새 책을 몇 권 샀습니다. 저녁에는 집에 돌아와서 친구에게 긴 편지를 썼습니다.",
        "ru": "Сегодня очень хорошая погода, поэтому мы пошли гулять в парк. Дети играли у озера, а старики сидели под деревьями и играли в шахматы. Днём мы ели лапшу в маленьком кафе, потом купили в магазине несколько новых книг. Вечером дома я написал другу длинное письмо.",
        "en": "The weather is very good today, so we went for a walk in the park. The children played near the lake, and the old people sat under the trees and played chess. At noon we ate noodles in a small restaurant, and then we bought some new books in the shop.",
        "abc": "ab c",
    }
    p = language.parser(tuple(sorted((k, v * (1 if k == "abc" else 2)) for k, v in texts.items())))
    new = {"zh": "我们明天去书店买书，晚上在家吃面条。", "ja": "友達は公園で子供たちと遊びました。夜は本を買いに行きました。", "ko": "친구는 오후에 공원에서 아이들과 놀고 저녁에는 국수를 먹었습니다.", "ru": "Вечером дети купили новые книги и пошли гулять к озеру.", "en": "The old people bought books in the park and the children ate near the trees."}
    assert p.judge([*new.values()])[0] == [*new]


def test_parser_tells_all_letters_apart():
    """Languages of rare scripts beside Latin ones, and of thousands of letters, with phrases counted exactly."""
    rng = random.Random(2)
    scripts = {"latin": [*map(chr, range(0x61, 0x7B)), *map(chr, range(0xE0, 0xF7))], "greek": [*map(chr, range(0x3B1, 0x3C2))], "cyrillic": [*map(chr, range(0x430, 0x450))], "han1": [*map(chr, range(0x4E00, 0x5600))], "han2": [*map(chr, range(0x5600, 0x5E00))]}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(2000)] for k, v in scripts.items()}
    draw = lambda k, n: " ".join(words[k][int(2000 * rng.random() ** 4)] for _ in range(n // 3))
    train = {k: draw(k, 9000 if k in ("latin", "han1") else 3000) for k in scripts}
    p = language.parser(tuple(sorted(train.items())))
    held = [(k, draw(k, 200)) for k in scripts for _ in range(4)]
    assert p.judge([t for _, t in held])[0] == [k for k, _ in held]
    plain = lambda t: "".join(chr(c) if c else " " for c in language.normalise(language.points(t)))
    got = p.phrases([p.symbol[language.normalise(language.points(t))] for _, t in held])
    for j, lang in enumerate(p.langs):
        for i, (_, t) in enumerate(held):
            assert got[i, j] == phrases(plain(train[lang])[: p.learned[j]], plain(t))


def test_normalise():
    codes = language.normalise(language.points("Ab--c  9 ÉΣ!"))
    assert "".join(chr(c) if c else " " for c in codes) == "ab c éσ "


def test_language_query(spark):
    rows = queries.op1_language_id(spark, SF).collect()
    lang = {r.doc_id: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in lang}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_short_language_weakens_only_itself(spark):
    """A mistaken label with 60 letters, or a language with little text, leaves what the others learn as it is."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").collect()
    train = {k: "\n".join(r.text[:4000] for r in docs if r["lang"] == k and r.doc_id % 2)[:64_000] for k in ("de", "en", "es", "fr")}
    held = [r for r in docs if r.doc_id % 2 == 0]
    for short in ({"xx": train["en"][30_000:30_072]}, {"xx": train["de"][30_000:30_072]}, {"fr": train["fr"][:300]}):
        p = language.parser(tuple(sorted((train | short).items())))
        assert sorted(p.learned)[-3:] == [language.TRAIN_CHARS] * 3
        langs, _ = p.judge([r.text for r in held])
        assert sum(a == r["lang"] for a, r in zip(langs, held, strict=True)) >= 0.97 * len(held)


def test_little_labelled_text_is_enough(spark):
    """A language of 600 labelled characters and more finds its texts beside others of 24,000, and takes none of theirs; brute force over the phrases says the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").collect()
    train = {k: "\n".join(r.text[:4000] for r in docs if r["lang"] == k and r.doc_id % 2)[:64_000] for k in ("de", "en", "es", "fr")}
    held = [r for r in docs if r.doc_id % 2 == 0]
    plain = lambda t: "".join(chr(c) if c else " " for c in language.normalise(language.points(t)))
    for lang, n in (("es", 600), ("es", 1200), ("de", 600), ("fr", 2400)):
        p = language.parser(tuple(sorted((train | {lang: train[lang][:n]}).items())))
        langs, _ = p.judge([r.text for r in held])
        own = [a == lang for a, r in zip(langs, held, strict=True) if r["lang"] == lang]
        assert sum(own) >= 0.97 * len(own) and sum(a == lang for a, r in zip(langs, held, strict=True) if r["lang"] != lang) <= 0.01 * len(held)
        size, j = min(p.learned), p.langs.index(lang)
        for r, a in [*zip(held, langs, strict=True)][:12]:
            t = plain(r.text[:600])
            counts = {(k, m): phrases(plain(train[x])[:m], t) for k, x in enumerate(p.langs) for m in ({p.learned[k], size})}
            best = min((k for k in range(4) if k != j), key=lambda k: counts[k, p.learned[k]] / p.rate[k])
            if counts[j, size] / counts[best, size] < np.exp(-language.SURE * np.sqrt(2) * p.spread[size]):
                best = j
            assert p.judge([r.text[:600]])[0] == [p.langs[best]]


def test_own_rate_by_thirds():
    """The own rate and the spread between samples, against a direct parse."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    train = {k: " ".join(rng.choice(words) for _ in range(n)) for k, n in (("x", 900), ("y", 200))}
    p = language.Parser(train, chars=1200, even=False)
    for k, lang in enumerate(p.langs):
        m = p.learned[k]
        t = train[lang][: m + (m + 1) // 2]
        thirds = [t[: m // 2], t[m // 2 : m], t[m:]]
        n = sum(phrases("".join(thirds[:f] + thirds[f + 1 :]), thirds[f]) for f in range(3))
        assert abs(p.rate[k] - n / len(t)) < 1e-9
    size = min(p.learned)
    stride = len(train["x"]) // (language.SAMPLES + 1)
    short = min(size, stride)
    held = train["x"][language.SAMPLES * stride :][:4000]
    counts = np.array([phrases(train["x"][k * stride : k * stride + short], held) for k in range(language.SAMPLES)])
    middle = np.median(counts)
    assert abs(p.spread[size] - 1.4826 * np.median(np.abs(counts - middle)) / middle * (short / size) ** 0.5) < 1e-9


def test_stray_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGS", 2)
    df = spark.createDataFrame([(i, "some text", x) for i, x in enumerate("aaabbccd")], "doc_id long, text string, lang string")
    assert set(language.labelled_sample(df, "doc_id", "text", "lang")) == {"a", "b"}


def test_ties_go_to_the_first_name():
    p = language.Parser({"b": "one two three " * 300, "a": "one two three " * 300}, even=False)
    assert p.judge(["three one"])[0] == ["a"]


def test_language_ignores_held_out_labels(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    fold = queries.fold("doc_id", 4)
    changed = df.withColumn("lang", F.when(fold == 2, "xx").otherwise(F.col("lang")))
    sample = lambda d: language.labelled_sample(d.where(fold != 2), "doc_id", "text", "lang")
    assert sample(df) == sample(changed) and "xx" not in sample(changed)


def test_language_odd(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "漢字"), (5, "the and of " * 40_000), (None, "the and of"), (None, "the and of")]
    df = spark.createDataFrame([(*r, "zz", 1) for r in rows], "doc_id long, text string, lang_pred string, doc int")
    got = {(r.doc, r.lang_pred) for r in language.identify(df, {"en": "the and of in to that " * 200, "de": "der die und das ein zu " * 200}).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "en"), (None, "en")} <= got and len(got) == 6
    assert language.identify(df.limit(0), {}).collect() == []
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}
    assert language.labelled_sample(df.limit(0).withColumn("lang", F.lit("x")), "doc_id", "text", "lang") == {}


def kernel(s, t):
    """The gap-weighted kernel over three letters by enumeration, words with their edges, normalised."""
    from collections import Counter

    def counts(w):
        sym = [toxicity.EDGE, *(int(x) for x in toxicity.symbol_table()[[ord(c) for c in w]] if x), toxicity.EDGE]
        out = Counter()
        for i in range(len(sym)):
            for k in range(i + 2, min(i + toxicity.SPAN, len(sym))):
                for j in range(i + 1, k):
                    out[sym[i], sym[j], sym[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    a, b = counts(s), counts(t)
    dot = lambda x, y: sum(v * y[k] for k, v in x.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if a and b else 0.0


def test_kernel():
    words = ["idiot", "idixot", "i.d.i.o.t", "1d10t", "person", "IDIOT", "straße", "a"]
    x, _ = toxicity._dense(words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert abs(x[i] @ x[j] - kernel(s, t)) < 1e-9
    assert kernel("idiot", "i.d.i.o.t") == pytest.approx(1) and kernel("idiot", "1d10t") == pytest.approx(1)
    assert kernel("idiot", "idixot") > 0.4 > kernel("idiot", "person")


def test_folded_weights_are_the_nystrom_decision():
    m = toxicity.fit(["idiot", "idiots", "moron", "stupid"], ["person", "the", "and", "house", "garden", "tree"])
    assert (m.decide(["idiot", "moron", "stupid"]) > 0.8).all() and (m.decide(["person", "house", "tree"]) < -0.8).all()


@pytest.fixture(scope="module")
def machine(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return queries.toxicity_machine(docs, labels)


def test_toxicity_query(spark):
    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, SF).collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {i: r.held_out for i, r in rows.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in rows}
    held = [i for i in toxic if i in rows and rows[i].held_out]
    assert sum(rows[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_toxicity_variants(machine):
    """Insults that the sample marks stay caught with characters put in between."""
    texts = ["An orderly text with an i d i o t in it.", "such an id-iot here", "what an I.D.I.O.T. he is", "only an orderly text"]
    assert [machine.score(d) >= 0.7 for d in machine.worst(texts)] == [True, True, True, False]


def test_toxicity_odd(spark, machine):
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "x" * 200_000), (None, "fine words"), (None, "fine words")]
    df = spark.createDataFrame([(*r, 0.5, "d") for r in rows], "doc_id long, text string, score double, doc string")
    got = toxicity.score(df, machine).collect()
    assert len(got) == 6 and all(0 <= r.score < 0.7 for r in got)
    kept = toxicity.keep_clean(df, machine)
    assert kept.columns == df.columns and kept.count() == 6
    assert toxicity.score(df.limit(0), machine).collect() == [] and toxicity.keep_clean(df.limit(0), machine).collect() == []
    none = toxicity.train([], [])
    assert none.score(none.worst(["idiot"])[0]) < 0.01
    assert toxicity.labelled_sample(df.select("doc_id", "text"), df.limit(0).select("doc_id", F.lit(1).alias("toxic")), "doc_id", "text", "toxic") == ([], [])


def test_training_repeats():
    texts = [f"word{i} und idiot{'s' * (i % 2)} here" if i % 2 else f"word{i} und so on" for i in range(60)]
    a, b = (toxicity.train(texts, [i % 2 for i in range(60)]) for _ in range(2))
    assert np.array_equal(a.features, b.features) and np.array_equal(a.weights, b.weights) and a.shift == b.shift


def test_training_holds_a_word_once(monkeypatch):
    """What training keeps of the sample in the driver grows with the different words, and little with their repetitions."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(rng.sample(vocabulary, 1000)) for _ in range(200)]
    held = []

    def marks(*_):
        held.append(tracemalloc.get_traced_memory()[0])
        return []

    monkeypatch.setattr(toxicity, "marks", marks)
    tracemalloc.start()
    try:
        toxicity.train(texts, [int(i % 10 == 0) for i in range(200)])
    finally:
        tracemalloc.stop()
    assert held[0] < 10e6  # a string for each word of each text takes 16 MB


def test_training_leaves_the_driver_small(spark, machine, monkeypatch):
    """What training freed goes back to the system at once, and not when the driver next allocates."""
    given = []
    monkeypatch.setattr(queries, "give_back", lambda: given.append(True), raising=False)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    again = queries.toxicity_machine(docs, labels)
    assert given == [True] and np.array_equal(again.weights, machine.weights)


def test_letters_of_any_script():
    """Insults of other scripts, and weights looked up in a cube and by search alike."""
    texts = [f"слово{i} и {'дурачина' if i % 2 else 'прохожий'} здесь 今天{chr(0x4E00 + i)}" for i in range(80)]
    m = toxicity.train(texts, [i % 2 for i in range(80)])
    scores = [m.score(d) for d in m.worst(["такой дурачина тут", "дура-чина", "такой прохожий тут", "今天天气"])]
    assert scores[0] >= 0.7 and scores[1] >= 0.7 and scores[2] < 0.7 and scores[3] < 0.7
    words = ["дурачина", "дурачены", "idiot", "天气", "прохожий"]
    by_cube = m.decide(words)
    assert m.cube is not None
    m.cube = None
    assert np.allclose(by_cube, m.decide(words))


def test_scores_of_a_plain_machine():
    """Decisions from the folded weights against the machine written out: kernels with every landmark, by enumeration."""
    positives, negatives = ["idiot", "moron", "stupid"], ["person", "house", "garden", "tree", "und"]
    m = toxicity.fit(positives, negatives)
    marks = [*toxicity.spread(positives, toxicity.LANDMARKS // 2), *toxicity.spread(negatives, toxicity.LANDMARKS // 2)]
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    train = np.array([[kernel(a, b) for b in marks] for a in positives + negatives])
    y = np.r_[np.ones(3), -np.ones(5)]
    weight = np.where(y > 0, 1 / 3, 1 / 5) * 4
    values, vectors = np.linalg.eigh(k)
    white = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    x = np.c_[train @ white, np.ones(8)]
    beta = np.zeros(x.shape[1])
    for _ in range(20_000):  # plain gradient descent on the squared hinge loss
        margin = np.maximum(0, 1 - y * (x @ beta))
        beta -= 1e-3 * (beta - 10 * x.T @ (weight * y * margin))
    for word in ["idi0t", "idixot", "people", "houses", "", "mo.ron"]:
        plain = np.array([kernel(word, b) for b in marks]) @ white @ beta[:-1] + beta[-1]
        assert abs(plain - m.decide([word])[0]) < 1e-3


def test_sample_is_bounded_in_characters(spark):
    rows = [(i, "x" * (100 if i else 5000), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts, ys = toxicity.labelled_sample(df.select("doc_id", "text"), df.select("doc_id", "toxic"), "doc_id", "text", "toxic", chars=1600)
    assert len(texts) == 32 and sum(ys) == 16 and all(len(t) == 100 for t in texts)
