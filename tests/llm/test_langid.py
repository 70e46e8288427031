import random

from pyspark.sql import functions as F

from dimforge.llm import langid, prose

TEMPLATES = {
    "en": ["The old harbour near {n} was closed for many years after the great fire.", "Most of the people who live in {n} still work on the coast today.", "It is not clear when the village of {n} was first settled by farmers."],
    "de": ["Der alte Hafen bei {n} war nach dem großen Brand viele Jahre geschlossen.", "Die meisten Menschen, die in {n} leben, arbeiten noch heute an der Küste.", "Es ist nicht bekannt, wann das Dorf {n} zum ersten Mal besiedelt wurde."],
    "fr": ["Le vieux port près de {n} était fermé depuis de longues années après l'incendie.", "La plupart des gens qui vivent à {n} travaillent encore sur la côte.", "On ne sait pas quand le village de {n} fut habité pour la première fois."],
}


def sentence(rnd, lang):
    return rnd.choice(TEMPLATES[lang]).format(n="".join(rnd.choice("bdgklmrstvz") + rnd.choice("aeiou") for _ in range(3)).title())


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(TEMPLATES))
        label = rnd.choice(sorted(TEMPLATES)) if rnd.random() < 0.1 else lang
        text = "\n\n".join(" ".join(sentence(rnd, lang) for _ in range(3)) for _ in range(3))
        rows.append((i, text, rnd.choice([label, label.upper(), f"{label}-XX"]), lang))
    return rows


def test_labels(spark):
    cases = {"en": "en", " EN ": "en", "en-GB": "en", "pt_BR": "pt", "English": "en", "deu": "de", "ger": "de", "zh-Hant-TW": "zh", "unknown": None, "??": None, "": None, None: None, "und": None, "e n": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", langid.label_code(F.col("l")).alias("c"))
    assert {r.l: r.c for r in df.collect()} == cases


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(corpus(300, 1), "doc_id long, text string, lang string, truth string")
    model = langid.fit(df, doc_id="doc_id", text="text", label="lang")
    assert model.languages == ["de", "en", "fr"]
    held = corpus(200, 2)
    got = langid.judge([t for _, t, _, _ in held], model)
    assert sum(g[0][1] == truth for g, (_, _, _, truth) in zip(got, held)) >= 198
    assert all(len(g) == 4 and 0 < g[0][2] <= 1 for g in got)

    rnd = random.Random(9)
    mixed = "\n \n\n".join([sentence(rnd, "en"), f"== Title ==\n{sentence(rnd, 'fr')} {sentence(rnd, 'fr')} {sentence(rnd, 'en')}", "{{box|a=1}}", " ".join(sentence(rnd, "en") for _ in range(4))])
    assert [(k, l) for k, l, _ in langid.judge([mixed], model)[0]] == [(0, "en"), (1, "en"), (2, "fr"), (4, "en")]
    odd = [(1, mixed, None), (2, mixed, "English"), (3, mixed, "fr"), (4, "#REDIRECT [[X]]", "fr"), (5, None, None), (6, "  \n ", "en"), (7, "zzzz " * 50, None), (8, sentence(rnd, "de") * 3000, "deu")]
    wrong = langid.mislabelled(spark.createDataFrame(odd, "doc_id long, text string, lang string"), model, doc_id="doc_id", text="text", label="lang")
    assert sorted((r.doc_id, r.segment_no, r.lang) for r in wrong.collect()) == [(1, 0, "en"), (1, 2, "fr"), (2, 2, "fr"), (3, 0, "en"), (3, 2, "fr")]
    assert langid.identify(df.limit(0), model, doc_id="doc_id", text="text").count() == 0


def test_long_and_repeated_pieces(spark):
    """A piece in another language than its text is told from it however long or repetitive it is."""
    df = spark.createDataFrame(corpus(300, 1), "doc_id long, text string, lang string, truth string")
    model = langid.fit(df, doc_id="doc_id", text="text", label="lang")
    rnd = random.Random(4)
    english = [" ".join(sentence(rnd, "en") for _ in range(400)) for _ in range(4)]
    for foreign in [" ".join(sentence(rnd, "fr") for _ in range(n)) for n in (40, 200, 520)] + [" ".join([sentence(rnd, "fr")] * 40)]:
        got = langid.judge(["\n\n".join([*english[:2], foreign, *english[2:]])], model)[0]
        assert [(k, x) for k, x, _ in got] == [(0, "en"), (1, "en"), (2, "en"), (3, "fr"), (4, "en"), (5, "en")]
        assert all(0 < c <= 1 for _, _, c in got)


def test_scripts_without_spaces(spark):
    """Chinese, Japanese and Thai have sentences, dictionaries and rows."""
    base = {
        "zh": ["这座城市的旧港口在大火之后关闭了很多年。", "住在这里的大多数人今天仍然在海岸工作。", "目前还不清楚农民什么时候第一次来到这个村庄。", "他们每年秋天都会在河边举行盛大的节日。"],
        "ja": ["この町の古い港は大火のあと長い間閉鎖されていました。", "ここに住んでいる人の多くは今でも海岸で働いています。", "村に最初に農民が住み始めた時期はわかっていません。", "毎年秋になると川のそばで大きな祭りが行われます。"],
        "th": ["ท่าเรือเก่าของเมืองนี้ปิดไปหลายปีหลังเกิดเพลิงไหม้ครั้งใหญ่", "คนส่วนใหญ่ที่อาศัยอยู่ที่นี่ยังคงทำงานอยู่ริมชายฝั่ง", "ไม่มีใครรู้ว่าชาวนามาตั้งถิ่นฐานในหมู่บ้านนี้เมื่อใด", "ทุกปีในฤดูใบไม้ร่วงพวกเขาจัดงานเทศกาลใหญ่ริมแม่น้ำ"],
    }
    rows = [(i, "\n".join(base[k]), k) for i, k in enumerate(k for k in base for _ in range(4))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), doc_id="doc_id", text="text", label="lang", least_sentences=4)
    assert model.languages == ["ja", "th", "zh"]
    for k, ss in base.items():
        assert [(n, x) for n, x, _ in langid.judge(["\n".join(ss[:2])], model)[0]] == [(0, k), (1, k)]
        assert len(prose.sentences("\n".join(ss))) == 4
    assert not prose.is_sentence("北京。") and not prose.is_sentence("哈哈哈哈哈哈哈哈哈哈哈哈。") and not prose.is_sentence("In 北京 1999.")


def test_sample_is_spread_over_a_text():
    assert langid.spread_over(list(range(23)), 12) == [0, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21]
    assert langid.spread_over(list(range(5)), 12) == [0, 1, 2, 3, 4] and langid.spread_over([], 12) == []


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "Some text that has no label at all.", None)], "doc_id long, text string, lang string")
    model = langid.fit(df, doc_id="doc_id", text="text", label="lang")
    assert model.languages == [] and langid.identify(df, model, doc_id="doc_id", text="text").count() == 0


def test_prose():
    t = "{{Infobox\n| a = b\n}}\n''The [[Old Town|old town]] of [[X]] was &eacute;legant'' in 1900.<ref>{{cite|title=Y}}</ref> See [http://x.y the page].\n\n{| class=\"w\"\n| 1 || 2\n|}\n\n=== Heading ===\n* Some people (a few) live there, «Ici on parle une autre langue.» they say.\n\n[[Category:Z]]\n#REDIRECT [[Q]]"
    assert len(prose.pieces(t)) == 4
    got = [" ".join(s.split()) for p in prose.pieces(t) for s in prose.sentences(p)]
    assert got[0] == "The old town of X was élegant in 1900." and "Ici on parle une autre langue." in got
    assert not any("{" in s or "[" in s or "|" in s or "Category" in s for s in got)
    assert prose.pieces("") == [] and prose.pieces(" \n\t\n ") == []
    assert prose.pieces("\n\na\n　\n\nb\r\n\r\nc") == ["a", "b", "c"]


def test_texts_are_judged_each_by_itself(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, doc_id="doc_id", text="text", label="lang")
    texts = [r.text for r in docs.select("text").limit(150).collect()] + [None, "", "  \n\n "]
    together = langid.judge(texts, model)
    assert together == [langid.judge([t], model)[0] for t in texts] and together[-3:] == [[], [], []]
    assert langid.judge([], model) == [] and langid.judge(["One sentence of words without a model."], langid.Model({})) == [[]]
