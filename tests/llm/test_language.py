import pytest

from linkprism.llm import language as L

TEXTS = {
    "en": ["The ferry leaves at noon and returns before it gets dark.", "Write a plain summary of the page for a busy reader.", "Tell me how it works and what people say about it."],
    "de": ["Die Fähre fährt mittags ab und kommt vor der Dunkelheit zurück.", "Schreibe eine verständliche Übersicht und nenne die wichtigsten Aussagen.", "Sage mir, wie das funktioniert und was die Leute darüber denken."],
    "fr": ["Le bac part à midi et revient avant la nuit.", "Explique ce que fait la page et à qui cela s’adresse.", "Dis-moi comment cela marche et ce que les gens en pensent."],
    "ru": ["Паром уходит в полдень и возвращается до темноты.", "Объясни, что делает страница и для кого это придумано."],
    "ja": ["船は正午に出て、暗くなる前に戻ります。", "この記事を読んで、主な主張を並べてください。"],
    "zh": ["渡船中午出发，天黑以前回来。", "请用五个简短的要点概括页面内容。"],
}


@pytest.fixture(scope="module")
def model():
    pairs = [(t, k) for k, ts in TEXTS.items() for t in ts]
    return L.fit(pairs * 1, pairs)


@pytest.mark.parametrize("label,want", [("en", "en"), (" EN-us ", "en"), ("German", "de"), ("fra", "fr"), ("zh-Hans", "zh"), ("pt_BR", "pt"), ("Русский", "ru"), ("mul", None), ("und", None), ("", None), (None, None), ("english (uk)", "en")])
def test_labels(spark, label, want):
    from pyspark.sql import functions as F

    assert L.language_of_label(label) == want
    assert spark.createDataFrame([(label,)], "l string").select(L.label_language(F.col("l"))).first()[0] == want


def test_segments(model):
    text = TEXTS["en"][0] + " " + TEXTS["en"][1] + " | " + TEXTS["de"][1] + "\n\n" + TEXTS["ja"][1] + TEXTS["zh"][1] + " " + TEXTS["ru"][1]
    got = model.segments([text, TEXTS["fr"][2], "", "12 345", "fennelworks.test #Tag"], {}, {})
    assert [s[0] for s in got[0]] == ["en", "de", "ja", "zh", "ru"] and all(0 <= s[1] <= 1 for s in got[0])
    assert [s[0] for s in got[1]] == ["fr"] and got[2] == got[3] == got[4] == []


def test_names_and_hosts_do_not_change_a_sentence(model):
    assert [s[0] for s in model.segments(["请用五个简短的要点概括Busy Reader的页面内容。people.example", "Le page part à midi. example.test"], {}, {})[0]] == ["zh"]


def test_held_out_sentences(model):
    held = {"en": "Tell the reader how the summary works and what it says.", "de": "Nenne mir die Übersicht und sage, was das funktioniert.", "fr": "Explique à qui cela s’adresse et ce que les gens en font.", "ru": "Сравни две страницы.", "ja": "主な主張を読んでください。", "zh": "请概括页面内容。"}
    assert {k: model.segments([t], {}, {})[0][0][0] for k, t in held.items()} == {k: k for k in held}


def test_relabelled(spark):
    rows = [(i, t, k, 0) for i, (t, k) in enumerate((t, k) for k, ts in TEXTS.items() for t in ts * 5)]
    n = len(rows)
    rows += [(n, TEXTS["en"][0], "German", 0), (n + 1, TEXTS["de"][0], None, 0), (n + 2, TEXTS["en"][0] + " " + TEXTS["de"][0], "en", 0), (n + 3, None, "en", 0), (n + 4, " ", None, 0), (n + 5, TEXTS["fr"][1] * 3000, "French", 0)]
    links = spark.createDataFrame(rows, "row_id long, primary_prompt_text string, prompt_lang string, segments int")
    seeds = spark.createDataFrame([(t, k) for k, ts in TEXTS.items() for t in ts], "text string, lang string")
    got = L.relabelled(links, seeds).where("is_case").orderBy("row_id", "segment_no").collect()
    assert [(r["row_id"], r["segment_no"], r["lang"]) for r in got] == [(n, 1, "en"), (n + 1, 1, "de"), (n + 2, 1, "en"), (n + 2, 2, "de")]
    assert L.relabelled(links.limit(0), seeds).count() == 0
