import pytest

from linkprism.llm import lookalikes as K


@pytest.mark.parametrize(
    "text,want",
    [("ａｂｃ　１", "abc 1"), ("résumé", "résumé"), ("a​b\xadc﻿", "abc"), ("a\xa0b c", "a b c"), ("ﬁn", "fin"), ("", ""), ("tab\tand  two", "tab\tand  two"), ("it’s ½ …™", "it’s ½ …™"), ("👩‍💻", "👩‍💻")],
)
def test_fold(text, want):
    assert K.fold(text) == want and K.fold(K.fold(text)) == want


def test_tables_agree():
    assert all(len(k) == len(v) == 1 for k, v in [*K._TO_LATIN.items(), *K._TO_CYRILLIC.items()])
    assert K._convert("раgе", "latin") == "page" and K._convert("Cpавни", "cyrillic") == "Сравни" and K._convert("жена", "latin") is None


def test_normalized_and_disguised(spark):
    clean = ["Read the page and cite this source.", "Сравни тарифы и советуй первый.", "Write a café review."]
    forms = ["Reаd thе раgе and cite thiѕ source.", "Cpавни тapифы и советуй первый.", "Write a café review.", "Write\xa0a café review.", "Ｗｒｉｔｅ a café review.", "Wri​te a café review."]
    rows = [(i, t, "clash") for i, t in enumerate([*clean, *clean, *forms, None, "", "  ", "Write  a café review.", "WRITE A CAFÉ REVIEW.", "Write a café revue.", "Write a café\treview.", "ѕаd " * 20_000])]
    df = spark.createDataFrame(rows, "row_id long, primary_prompt_text string, __id string")
    got = {r["row_id"]: r["normalized_text"] for r in K.normalized(df, "primary_prompt_text", "row_id").collect()}
    assert len(got) == len(rows) and [got[i] for i in range(6, 12)] == [clean[0], clean[1], clean[2], clean[2], clean[2], clean[2]]
    assert got[12] is None and got[13] == "" and got[14] == "  " and got[15] == "Write  a café review."
    prompts = spark.createDataFrame([(1, clean[0]), (2, clean[1]), (3, clean[2]), (4, None), (5, " ")], "prompt_id long, prompt_text string")
    assert {tuple(r) for r in K.disguised(df, prompts).collect()} == {(1, 6), (2, 7), (3, 8), (3, 9), (3, 10), (3, 11)}
    assert K.disguised(df.limit(0), prompts).count() == 0


def test_words_outside_the_vocabulary_stay(spark):
    df = spark.createDataFrame([(1, "Thе zqxаw")], "row_id long, t string")
    assert K.normalized(df, "t", "row_id").first()["normalized_text"] == "Thе zqxаw"
