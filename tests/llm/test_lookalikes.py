import unicodedata

import pytest

from mailloom.llm.encodings import Model
from mailloom.llm.lookalikes import Classes, Rewriter, char_counts, find_cases, one_form

SCHEMA = "email_id bigint, from_addr string, body string, field string, rewritten string"
CASES = [
    ("Pаypal", "Paypal"), ("ｅｌｎａ＠ｘ.org", "elna@x.org"), ("𝗿𝗲𝗱 𝟮", "red 2"), ("a​b­c", "abc"), ("a b　c", "a b c"), ("café", "café"),
    ("Ε​νenο", "Evevo"[:1] + "veno"), ("сосо text", "coco text"), ("oﬃce", "office"), ("Νυnο now", "Nuno now"),
]
RIGHT = ["Москва и Томск", "сорок рек и так далее Berlin", "naïve “x” – 5 € ½ m² nº 5…", "Ελλάδα και Paris", "plain", "", "日本語"]


def counts(texts):
    import re
    from collections import Counter

    c = Counter("".join(texts) + "etaoin" * 20)
    c.update(m[0] for t in texts for m in re.finditer(r"[^\W_][̀-ͯ]", t))
    return dict(c)


@pytest.fixture(scope="module")
def rewriter():
    return Rewriter(counts([a for a, _ in CASES] + RIGHT))


@pytest.mark.parametrize(("text", "want"), CASES)
def test_rewritten(rewriter, text, want):
    assert rewriter.is_case(text) and rewriter.rewrite(text) == want
    assert rewriter.rewrite(want) == want and not rewriter.is_case(want)


OTHER_SCRIPTS = ["ᏢᎪᎩᏢᎪᏞ now", "ⲣⲁⲩⲣⲁⳑ now", "pаypаl now", "payցoold yes", "ᴘᴀʏᴘᴀʟ now", "KELVIN"]


@pytest.mark.parametrize("text", OTHER_SCRIPTS[:-1])
def test_look_alikes_of_many_scripts(rewriter, text):
    new = rewriter.rewrite(text)
    assert rewriter.is_case(text) and new.isascii() and not rewriter.is_case(new)


def test_proper_words_of_other_scripts_and_phonetic_signs_stay(rewriter):
    for text in ("ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ and more", "Հայաստան and more", "ⲙⲛⲧⲣⲙⲛⲕⲏⲙⲉ and more", "say /pɪk/ and ˈtʃɪk", "IT-компания"):
        assert rewriter.rewrite(text) == text and not rewriter.is_case(text)


def test_characters_that_the_corpus_lacks():
    r = Rewriter({})
    assert r.rewrite("ｍ𝐀é​b") == "mAéb" and r.is_case("ｍ") and r.rewrite("ệ") == "ệ"
    assert r.rewrite("a，b") == "a,b" and not r.is_case("a，b") and r.rewrite("\u212aelvin") == "Kelvin"


@pytest.mark.parametrize("text", RIGHT)
def test_right_text_is_no_case(rewriter, text):
    assert not rewriter.is_case(text) and rewriter.rewrite(text) == text


def test_latin_stand_in_within_another_script(rewriter):
    assert rewriter.is_case("Mосква") and rewriter.rewrite("Mосква реки") == "Москва реки"


def test_equal_forms_compare_equal(rewriter):
    name = "Elna Grievrith"
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in name)
    r = Rewriter(counts([name, wide, unicodedata.normalize("NFD", "Zoé")]))
    assert r.rewrite(wide) == name and r.rewrite(unicodedata.normalize("NFD", "Zoé")) == "Zoé"


def test_union_find_is_transitive():
    c = Classes()
    c.join("a", "b"), c.join("c", "d"), c.join("b", "c"), c.join("x", "y")
    assert sorted(map(sorted, c.classes())) == [["a", "b", "c", "d"], ["x", "y"]]


def test_operator(spark):
    garbled = "Grüße".encode().decode("cp1252") + "\xa0x"
    rows = [(1, "ｅlna@x.org", "fine", "", ""), (2, None, "Pаypal", "", ""), (2, None, "Pаypal", "", ""), (3, "", None, "", ""), (4, "a", garbled, "", ""), (5, "a", "x " * 100_000 + "​", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = Model.train([("de", "Grüße an alle")] * 8)
    got = sorted((r["email_id"], r["field"], r["rewritten"][:10]) for r in find_cases(df, "email_id", ["from_addr", "body"], model, ["body"]).collect())
    assert got == [(1, "from_addr", "elna@x.org"), (2, "body", "Paypal"), (2, "body", "Paypal"), (5, "body", "x x x x x ")]
    forms = {(r["email_id"], r["body"][:6] if r["body"] else r["body"]) for r in one_form(df, "email_id", ["from_addr", "body"]).collect()}
    assert (2, "Paypal") in forms and (3, None) in forms
    assert find_cases(df.where("false"), "email_id", ["from_addr", "body"], model, []).count() == 0 and one_form(df.where("false"), "email_id", ["body"]).count() == 0
    assert char_counts(df.where("false"), ["body"]) == {}


def test_p5_found_has_a_model_of_all_documents(spark, tmp_path, monkeypatch):
    from mailloom.llm import lookalikes, queries

    # more lang values, and more texts of one, than a sample would have
    docs = [(i, f"l{i % 30}", f"Grüße{i % 30} an alle") for i in range(90)] + [(100 + i, "de", f"Wort{i} läuft und Wort{i} läuft") for i in range(600)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bad = "Grüße29 an alle".encode().decode("cp1252") + "\xa0x"
    spark.createDataFrame([(1, "a@x.org", "Pаypal"), (2, "ｅlna@x.org", bad), (3, None, None)], "email_id bigint, from_addr string, body string").write.parquet(f"{tmp_path}/parse_eml.parquet")
    models, find = [], lookalikes.find_cases
    monkeypatch.setattr(lookalikes, "find_cases", lambda rows, key, fields, model, also: models.append(model) or find(rows, key, fields, model, also))
    got = sorted(map(tuple, queries.p5_found(spark, str(tmp_path)).collect()))
    assert got == [(1, "body"), (2, "from_addr")]
    whole = Model.train((lang, text) for _, lang, text in docs)
    assert models[0].dictionaries == whole.dictionaries and len(whole.dictionaries) == 31 and models[0].words == whole.words
    assert all(f"Wort{i} ".encode() in whole.dictionaries["de"] for i in range(600))


def test_p5_found_knows_rare_words_and_counts_all_values(spark, tmp_path):
    from itertools import islice, product

    from mailloom.llm import queries

    # one right word behind 210,000 as rare ones, which reads as a more frequent word of another encoding
    many = ["".join(w) + "é" for w in islice(product("abcdefghijkl", repeat=5), 210_000)]
    texts = [" ".join(many[i : i + 5000]) for i in range(0, len(many), 5000)] + ["zácilo zácilo zácilo"] * 3 + ["zßcilo"]
    spark.createDataFrame([(i, "es", x) for i, x in enumerate(texts)], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    mails = spark.createDataFrame([(1, "aab@x.org", "Pаypal zßcilo"), (2, "abc@x.org", "plain"), (3, "ca", None)], "email_id bigint, from_addr string, body string")
    mails.write.parquet(f"{tmp_path}/parse_eml.parquet")
    counted = char_counts(mails, ["from_addr", "body"])
    assert counted["a"] == 6 and counted["ß"] == 1 and counted["а"] == 1
    assert sorted(map(tuple, queries.p5_found(spark, str(tmp_path)).collect())) == [(1, "body")]
