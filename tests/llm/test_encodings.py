from collections import Counter

import pytest

from mailloom.llm.encodings import Model, restore_fields, train

TEXTS = {
    "de": "Der Drucker läuft wieder, die Störung ist gelöst. Über die Gebühr haben wir ausführlich gesprochen. Für die Prüfung benötigen wir noch drei Unterschriften. Viele Grüße aus Köln. Könnten Sie das zurückhalten? Die Größe stimmt nicht.",
    "fr": "Le réseau sera coupé à midi, René préviendra l'équipe. Merci d'envoyer le compte rendu révisé. Le délai prévu paraît trop court. La réunion a été déplacée, la salle est occupée. Voilà où ça mène.",
    "es": "El sistema falló a las cinco; mañana llamará a la oficina. ¿Podría confirmar la petición? Todavía faltan cajas, según el albarán. Aquí está la última versión. El año pasado costó más.",
    "pt": "A informação está na última página da relação. O avião chegou às nove, não será amanhã. Ainda faltam peças, e a situação preocupa. Ele fará a inspeção da máquina. Atenção.",
    "ru": "Здравствуйте, принтер в офисе снова работает, заявка закрыта. Встреча переносится на утро. Мы получили только коробки. Сообщите, пожалуйста, кто отвечает за отчёт. Новая версия договора лежит в общей папке.",
    "en": "The printer works again and the ticket is closed — so please go ahead. It costs 20 € or £18. We agreed that the list stays open until Friday. Please send the report to the office…",
}


@pytest.fixture(scope="module")
def model():
    return Model.train((lang, s + ".") for lang, t in TEXTS.items() for s in t.split(".") for _ in range(4) if s)


def lines():
    return [(lang, s.strip() + ".") for lang, t in TEXTS.items() for s in t.split(".") if s.strip()]


def read_as(s, written, read):
    try:
        return s.encode(written).decode(read)
    except UnicodeError:
        return None


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251"])
def test_utf8_misread_is_found_and_restored(model, read):
    cases = [(s, read_as(s, "utf-8", read)) for _, s in lines() if not s.isascii()]
    cases = [(s, g) for s, g in cases if g]
    assert len(cases) >= 5
    assert all(model.restore(g)[1] for _, g in cases)
    assert sum(model.restore(g)[0] == s for s, g in cases) >= 0.9 * len(cases)


def test_twice_misread(model):
    s = "Für die Prüfung benötigen wir Größe"
    assert model.restore(s.encode().decode("cp1252").encode().decode("cp1252", "ignore"))[1]


@pytest.mark.parametrize(("written", "read", "langs"), [("mac_roman", "cp1252", "de fr es"), ("cp1252", "cp850", "de fr es"), ("cp1251", "cp1252", "ru"), ("cp866", "cp1251", "ru"), ("koi8_r", "cp1251", "ru")])
def test_single_byte_misread(model, written, read, langs):
    cases = [(s, read_as(s, written, read)) for lang, s in lines() if lang in langs.split() and not s.isascii()]
    cases = [(s, g) for s, g in cases if g and g != s]
    assert cases and sum(model.restore(g)[1] for _, g in cases) >= 0.7 * len(cases)
    assert sum(model.restore(g)[0] == s for s, g in cases) >= 0.3 * len(cases)


def test_right_text_stays(model):
    rare = ["Dvořák trifft Łucja und Zoë", "naïve café, 20 € – £5…", "ПРИНТЕР РАБОТАЕТ", "½ Liter, 3 m², 5 °C", "“quoted” — text", "日本語の文", "Τhanks for Ιt", "a​b", "", None, "plain"]
    for s in rare + [s for _, s in lines()]:
        assert model.restore(s)[:2] == (s, False), s


def test_partly_and_lost(model):
    good, bad = "Die Störung ist gelöst.", "Über die Gebühr haben wir gesprochen.".encode().decode("cp1252")
    fixed, garbled, _ = model.restore(good + "\n" + bad)
    assert garbled and fixed == good + "\nÜber die Gebühr haben wir gesprochen."
    assert model.restore("Gr��e aus K�ln")[1] and model.restore("a\x81b")[1]


def test_operator(spark, model):
    bad = "Viele Grüße aus Köln".encode().decode("cp1252")
    schema = "email_id bigint, subject string, body string, field string, chain string"
    df = spark.createDataFrame([(1, bad, "fine", "c", "c"), (2, None, bad, "c", "c"), (2, None, bad, "c", "c"), (3, "", None, "c", "c"), (4, "x", "y " * 200_000 + bad, "c", "c")], schema)
    got = sorted((r["email_id"], r["field"], r["restored"][-20:]) for r in restore_fields(df, "email_id", ["subject", "body"], model).collect())
    assert got == [(1, "subject", "Viele Grüße aus Köln"), *[(2, "body", "Viele Grüße aus Köln")] * 2, (4, "body", "Viele Grüße aus Köln")]
    assert restore_fields(df.where("false"), "email_id", ["subject", "body"], model).count() == 0


def test_training_works_on_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    m = train(empty)
    assert m.restore("Grüße")[1] is False and m.restore("x�")[1]
    few = spark.createDataFrame([(1, "de", "Grüße"), (2, None, "x"), (3, "de", None)], "doc_id bigint, lang string, text string")
    assert train(few).restore("Grüße")[1] is False


def test_training_counts_all_documents(spark):
    # more lang values, texts of each, lines of a text and characters of a line than a sample would have
    rows = [(i, "de", f"Wort{i} und Wort{i} zählt\nGrüße") for i in range(1500)]
    rows += [(2000 + i, f"l{i}", f"nur{i} hier{i} nur{i} hier{i} nur{i} hier{i}") for i in range(30)]
    rows += [(3000, "fr", "début " + "x " * 3000 + "dernière fois dernière fois\n" + "ligne\n" * 300 + "fin fin"), (3001, None, "ohne Sprache ohne Sprache"), (3002, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    m = train(docs.repartition(7))
    local = Model.train((lang, text) for _, lang, text in rows if text)
    assert m.dictionaries == local.dictionaries and m.words == local.words and m.alphabet == local.alphabet
    assert set(m.dictionaries) == {"de", "fr", "", *(f"l{i}" for i in range(30))}
    assert all(f"hier{i} nur{i}".encode() in m.dictionaries[f"l{i}"] for i in range(30)) and m.encode("fois dernière") in m.dictionaries["fr"] and b"fin" in m.dictionaries["fr"] and b"ohne Sprache" in m.dictionaries[""]
    assert sum(f"Wort{i} ".encode() in m.dictionaries["de"] for i in range(1500)) == 1500


def test_training_keeps_all_words_that_have_their_share_of_all():
    import pyarrow as pa

    from mailloom.llm.encodings import LEAST_SHARE, RARE, WORDS, Counts, _firsts

    def task(own):
        shape = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("score", pa.float64())])
        rows = [[WORDS] * len(own), [""] * len(own), list(own), list(own.values()), list(map(float, own.values()))]
        return list(_firsts(iter(pa.record_batch(rows, schema=shape).slice(i, 400_000) for i in range(0, len(own), 400_000))))

    # more words than a task folds at once; what is rare in one task is counted still
    parts = [{f"é{i}": 3 for i in range(900_000)} | {"ä": 10_000_000, "ö": 2, "ü": 1}, {"ß": 9_000_000, "é": 1}]
    sent = [b for own in parts for b in task(own)]
    counts = Counts()
    for b in _firsts(iter(sent)):
        counts[WORDS, ""].update(dict(zip(b.column(2).to_pylist(), b.column(3).to_pylist())))
    total = sum(sum(own.values()) for own in parts)
    assert sum(counts[WORDS, ""].values()) == total and RARE in counts[WORDS, ""]
    assert Model.of_counts(counts).words == {"ä", "ß"} and 3 < LEAST_SHARE * total
    few = Counts()
    few[WORDS, ""].update({f"é{i}": 5 for i in range(250_000)} | {RARE: 10_000_000})
    assert len(Model.of_counts(few).words) == 250_000


def test_dictionary_of_counts():
    import zstandard

    from mailloom.llm import dictionaries

    pieces, letters, lines = Counter(), Counter(), [f"the quick brown fox jumps over {i} lazy dogs again" for i in range(200)]
    for x in lines:
        dictionaries.count_pieces(x, pieces)
        letters.update(x)
    assert pieces["the"] == 200 and pieces["quick brown fox"] == 200 and pieces["7"] == 1
    raw = dictionaries.dictionary(pieces, letters, str.encode, 400)
    d = zstandard.ZstdCompressionDict(raw)
    assert d.dict_id() == 1 and b"the quick brown fox jumps over" in raw
    for x in (lines[7], "nothing of it 0123", "".join(map(chr, range(1, 256)))):
        packed = zstandard.ZstdCompressor(dict_data=d).compress(x.encode())
        assert zstandard.ZstdDecompressor(dict_data=d).decompress(packed) == x.encode()
    size = lambda x, **how: len(zstandard.ZstdCompressor(level=3, **how).compress(x.encode()))
    digits = "0123456789 9876543210 0246813579"
    # what no piece has takes fewer bits by the lengths of its literals alone
    assert size(lines[7], dict_data=d) < size(lines[7]) - 20 and size(digits, dict_data=d) < size(digits)
    # what was not looked at would have changed nothing
    many = Counter({f"w{i}": 1000 - i for i in range(900)} | {f"a{i} b c{i}": i for i in range(900)})
    best = sorted(many, key=lambda x: (-dictionaries.score(x, many[x]), x))[: dictionaries.looked_at(100)]
    assert dictionaries.dictionary(many, letters, str.encode, 100) == dictionaries.dictionary({x: many[x] for x in best}, letters, str.encode, 100)
    assert dictionaries.dictionary({}, {}, str.encode, 100) == b"" == dictionaries.dictionary({"once": 1}, {"o": 1}, str.encode, 100)


def test_letters_that_are_right_elsewhere_hide_nothing(model):
    # é as Ú, á as ß, £ as ú and € as Ç: all of them letters of some clean text, or cases of one
    wide = Model(model.dictionaries, model.alphabet + "ÚßúÇïÓ", model.words)
    for bad, good in [("Re: RÚunion le 9", "Re: Réunion le 9"), ("It is estß here", "It is está here"), ("a fee of ú7002 is due", "a fee of £7002 is due"), ("Refund of Ç4683.88", "Refund of €4683.88")]:
        assert not wide.unusual.search(bad), bad
        assert wide.restore(bad)[:2] == (good, True)
    # what one line proves holds for the short words of the others
    assert wide.restore("Re: RÚunion le 9\nBien Ó vous")[0] == "Re: Réunion le 9\nBien à vous"
    for right in ("Bien Ó vous", "Straße und Maß", "Çelik 20", "ïstanbul"):
        assert wide.restore(right)[:2] == (right, False)
