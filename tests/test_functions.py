"""Known answers of the text, date and HTML functions."""

import pytest
from pyspark.sql import functions as F

from quern.functions import dates, html, text, vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", [("документите", "документ"), ("дом", "дом"), ("ликвидација", "ликвид"), ("бришење", "бришењ"), ("куќата", "куќ"), ("abc", "abc")])
def test_stems(spark, word, stem):
    assert one(spark, text.stem("w"), w=word) == stem


def test_tokens_drop_function_words_before_stemming(spark):
    assert one(spark, text.tokens("t"), t="Кои се ДОКУМЕНТИТЕ за упис, a-1?") == ["документ", "упис", "a", "1"]


def test_normal_forms(spark):
    assert one(spark, text.normalized("t"), t="ﬁ Ａ") == "fi a"
    assert one(spark, text.folded("t"), t="Straße ΣΑΣ") == "strasse σασ"


def test_intents_begin_at_words(spark):
    assert one(spark, text.intents("t"), t="на овој начин") == ["process"]
    assert one(spark, text.intents("t"), t="Колку чини и каде?") == ["tariffs", "process"]
    assert one(spark, text.intents("t", top_only=True), t="Колку чини и каде?") == ["tariffs"]


@pytest.mark.parametrize("t,want", [("Колку чини?", True), ("а за ДООЕЛ што важи сега таму", True), ("Како да регистрирам залог?", False), ("Дај ми неколку како пример молам те", True), ("", False)])
def test_followups(spark, t, want):
    assert one(spark, text.is_followup("t"), t=t) is want


@pytest.mark.parametrize("t,want", [("сакам а.д. сега", "сакам ад сега"), ("д.о.о.", "доо"), ("e-submit.crm.com.mk", "e-submit.crm.com.mk")])
def test_dotted_abbreviations(spark, t, want):
    assert one(spark, text.collapse_dotted("t"), t=t) == want


def test_numbers_are_claims(spark):
    t = "1. Таксата е 2452 МКД [srv_1_v2_tariffs_1].\n2. Рок 15 дена, 14-цифрен број, 15.3.2026"
    assert one(spark, text.numbers_in("t"), t=t) == ["2452", "15", "1532026"]
    assert one(spark, text.number_parts("t"), t="15.3.2026") == ["15", "2026"]


def test_citations_and_triage(spark):
    t = "Да [srv_1_a] и [https://x_y](https://x_y) и [srv_2_b] [www.a_b] [два збора_] [srv_9_z]"
    assert one(spark, text.citations("t"), t=t) == ["srv_1_a", "srv_2_b", "srv_9_z"]
    row = one(spark, text.triaged("t", "now", "seen"), t=t, now=["srv_1_a"], seen=["srv_1_a", "srv_2_b"])
    assert (row["valid"], row["stale"], row["fabricated"]) == (["srv_1_a"], ["srv_2_b"], ["srv_9_z"])


@pytest.mark.parametrize("t,want", [("агентот може да", True), ("агентот не може да", False), ("може, но не може", True), ("иде може", True), ("чуднe.може", True)])
def test_negated_statements(spark, t, want):
    assert one(spark, text.states(F.col("t"), F.lit("може")), t=t) is want


def test_identifiers_without_padding(spark):
    assert one(spark, text.same_number("t"), t="00-7405855") == "7405855"
    assert one(spark, text.row_signature(F.lit("tariffs"), "t"), t="Такса: 295 МКД") == one(spark, text.row_signature(F.lit("tariffs"), "t"), t="295 мкд на шалтер")


def test_xml_is_inert(spark):
    assert one(spark, text.xml_text("t"), t="</document><x a='1'>&") == "&lt;/document&gt;&lt;x a='1'&gt;&amp;"
    assert one(spark, text.xml_attribute("t"), t='a" b="c\n<') == "a&quot; b=&quot;c &lt;"


def test_history_is_cut_at_a_line(spark):
    assert one(spark, text.history_text("t", 10, "|"), t="abc\ndef\nghijkl") == "abc\ndef|"
    assert one(spark, text.history_text("t", 10, "|"), t="short") == "short"


@pytest.mark.parametrize("t,want", [("17 септ. 2026", "17.09.2026"), ("1.2.2020", "01.02.2020"), ("10.09.2026.", "10.09.2026"), ("5 мај 1999", "05.05.1999"), ("no date", None), ("", None)])
def test_printed_dates(spark, t, want):
    assert one(spark, dates.printed_date("t"), t=t) == want


def test_ticks_of_local_midnight(spark):
    assert one(spark, dates.date_ticks("t"), t="10.09.2026") == 639245880000000000


def test_html(spark):
    page = '<p>a&amp;b <a href="http://x:8081/api/files/1">doc</a></p><ul><li>one<li>two</ul><br>c<div>d</div>'
    got = one(spark, html.fix_links(html.html_to_text("t")), t=page)
    assert got == "a&b doc (http://x/CRMPublicPortalApi/api/files/1)\n\n- one\n- two\n\nc" + "d"
    assert one(spark, html.html_to_text("t"), t="plain &lt; text") == "plain < text"
    assert one(spark, html.infobox_value("t", "Статус"), t="<table><tr><td>Статус:</td><td><b>Активен</b></td></tr></table>") == "Активен"
    assert one(spark, html.infobox_value("t", "Нема"), t="<td>Статус</td><td>x</td>") == ""


def test_vectors(spark):
    v = one(spark, vectors.hash_embedding("t", 8), t="some words here")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and one(spark, vectors.hash_embedding("t", 8), t="") == [0.0] * 8
    assert one(spark, vectors.embedding_input("t", 3), t="abcdef") == "abc" and one(spark, vectors.embedding_input("t"), t="") == " "
