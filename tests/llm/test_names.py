"""Whole names are found and replaced: further parts, small words, inner capitals, capitals alone."""

import pytest

from quern.llm import pii

NAMES = [
    ("Dr. Ana Maria Lopez went.", ["Ana", "Maria", "Lopez"]), ("Maria García López, y más", ["Maria", "García", "López"]), ("Ms. McDonald and McDonald", ["McDonald"]), ("John O'Brien. O'Brien", ["John", "Brien"]),
    ("JOHN SMITH is here", ["JOHN", "SMITH"]), ("Frau Eva von der Leyen kam", ["Eva", "Leyen"]), ("Herr Jean-Luc de la Tour. Tour", ["Jean", "Luc", "Tour"]), ("Prof Željko Đorđević Šimić Kovač", ["Željko", "Đorđević", "Šimić", "Kovač"]), ("Mr. Иван Петров", ["Иван", "Петров"]),
]


@pytest.mark.parametrize(("text", "parts"), NAMES)
def test_no_part_of_a_name_stays(text, parts):
    for key in (b"k", b"other"):
        s, out, last = pii.Surrogates(key), "", 0
        for a, b, kind in pii.entities(text):
            assert kind == "name"
            out, last = out + text[last:a] + s.of(kind, text[a:b]), b
        out += text[last:]
        assert len(out.split()) == len(text.split()) and not any(p in out for p in parts)
        for small in ("von der", "de la", "Dr.", "Ms.", "Frau", "and"):
            assert (small in text) == (small in out)


def test_capitals_change_as_small_letters_do():
    s = pii.Surrogates(b"k")
    assert s.part("JOHN") == s.part("John").upper() and s.part("SMITH") == s.part("Smith").upper() and s.part("van") == "van"


def test_small_words_are_no_collision(spark):
    docs = spark.createDataFrame([(1, "Frau Eva von der Leyen und Herr Karl von Tal"), (2, "JOHN SMITH, John Smith")], "doc_id long, text string")
    assert pii.collisions(pii.distinct_entities(docs, b"k")).count() == 0
