import pytest

from hexloom.llm.names import core_words, distance, fold, grams, soft_likeness, word_likeness
from hexloom.llm.variants import Aliases, likeness, parsed

ALIASES = Aliases.of([("Khaled", "Khaloud"), ("Khaled", "خالد"), ("Mohamed", "Hamada"), ("Mostafa", "Sasa"), ("Hassan", "Abu Ali"), ("William", "Bill")])


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("El Khubaza-Thazija bakery 4060009", "Khobaza Thaziga Bakery"), ("Khubazathazija Bak.", "Khubaza Thazija Bakery - Minya Sul"), ("عيادة جاوويا نيساتا", "Jawuya Nisata Clinic"),
        ("Zughaku Lazadha ( زوغاكو لازاذا )", "زوغاكو لازاذا"), ("Muququ Fyfyla Real Estate", "Feefila Muququ R.E."),
    ],
)
def test_variants_are_alike(a, b):
    assert soft_likeness(core_words(a), core_words(b)) >= 0.84


def test_others_are_not():
    assert soft_likeness(core_words("Khazata Dhubahi Pizza"), core_words("Khazata Milufu Pizza")) < 0.84
    assert core_words(None) == core_words("") == core_words("Pizza 123") == ()
    assert fold("") == "" and grams([""]) == {""} and soft_likeness((), ("a",)) == 0
    assert distance("abcd", "abdc") == 1 and distance("a", "abcdef", 2) == 3 and word_likeness("ab", "ac") == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("prof khaledzutumu tajaghu", "K. Zutumu Tajaghu", True), ("د. خالد زوتومو تاجاغو", "Khaloud Zutumu Tajaghu", True), ("Tajaghu, Khaled Zutumu", "ZUTUMU TAJAGHU KHALED", True),
        ("Khaled Zutumu Tajaghu", "Mohamed Zutumu Tajaghu", False), ("M. Zutumu Tajaghu", "Khaled Zutumu Tajaghu", False), ("William H. Juweema", "Juwima, William Himumi", True),
        ("Abu Ali Tibumu Thikami", "Hassan Tibumu Thikami", True), ("Khaled Zutumu Tajaghu", "Zutumu Tajaghu Bakery", False), ("Wiliam Himumi Juwima", "Bill Himumi Juwima", True),
    ],
)
def test_persons(a, b, same):
    assert (likeness(parsed(a, ALIASES), parsed(b, ALIASES), lambda w: 1.0) >= 0.84) == same
