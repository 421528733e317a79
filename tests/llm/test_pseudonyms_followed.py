"""Values that digits or capitals follow, which greedy patterns take in."""

import pytest

from vigilar.llm.pseudonyms import Permuter, pseudonymise

P = Permuter(b"test key")
CARDS = ["4111 1111 1111 1111", "4041894974608795", "3782 822463 10005", "4041-8949-7460-8795"]
IBANS = ["BE68 5390 0754 7034", "BE68539007547034", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]


@pytest.mark.parametrize("value", CARDS)
@pytest.mark.parametrize("after", [" 12/27", " 123", " 1", " 12 345", " 12/27 123", " 4041894974608795"])
def test_cards_followed_by_digits(value, after):
    text, counts = pseudonymise(f"card {value}{after} ok", P)
    assert value not in text and counts["card"] == (2 if len(after) > 10 else 1)
    if len(after) < 10:
        assert text.endswith(f"{after} ok")


@pytest.mark.parametrize("value", IBANS)
@pytest.mark.parametrize("after", [" BIC", " A", " OK THEN", " SWIFT CODE", " 1234"])
def test_ibans_followed_by_capitals(value, after):
    text, counts = pseudonymise(f"to {value}{after}", P)
    assert value not in text and counts == {"iban": 1} and text.endswith(after)


@pytest.mark.parametrize("text", ["4111 1111 1111 1112 12/27", "BE68 5390 0754 7035 BIC", "41111111111111111", "4111111111111111999", "BE685390075470341234"])
def test_invalid_or_longer_numbers_stay(text):
    assert pseudonymise(text, P)[0] == text
