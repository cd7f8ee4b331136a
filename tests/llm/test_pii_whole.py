import re

import pytest

from tests.llm.test_topk_licenses_pii import luhn, replaced


@pytest.mark.parametrize("length", [201, 4000])
def test_no_part_of_a_long_secret_stays(spark, length):
    token = ("aB3_" * length)[:length]
    new = replaced(spark, [f"token={token} end"])[0][0]
    assert re.fullmatch(r"token=[A-Za-z0-9_]{%d} end" % length, new)
    assert all(new[i : i + 12] not in token for i in range(6, 6 + length - 12))


def test_slashed_dates_with_the_month_first(spark):
    found = replaced(spark, ["on 12/31/1999.", "on 1999-12-31.", "on 13/13/1999.", "on 12/31/1899."])
    month, day, year = re.fullmatch(r"on (\d\d)/(\d\d)/(\d{4})\.", found[0][0]).groups()
    assert found[1][0] == f"on {year}-{month}-{day}." != "on 1999-12-31."
    assert found[2] == ("on 13/13/1999.", 0) and found[3] == ("on 12/31/1899.", 0)


def test_valid_numbers_are_found_before_more_digits_or_capitals(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    texts = [f"{card} 12/26", "x 4111111111111111 123", f"{iban} BIC COBADEFFXXX", f"{iban} 2024-01-05", f"{iban} AND", "1234 5678 9 2024-01-05", f"{card} {card} 7", "password=4111111111111111/secret99", "a \ufdd0\ufdd2 " + card, "4111111111111111@example.org"]
    found = replaced(spark, texts)
    assert [found[i][1] for i in range(10)] == [1, 1, 1, 2, 1, 1, 2, 1, 1, 1]
    assert luhn(found[0][0][:19]) and found[0][0][:19] != card and found[0][0].endswith(" 12/26")
    assert luhn(found[1][0][2:18]) and found[1][0][2:18] != "4111111111111111" and found[1][0].endswith(" 123")
    new = found[2][0][:27]
    assert new != iban and found[2][0] == f"{new} BIC COBADEFFXXX" and found[4][0] == f"{new} AND"
    assert found[3][0].startswith(new) and "2024-01-05" not in found[3][0]
    assert found[5][0].startswith("1234 5678 9 ") and found[5][0] != texts[5]
    assert found[6][0] == f"{found[0][0][:19]} {found[0][0][:19]} 7"
    assert "secret99" not in found[7][0] and found[8][0] == "a \ufdd0\ufdd2 " + found[0][0][:19]
    assert re.fullmatch(r"\d{16}@example.org", found[9][0])
