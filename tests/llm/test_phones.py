"""Telephone numbers of any area and exchange are replaced, one to one."""

import re

from tideframe.llm import pii

KEY = "test-key"


def test_any_area_and_exchange(spark):
    numbers = [f"+1 ({a:03d}) {e:03d}-{n}" for a in (0, 17, 103, 555, 999) for e in (0, 55, 199, 555) for n in ("0000", "7713")]
    rows = spark.createDataFrame([(i, f"call {x} now") for i, x in enumerate(numbers)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows, KEY).collect()}
    assert all(r.n_phone == 1 for r in got.values())
    assert all(re.fullmatch(r"call \+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4} now", r.text) for r in got.values())
    assert len({r.text for r in got.values()}) == len(numbers)
    assert sum(numbers[i] in r.text for i, r in got.items()) == 0


def test_long_runs_do_not_end_the_matcher(spark):
    n = 100_000
    texts = ["x a@b" + ".c" * n + " end", "1" * n, "1." * n, "4 " * n, "+49" + " 1" * n, "DE89" + " ABCD" * n, "a" * n + "@" + "b" * n, "(555) " * n]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.pseudonymise(rows, KEY).collect()
    assert len(got) == len(texts) and all(r.text for r in got)


def test_formats_of_other_countries(spark):
    values = ["+49 30 1234567", "GB29NWBK60161331926819", "DE89 3704 0044 0532 0130 00", "31/12/2020", "31.12.2020", "2020-12-31"]
    rows = spark.createDataFrame([(i, f"it is {v}, yes") for i, v in enumerate(values)] + [(9, "see a@b..org and 13/13/2020 and DE89 3704 0044 0532 0130 01")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows, KEY).collect()}
    new = [got[i].text.removeprefix("it is ").removesuffix(", yes") for i in range(len(values))]
    assert all(len(a) == len(b) and a != b for a, b in zip(values, new, strict=True))
    shape = lambda x: re.sub("[0-9]", "0", x)
    assert [shape(x) for x in new] == [shape(x) for x in values]
    assert new[0].startswith("+49 ") and (got[0].n_phone, got[1].n_iban, got[2].n_iban) == (1, 1, 1)
    for x in new[1:3]:
        x = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    day, point, iso = new[3:]
    assert day.split("/") == point.split(".") == iso.split("-")[::-1]
    assert got[9].text == "see a@b..org and 13/13/2020 and DE89 3704 0044 0532 0130 01"
