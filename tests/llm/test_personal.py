import random

import pytest

from leafmill.llm.personal import feistel_digits, feistel_undo, find, found_pieces, permute_date, pseudonym, redact, redacted


def pieces(text):
    return sorted((k, " ".join(text[a:b].split())) for a, b, k in find(text))


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("Write to d.smith+x@mail.example.org, please.", [("email", "d.smith+x@mail.example.org")]),
        ("mail: ann [at] mail [dot] example", [("email", "ann [at] mail [dot] example")]),
        ("mail: ann @\nmail.example now", [("email", "ann @ mail.example")]),
        ("The @ key is broken; the l@ter report.", []),
        ("Call (555) 555-0147 ext. 12 or +44 1632 960001.", [("phone", "(555) 555-0147 ext. 12"), ("phone", "+44 1632 960001")]),
        ("Fax sent to 020 7946 0300. Telephone: 555-0116", [("phone", "020 7946 0300"), ("phone", "555-0116")]),
        ("Lot 143.508.5675 was not listed. The meter showed 957 104 2927 units. Claim number 0965-81-8299.", []),
        ("produced SSN 934-23-6777 on request; taxpayer number 934601473", [("id_number", "934-23-6777"), ("id_number", "934601473")]),
        ("national insurance QQ 81 20 42\nC and passport no. P6276631", [("id_number", "P6276631"), ("id_number", "QQ 81 20 42 C")]),
        ("Order no. 101455795 was cancelled. Invoice 555-23781. Form 1910-24-B.", []),
        ("driver licence T298-1995-0491 and Serial P379-0480", [("id_number", "T298-1995-0491")]),
        ("lives at 8991 S. Tallow Mill St., Flat 4, Wexton", [("address", "8991 S. Tallow Mill St., Flat 4")]),
        ("Calle Tallow Mill 24 and Windlestraße 40", [("address", "Calle Tallow Mill 24"), ("address", "Windlestraße 40")]),
        ("near the corner of Alderfen Street, at Pellbrook Clinic of the Kestrel County District Court", []),
        ("Dr. Zelmund R. Harnshaw-Kerdale saw GRIMOCKS, O. and K. Bulander.", [("person", "GRIMOCKS, O."), ("person", "K. Bulander"), ("person", "Zelmund R. Harnshaw-Kerdale")]),
        ("Yesterday Zelmund\nHarnshaw left. Around May 2020 the Osprey Bank Archive closed.", [("person", "Zelmund Harnshaw")]),
        ("SCAN SCAN SCAN", []),
        ("", []),
        (None, []),
        (" \n", []),
    ],
)
def test_find(text, wanted):
    assert pieces(text) == sorted(wanted)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3):
        every = [str(k).zfill(n) for k in range(10**n)]
        moved = [feistel_digits(d, b"k") for d in every]
        assert sorted(moved) == every and [feistel_undo(m, b"k") for m in moved] == every
    rng = random.Random(1)
    for n in (7, 9, 10, 16):
        d = "".join(rng.choice("0123456789") for _ in range(n))
        assert feistel_undo(feistel_digits(d, b"k"), b"k") == d and feistel_digits(d, b"k") != feistel_digits(d, b"other")
    days = [permute_date(d, 100, 465, b"k") for d in range(100, 466)]
    assert sorted(days) == list(range(100, 466))


def test_equal_values_stay_linked():
    a, b = pseudonym("934-23-6777", "id_number", b"k"), pseudonym("934 23 6777", "id_number", b"k")
    assert a.startswith("[ID_NUMBER ") and a.replace("-", "") == b.replace(" ", "", 3).replace("[ID_NUMBER", "[ID_NUMBER ") or [c for c in a if c.isdigit()] == [c for c in b if c.isdigit()]
    assert pseudonym("K. Bulander", "person", b"k") == pseudonym("k  bulander", "person", b"k")


def test_redaction_keeps_the_rest(spark):
    text = "We asked K. Bulander (555-0116, telephone) about May 2020."
    out = redact(text, b"k")
    assert out.startswith("We asked [PERSON ") and out.endswith(", telephone) about May 2020.") or out.endswith(" about May 2020.")
    assert "Bulander" not in out and redact("nothing here", b"k") == "nothing here" and redact(None, b"k") is None
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (None, text, "x")], "page_id bigint, text string, kind string")
    assert {tuple(r) for r in found_pieces(df).collect()} >= {(1, "person", "K. Bulander")}
    assert found_pieces(df).count() == len(set(pieces(text))) and found_pieces(df.limit(0)).count() == 0
    assert redacted(df, b"k").where("text is null").count() == 1
    assert find("word " * 200_000 + "K. Bulander") == [(1_000_000, 1_000_011, "person")]


def test_numbers_no_kind_allows_are_no_pieces():
    from leafmill.llm.personal import find, phone_parts

    for text in ("SSN 000-12-3456", "SSN 666-12-3456", "SSN 123-00-4567", "SSN 123-45-0000", "NI number BG 12 34 56 A", "call 155-123-4567", "call 212-155-4567"):
        assert find(text) == [], text
    assert [k for *_, k in find("SSN 123-45-6789 and NI number AB 12 34 56 A")] == ["id_number"] * 2
    assert phone_parts("+44 20 7946 0958") == phone_parts("020 7946 0958") == ("44", "2079460958", "")
    assert phone_parts("+1 212 555 0143 x12") == ("1", "2125550143", "12")


def test_equal_phones_stay_linked_in_any_spelling():
    from leafmill.llm.personal import pseudonym

    key = b"k"
    digits = lambda t: "".join(c for c in t if c.isdigit())
    a, b, c = (pseudonym(t, "phone", key) for t in ("+1 212 555 0143", "212-555-0143", "(212) 555-0143 x7"))
    assert digits(a)[1:] == digits(b) == digits(c)[:10] != "2125550143" and a.startswith("[PHONE +1 ")
    assert digits(pseudonym("+44 20 7946 0958", "phone", key))[2:] == digits(pseudonym("020 7946 0958", "phone", key))[1:]


def test_dates_of_a_person_are_permuted_in_their_format():
    import datetime
    import re

    from leafmill.llm.personal import redact

    key = b"k"
    out = redact("DOB: 1981-03-12, born 12 March 1981, hearing on 1981-03-12. DOB 1981-02-31", key)
    iso = re.search(r"DOB: \[DATE (\d{4}-\d\d-\d\d)\]", out)[1]
    moved = datetime.date.fromisoformat(iso)
    assert moved != datetime.date(1981, 3, 12)
    assert f"[DATE {moved.day} {moved:%B} {moved.year}]" in out
    assert "hearing on 1981-03-12." in out and out.endswith("DOB 1981-02-31")


def test_places_are_no_persons_and_accents_belong_to_names():
    from leafmill.llm.personal import find

    assert [t for t in ("New York", "South Africa", "Great Britain", "Machine Learning") if find(f"They went to {t}.")] == []
    text = "It was María-José García who came."
    assert [text[a:b] for a, b, k in find(text) if k == "person"] == ["María-José García"]
