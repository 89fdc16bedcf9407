"""Detectors against known values."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import detectors, names

CASES = [
    ("card", "Card: 4111 1111 1111 1111 on file.", ["4111 1111 1111 1111"]),
    ("card", "4111-1111-1111-1111", ["4111-1111-1111-1111"]),
    ("card", "4111111111111111", ["4111111111111111"]),
    ("card", "378282246310005", ["378282246310005"]),
    ("card", "4111 2222 3333 4444", ["4111 2222 3333 4444"]),
    ("card", "3782-510098-10025", ["3782-510098-10025"]),
    ("card", "1234567890123456", []),
    ("card", "0000000000000000", []),
    ("card", "9999999999999995", ["9999999999999995"]),
    ("ssn", "SIN: 046-454-286", ["046-454-286"]),
    ("ssn", "SIN 123-456-789", []),
    ("ssn", "Number 123-45-6789", ["123-45-6789"]),
    ("ssn", "000-12-3456 666-12-3456 923-12-3456 123-00-4567 123-45-0000", []),
    ("ssn", "046454286", []),
    ("ssn", "social insurance 046454286", ["046454286"]),
    ("ssn", "***-**-4819 and ***-***-286 not ***-**-48190", ["***-***-286", "***-**-4819"]),
    ("bank", "routing 122000496, account number 9981827364", ["122000496", "9981827364"]),
    ("bank", "122000496 and acct. 12345 and ACCT 123456-", []),
    ("phone", "+1 (555) 382-9104 or 555-842-1099 or 1-800-555-DATA", ["+1 (555) 382-9104", "555-842-1099", "1-800-555-DATA"]),
    ("phone", "5558421099 and 1-800-555-DATAS", []),
    ("address", "at 742 Evergreen Terrace, Suite 400, Springfield, OR 97477.", ["742 Evergreen Terrace, Suite 400, Springfield, OR 97477"]),
    ("address", "742 evergreen terrace, Springfield, OR 97477", []),
    ("url", "see https://example.org/a?b=1).\x1flabel", ["https://example.org/a?b=1"]),
    ("url", "(http://a.b/c)! ftp://x.y", ["http://a.b/c"]),
    ("email", "Mail John.Doe@Example.com. or a@b.c9 or x@y.org- and bare@host", ["John.Doe@Example.com", "x@y.org"]),
    ("ip", "10.0.0.1 999.1.1.1 1.2.3.4.5 fe80:0:0:1:2:3:4:5 a:b::c", ["10.0.0.1", "fe80:0:0:1:2:3:4:5"]),
    ("person", "Tariq Ibn Ziyad Systems Architect", ["Tariq Ibn Ziyad"]),
    ("person", "Contact Email Quality Assurance Access Logs NASA ESA", []),
    ("person", "Jane Roe's phone. Jane Roe again, JaneRoe", ["Jane Roe", "Jane Roe"]),
    ("person", "Éric Tremblay", []),
    ("names", "Brigitte Von Schwenk Quality Assurance", ["Brigitte Von Schwenk"]),
    ("names", "John Doe's phone; Acme Widgets Inc filed", ["John Doe", "Acme Widgets Inc"]),
]
BUILD = {
    "card": detectors.credit_card,
    "ssn": detectors.social_number,
    "bank": detectors.bank_account,
    "phone": detectors.phone,
    "address": detectors.address,
    "url": detectors.url,
    "email": detectors.email,
    "ip": detectors.ip_address,
    "person": names.person_sequences,
    "names": names.lexicon_names,
}


@pytest.mark.parametrize("kind", sorted(BUILD))
def test_values_and_offsets(spark, kind):
    texts = [(t, w) for k, t, w in CASES if k == kind] + [("", []), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i long, text string")
    rows = df.select("i", "text", BUILD[kind](F.col("text")).alias("d")).orderBy("i").collect()
    for row, (text, wanted) in zip(rows, texts, strict=True):
        found = row.d or []
        assert [d.value for d in found] == (wanted or []), text
        assert all(text[d.start : d.end] == d.value for d in found)


def test_card_confidence_and_brand(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("9999999999999995",), ("4111 2222 3333 4444",)], "text string")
    found = [r.d[0] for r in df.select(detectors.credit_card(F.col("text")).alias("d")).collect()]
    assert [d.confidence for d in found] == [0.98, 0.75, 0.86]
    assert found[0].metadata == {"cardBrand": "Visa", "last4": "1111"}
    assert found[1].metadata == {"last4": "9995"}


def test_many_matches_have_right_offsets(spark):
    text = "é " + " ".join(f"u{i}@x.org" for i in range(500))
    row = spark.createDataFrame([(text,)], "text string").select(detectors.email(F.col("text")).alias("d")).first()
    assert len(row.d) == 500
    assert all(text[d.start : d.end] == d.value for d in row.d)


def test_name_helpers():
    assert names.clipped("Eleanor Roosevelt-Smith  Contact Email") == "Eleanor Roosevelt-Smith"
    assert names.clipped("Marcus Vance (ID") == "Marcus Vance"
    assert len(names.NAME_ENDS) == 120 and len(names.HEADINGS) == 80
