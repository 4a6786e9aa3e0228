"""Surrogates: planted mentions, coreference, crowded ranges and more names than two syllables can tell apart."""

import re

import pytest

from flowloom.llm import surrogates as S

KEY = b"key"
PLANTED = [
    # (text with {} for mentions, mentions)
    ("Today {} met {}.", ["John Smith", "Anna Meier"]),
    ("A letter from Mr. {} to Dr. {}, and none to the Smiths", ["Smith", "Smith"]),
    ("Frau {} wrote to {} and to {}", ["Meier", "anna.meier@mail.example.com", "ANNA.MEIER@MAIL.EXAMPLE.COM"]),
    ("господин {} и госпожа {} пришли", ["Иванов", "Иванова"]),
    ("госпожа {} ушла", ["Петровская"]),
    ("call {} or {} today", ["+1 (555) 123-4567", "+1 555 123 4567"]),
    ("hosts {} and {} of version 1.2.3.4.5", ["192.168.7.9", "8.8.4.4"]),
    ("card {}, number {} on file", ["4111 1111 1111 1111", "078-05-1120"]),
    ("nothing here on 2024-01-02 at 10:15, not even 12 or 3.14", []),
    ("Mr. {} and Ms. {} and Monsieur {}", ["Smith-Jones", "Zebulon Smith", "Badel"]),
]


@pytest.fixture(scope="module")
def planted(spark):
    docs = spark.createDataFrame([(i, text.format(*words)) for i, (text, words) in enumerate(PLANTED)], "doc_id long, text string")
    rows = {r.doc_id: r for r in S.replace_personal(docs.repartition(3), KEY).collect()}
    new = []
    for i, (text, words) in enumerate(PLANTED):
        assert rows[i]["__entities"] == len(words)
        m = re.fullmatch("(.+?)".join(map(re.escape, text.split("{}"))), rows[i].text)
        assert m, rows[i].text  # everything around the mentions is as before
        new.append(list(m.groups()))
    return new


def test_mentions_stay_coreferent(planted):
    john, anna = planted[0]
    assert planted[1] == [john.split(" ")[1]] * 2 and planted[2][0] == anna.split(" ")[1]
    assert planted[2][1].upper() == planted[2][2]
    man, woman = planted[3]
    assert woman == man + "а" and man.endswith("ов") and planted[4][0].endswith("ская") and S._script(man) == "cyrillic"
    assert re.sub(r"\D", "", planted[5][0]) == re.sub(r"\D", "", planted[5][1])
    assert planted[9][1].split(" ")[1] == john.split(" ")[1]


def test_replacements_keep_type_gender_and_format(planted):
    for (_, words), new in zip(PLANTED, planted):
        for a, b in zip(words, new):
            assert a != b and S._script(a) == S._script(b)
            if not re.search("[@ ]", a) or a[0] in "+4":
                assert re.sub(r"\d+", "9", a) == re.sub(r"\d+", "9", b) or a[0].isalpha()
    assert planted[0][0].split(" ")[0] in S.GIVEN["latin", "m"] and planted[0][1].split(" ")[0] in S.GIVEN["latin", "f"]
    assert planted[6][0].startswith("192.168.") and S._luhn(re.sub(r"\D", "", planted[7][0])) == 0 and "-" in planted[9][0]


def test_printed_names_differ_and_are_no_real_names(planted):
    old = {w for _, words in PLANTED for w in words}
    assert not old & {w for new in planted for w in new}
    assert planted[9][2] not in {w.split(" ")[-1] for new in planted[:2] for w in new}
    for names in S.GIVEN.values():
        assert sorted(S.given_name(KEY, n) for n in names) == sorted(names) and all(S.given_name(KEY, n) != n for n in names)


def test_more_surnames_than_short_words(spark):
    """50,000 titled surnames, where two or three syllables give 27,900."""
    letters = "abcdefghij"
    word = "concat('Q', " + ", ".join(f"substr('{letters}', int(id / {10**i}) % 10 + 1, 1)" for i in range(5)) + ")"
    names = spark.range(50_000).selectExpr("'person' as kind", f"{word} as norm")
    got = S.assign(names, KEY)
    assert got.count() == 50_000 == got.select("replacement").distinct().count()
    assert got.join(names.selectExpr("norm as replacement"), "replacement").count() == 0


def test_crowded_ranges(spark):
    """Nearly all addresses of a private range, and a full range of phone numbers, all get a replacement of their own."""
    ips = spark.range(60_000).selectExpr("'ip' as kind", "concat('192.168.', int(id / 256), '.', id % 256) as norm")
    phones = spark.range(100_000).selectExpr("'phone' as kind", "lpad(id, 5, '0') as norm")
    rows = S.assign(ips.union(phones), KEY).collect()
    assert len(rows) == 160_000 == len({(r.kind, r.replacement) for r in rows}) and all(r.norm != r.replacement for r in rows)
    assert all(re.fullmatch(r"192\.168\.\d+\.\d+" if r.kind == "ip" else r"\d{5}", r.replacement) for r in rows)


def test_permutations():
    assert sorted(S._turned(KEY, "x", v, 1000, lambda v: True) for v in range(1000)) == list(range(1000))
    odd = [S._turned(KEY, "x", v, 1000, lambda v: v % 2 == 1) for v in range(1, 1000, 2)]
    assert sorted(odd) == list(range(1, 1000, 2)) and all(a != b for a, b in zip(odd, range(1, 1000, 2)))
    for card in ("4111111111111111", "4111111111111112", "371449635398431"):
        new = S.permuted(KEY, "card", card)
        assert new != card and len(new) == len(card) and new[0] == card[0] and (S._luhn(new) == 0) == (S._luhn(card) == 0)
    assert S._private(S.permuted(KEY, "ip", "8.8.4.4")) == 0 and len(S.permuted(KEY, "social", "078051120")) == 9
    assert S.number_range("email", "a@b.cd")[0] is None
