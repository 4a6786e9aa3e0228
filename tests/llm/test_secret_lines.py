"""The secret automaton against regular expressions: all rules, lanes that begin inside matches, and long lines without a cutting byte."""

import random
import re
import time

from flowloom.llm.secret_scan import BASE, MORE, scanner

RULES = (*BASE, *MORE)
PARTS = [
    "password", "token: ", 'api_key="', "=", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "eyJ", ".eyJabc.", "-----BEGIN ", "RSA PRIVATE KEY-----",
    "PRIVATE KEY-----", "ghp_", "a" * 40, "xoxb-", "12345-abc", "AIza", "sk_live_", " ", "  ", "\n", "é", "SECRET", '"', "'", ".", "deadbeef" * 3, "日本",
]


def expected(text):
    found = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text):
            head = re.compile(rule.head).match(text, m.start()).end() if rule.head else m.start()
            if m.end() - head >= rule.least:
                found.append((m.start(), m.end(), k))
    return sorted(found, key=lambda x: (x[0], x[2]))


def mixed(rnd, n):
    return "".join(rnd.choice(PARTS) for _ in range(n))


def test_all_rules():
    rnd = random.Random(7)
    for _ in range(60):
        texts = [mixed(rnd, rnd.randrange(60)) for _ in range(rnd.randrange(1, 30))] + [None, ""]
        assert scanner(RULES).scan(texts) == [expected(t or "") for t in texts]
    met = {k for _ in range(40) for _, _, k in expected(mixed(rnd, 3000))}
    assert met == set(range(len(RULES)))
    long = mixed(rnd, 40_000)
    assert scanner(RULES).scan([long, "x", long]) == [expected(long), [], expected(long)]


def test_lanes_that_never_reset():
    texts = ["password" + " " * 300_000 + "=secretvalue", "password='" + "a" * 300_000, "eyJ" * 100_000 + ".eyJ-", "eyJ" * 50_000 + ".eyJ-.x" + "é" * 50]
    for text in texts[:2]:
        assert scanner(RULES).scan([text]) == [expected(text)]
    assert scanner(RULES).scan(texts[2:]) == [[], [(0, 150_007, 6)]]


def test_one_line_is_linear():
    rnd = random.Random(1)
    words = ["lorem", "ipsum", "password", "alpha", "seat", "token", "spade", "cafe"]
    line, cut = (s.join(rnd.choice(words) for _ in range(n)) for s, n in ((" ", 300_000), (", \n", 250_000)))
    took = {}
    for text in (line, cut):
        begin = time.perf_counter()
        for _ in range(3):
            assert scanner(RULES).scan([text]) == [[]]
        took[text] = time.perf_counter() - begin
    assert took[line] < 3 * took[cut] + 0.5
    assert scanner(RULES).scan([line + " password=abcdef1234"]) == [[(len(line) + 1, len(line) + 20, 0)]]
