"""Surrogates for personal data.

E-mail addresses, phone, card and social numbers, IPv4 addresses and names of persons are found in whole texts. Every entity, in a normal form that unites its
spellings, gets one replacement for the whole corpus, drawn with a secret key: of the same type, script and format. Replacements of different
entities differ, and none equals an entity that occurs: entities whose draw collides, all but the first of them, draw again until nothing
collides. Mentions of one entity anywhere get the same replacement, each in its own punctuation.

Names are replaced word by word, so that "John Smith", "Mr. Smith" and "Dr. Smith" go on sharing their surname. Listed given names change places
within their script and gender; every other word of a name gets made-up syllables of its script, and Russian endings that tell the gender stay.
A name always holds one made-up word, and no made-up word is a word of a real name, so printed names of different persons differ as well.

Draws widen with every attempt (more syllables, longer local parts of addresses). Numbers cannot: a range of them of which more than a quarter
occurs (say, the private addresses 192.168.*) is not drawn from but turned by a keyed permutation without fixed points. There replacements differ
from each other and from the entity they stand for, but may be the real value of another one.

A null text stays null; texts without an entity pass unchanged. Rows that agree in doc_id and text are rows of their own with equal results. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.plans.storage import discard, small_side, write_and_read

#: Titles with the gender they tell, and given names by script and gender.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f",
    "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n", "господин": "m", "госпожа": "f",
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Paul Peter Hans Jean Pierre Carlos José Luis".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Laura Maria Julia Claire Sophie Carmen Ana Lucía".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Николай Андрей Михаил Павел Виктор Олег".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Вера Нина".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da den dor fa fel gar ha hol ka ken lan lor ma mer mon na nel pa per ra ren sal sen ta tor va win".split(),
    "cyrillic": "ба бе бо ва ве го да де за ка ко ла ле ма ме на но па пе ра ро са се та то".split(),
}
_GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names}
#: Endings of Russian surnames that tell the gender.
_ENDING = re.compile("(.+?)(ова?|ева?|ина?|ск(?:ий|ая))")

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    ("social", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])(?:[3-6]\d{3}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])"),
    ("person", rf"(?<!\w)(?:(?P<title>{'|'.join(TITLES)})\.?[ ](?P<titled>{_NAME}(?:[ ]{_NAME})?)|(?P<full>(?:{'|'.join(_GENDER)})[ ]{_NAME}))(?!\w)"),
)
_FIND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
_HINT = re.compile(r"[@\d]|" + "|".join((*TITLES, *_GENDER)))

_FIELDS = "start:int,end:int,kind:string,words:array<string>"


def _script(text: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", text) else "latin"


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), leftmost first. A person's form is the name; the title stays in the text."""
    found = []
    if not text or not _HINT.search(text):
        return found
    for m in _FIND.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if m["person"]:
            kind = "person"
            norm = m["titled"] or m["full"]
            start, end = m.span("titled") if m["titled"] else m.span("full")
        else:
            kind = next(k for k, _ in PATTERNS if m[k])
            norm = m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub(r"\D", "", m[0])
        found.append((start, end, kind, norm))
    return found


def stem(word: str) -> tuple[str, str]:
    """A word of a name without and with only its ending of gender."""
    m = _ENDING.fullmatch(word)
    return m.groups() if m else (word, "")


def _is_given(words: list[str], i: int) -> bool:
    return i == 0 < len(words) - 1 and words[0] in _GENDER


def drawn_words(kind: str, norm: str) -> list[str]:
    """What of an entity is drawn for: the entity itself, or the words of a name that are not listed given names, without endings."""
    if kind != "person":
        return [norm]
    words = norm.split(" ")
    return [stem(w)[0] for i, w in enumerate(words) if not _is_given(words, i)]


class _Draws:
    """Numbers from the key, an entity and the attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.n, self.pool = hashlib.blake2b("\x00".join(parts).encode(), key=key).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value * n >> 32


def _like(text: str, draws: _Draws) -> str:
    """Letters for letters and digits for digits."""
    return "".join(
        "0123456789"[draws.below(10)] if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"[draws.below(26)] if c.isalpha() else c for c in text
    )


def _luhn(digits: str) -> int:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10


def _private(norm: str) -> int:
    """How many octets tell that an address is private or local."""
    return 1 if norm.startswith(("10.", "127.")) else 2 if norm.startswith(("192.168.", "172.16.")) else 0


def _country(norm: str) -> int:
    return max(0, len(norm) - 10)


def number_range(kind: str, norm: str) -> tuple[str | None, float]:
    """The range of numbers that an entity and its draws lie in, and how many draws it has; None where draws widen."""
    if kind == "ip":
        kept = _private(norm)
        return "ip " + ".".join(norm.split(".")[:kept]), (110 * 65536 * 254, 65536 * 254, 254 * 256)[kept]
    if kind == "social":
        return "social", 799e6
    if kind == "card":
        valid = _luhn(norm) == 0
        return f"card {norm[0]} {len(norm)} {valid}", 10.0 ** (len(norm) - 2) * (1 if valid else 9)
    if kind == "phone":
        kept = _country(norm)
        return f"phone {norm[:kept]} {len(norm)}", 0.8 * 10.0 ** (len(norm) - kept)
    return None, 0.0


def _turned(key: bytes, name: str, value: int, size: int, inside) -> int:
    """The next value inside along one keyed cycle through all numbers, so every value has its own and none is its own.

    The cycle adds one between a Feistel network and its inverse, over the least even number of bits that holds `size`.
    """
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(part: int, i: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{name}:{i}:{part}".encode(), key=key, digest_size=8).digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(8)):
            left, right = right ^ mixed(left, i), left
        left, right = divmod((((left << half) | right) + 1) & ((1 << 2 * half) - 1), mask + 1)
        for i in range(8):
            left, right = right, left ^ mixed(right, i)
        value = (left << half) | right
        if value < size and inside(value):
            return value


def permuted(key: bytes, kind: str, norm: str) -> str:
    """The replacement of a number whose range is crowded."""
    name = number_range(kind, norm)[0]
    always = lambda v: True
    if kind == "ip":
        octets, kept = norm.split("."), _private(norm)
        show = lambda v: ".".join([*octets[:kept], *(str(v >> 8 * i & 255) for i in reversed(range(4 - kept)))])
        value = sum(int(o) << 8 * i for i, o in enumerate(reversed(octets[kept:])))
        return show(_turned(key, name, value, 1 << 8 * (4 - kept), always if kept else lambda v: _private(show(v)) == 0))
    if kind == "card":
        check = lambda body: next(c for c in range(10) if _luhn(body + str(c)) == 0)
        body, width, off = norm[1:-1], len(norm) - 2, (int(norm[-1]) - check(norm[:-1])) % 10
        if off == 0:
            new, last = _turned(key, name, int(body), 10**width, always), 0
        else:
            new, last = divmod(_turned(key, name, int(body) * 9 + off - 1, 9 * 10**width, always), 9)
            last += 1
        new = f"{norm[0]}{new:0{width}}"
        return new + str((check(new) + last) % 10)
    kept = _country(norm) if kind == "phone" else 0
    width = len(norm) - kept
    return norm[:kept] + f"{_turned(key, name, int(norm[kept:]), 10**width, always):0{width}}"


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """A draw of the same kind: for `person` a word of a name, without ending of gender, else a normal form."""
    draws = _Draws(key, kind, norm, str(attempt))
    if kind == "email":
        local, domain = norm.split("@")
        labels = domain.split(".")
        of_domain = _Draws(key, "domain", domain)  # addresses of one domain keep a common domain
        return f"{_like(local + 'x' * (attempt // 4), draws)}@{'.'.join([*(_like(x, of_domain) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip":
        kept = _private(norm)
        public = [11 + draws.below(110), draws.below(256), draws.below(256), 1 + draws.below(254)]
        return ".".join([*norm.split(".")[:kept], *map(str, public[kept:])])
    if kind == "card":
        digits = norm[0] + "".join("0123456789"[draws.below(10)] for _ in norm[1:])
        valid = _luhn(norm) == 0  # a number that passes the check keeps passing it, another keeps failing
        return next(d for d in (digits[:-1] + str((int(digits[-1]) + c) % 10) for c in range(10)) if (_luhn(d) == 0) == valid)
    if kind == "phone":
        kept = _country(norm)
        return norm[:kept] + "23456789"[draws.below(8)] + "".join("0123456789"[draws.below(10)] for _ in norm[kept + 1:])
    if kind == "social":
        return str(100 + draws.below(799)) + "".join("0123456789"[draws.below(10)] for _ in norm[3:])
    syllables = _SYLLABLES[_script(norm)]
    while True:  # a made-up word must neither look as if it had an ending of gender nor be a listed given name
        word = "-".join(
            "".join(syllables[draws.below(len(syllables))] for _ in range(2 + draws.below(2) + attempt // 2)).capitalize() for _ in norm.split("-")
        )
        if not stem(word)[1] and word not in _GENDER:
            return word


def given_name(key: bytes, name: str) -> str:
    """The next listed name of the same script and gender along a keyed cycle."""
    names = GIVEN[_script(name), _GENDER[name]]
    cycle = sorted(names, key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
    return cycle[(cycle.index(name) + 1) % len(cycle)]


def dress(key: bytes, kind: str, surface: str, replacements: list[str]) -> str:
    """Replacements of `drawn_words`, in their order, in the punctuation and case of a mention."""
    if kind == "person":
        words, made = surface.split(" "), iter(replacements)
        return " ".join(given_name(key, w) if _is_given(words, i) else next(made) + stem(w)[1] for i, w in enumerate(words))
    replacement, = replacements
    if kind == "email":
        return replacement.upper() if surface.isupper() else replacement
    if kind == "ip":
        return replacement
    digits = iter(replacement)
    return "".join(next(digits) if c.isdigit() else c for c in surface)


def _found(text: Column) -> Column:
    @F.pandas_udf(f"array<struct<{_FIELDS}>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[(start, end, kind, drawn_words(kind, norm)) for start, end, kind, norm in find_entities(t)] for t in texts], dtype=object)

    return of(text)


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, replacement) for distinct entities (kind, norm): replacements differ within a kind and, but for crowded ranges, none is an entity.

    For `person`, norm is a word of `drawn_words`. Every round keeps, of the entities that drew the same, the one that comes first, and sends the others
    and those that drew an entity or a taken replacement into the next. Rounds are joins on the replacement, stored in the shared folder. In a range that
    is not crowded at least half of all draws are free, and wider draws nearly always are, so a few dozen rounds end at any number of entities.
    """

    def drawn(attempt: int) -> Column:
        @F.pandas_udf("string")
        def of(kinds: pd.Series, norms: pd.Series) -> pd.Series:
            return pd.Series([surrogate(key, k, n, attempt) for k, n in zip(kinds, norms)], dtype=object)

        return of(F.col("kind"), F.col("norm"))

    @F.pandas_udf("struct<range:string,draws:double>")
    def ranged(kinds: pd.Series, norms: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([number_range(k, n) for k, n in zip(kinds, norms)], columns=["range", "draws"])

    @F.pandas_udf("string")
    def turned(kinds: pd.Series, norms: pd.Series) -> pd.Series:
        return pd.Series([permuted(key, k, n) for k, n in zip(kinds, norms)], dtype=object)

    known = write_and_read(entities.select("kind", "norm").distinct().withColumn("__in", ranged("kind", "norm")), "entities")
    full = small_side(known.groupBy("__in").count().where(F.col("__in.range").isNotNull() & (F.col("count") * 4 > F.col("__in.draws"))).select(
        F.col("__in.range").alias("range"), F.lit(True).alias("__full")
    ))
    marked = known.withColumn("range", F.col("__in.range")).join(full, "range", "left").select("kind", "norm", F.col("__full").isNotNull().alias("__full"))
    real = known.select("kind", F.col("norm").alias("replacement"))
    settled = write_and_read(marked.where("__full").select("kind", "norm").withColumn("replacement", turned("kind", "norm")), "settled")
    open_, attempt = marked.where("not __full").select("kind", "norm"), 0
    while True:
        drew = write_and_read(open_.withColumn("replacement", drawn(attempt)), "drawn")
        free = drew.join(real, ["kind", "replacement"], "left_anti").join(settled.select("kind", "replacement"), ["kind", "replacement"], "left_anti")
        kept = write_and_read(free.groupBy("kind", "replacement").agg(F.min("norm").alias("norm")).select("kind", "norm", "replacement"), "kept")
        before, settled = settled, write_and_read(settled.union(kept), "settled")
        left = write_and_read(drew.select("kind", "norm").join(kept.select("kind", "norm"), ["kind", "norm"], "left_anti"), "open")
        discard(before, drew, kept)
        if not left.limit(1).count():
            return settled
        if attempt:
            discard(open_)
        open_, attempt = left, attempt + 1


def replace_personal(docs: DataFrame, key: bytes) -> DataFrame:
    """`docs` with surrogates in `text`, and `__entities`, the number of mentions replaced.

    Rows without a mention pass by without a shuffle. The others are stored with their mentions and a number; mentions, not texts, meet the
    replacements, and come back by that number.
    """
    spotted = docs.withColumn("__found", _found(F.col("text")))
    held = write_and_read(spotted.where(F.size("__found") > 0).withColumn("__row", F.monotonically_increasing_id()), "mentions")
    mentions = held.select("__row", F.explode("__found").alias("m")).select("__row", "m.start", "m.end", "m.kind", F.posexplode("m.words").alias("nth", "norm"))
    chosen = assign(mentions, key)
    back = mentions.join(chosen, ["kind", "norm"]).groupBy("__row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "nth", "replacement"))).alias("__new")
    ).withColumnRenamed("__row", "__of")

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for text, words in zip(texts, news):
            parts, at = [], 0
            for (start, end, kind), spans in groupby(words, key=lambda w: (w["start"], w["end"], w["kind"])):
                parts += [text[at:start], dress(key, kind, text[start:end], [s["replacement"] for s in spans])]
                at = end
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    names = docs.columns
    changed = held.join(back, F.col("__row") == F.col("__of")).withColumn("__text", rewrite(F.col("text"), F.col("__new")))
    changed = changed.select(*[F.col("__text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names], F.size("__found").cast("long").alias("__entities"))
    plain = spotted.where(F.coalesce(F.size("__found"), F.lit(0)) == 0)
    return plain.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("__entities")).union(changed)
