"""Surrogates for personal data and secrets.

Entities are found by one pattern per kind. Each is replaced by a value of its
own kind that looks like it: letters stay letters of their case and script,
digits digits, punctuation, country codes, key prefixes and check digits keep
their form. Replacements are keyed: a permutation of all values of the same form
(a Feistel network over mixed radixes, walked until it stays in range), so one value
always gets one surrogate and two values of one form never share one.

People are found by their titles, and then by the same names without a title in the
same text. A name is replaced word by word, vowels by vowels and consonants by
consonants of its script, so "Ms. Ada Byron", "Dr Byron" and "Ada" stay one person in
all texts. Titles stay; a given name gets the ending of the gender that the titles
before it tell in the whole corpus (of both genders or none: no ending).

Collisions are checked over the whole corpus: where two values have one
surrogate, or a surrogate is itself a value that occurs, the later one (in the
order of values) is drawn anew until none is left, from some draw on in longer forms.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapweave.llm._common import written

# Titles and the gender that they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
# Vowels and consonants by script, and endings of given names by gender.
LETTERS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
ENDINGS = {"latin": ("", "no", "na"), "cyrillic": ("", "мир", "на"), "greek": ("", "νος", "να")}
_CLASSES = tuple(f(x) for pair in LETTERS.values() for x in pair for f in (str.lower, str.upper))
#: Bits of the genders that titles tell.
GENDER = {"n": 0, "m": 1, "f": 2}
_WORD = r"[^\W\d_]"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_FIND = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<awskey>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<token>\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}\b)"
    r"|(?P<password>(?<=password=)[^\s\"']{4,}|(?<=password: )[^\s\"']{4,})"
    r"|(?P<hexkey>\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,128}\b)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d-])(?=4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3(?:0[0-5]|09|[4-9])|6(?:011|2|4[4-9]|5))(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\d)|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!\d)|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-]))"
    rf"|(?P<name>(?<!\w)(?:{_TITLE})\.?(?: {_WORD}+(?:-{_WORD}+)*){{1,3}})"
)
_SAID = re.compile(rf"(?<!\w){_WORD}+(?:-{_WORD}+)*(?!\w)")
_MAYBE = re.compile(r"[0-9@]|password|AKIA|ASIA|(?:sk|pk|ghp|gho|xox[abp])[-_]")
# Characters of an IBAN by country.
IBAN_LENGTH = dict(zip(
    "AD AE AL AT AZ BA BE BG BH BI BR BY CH CR CY CZ DE DJ DK DO EE EG ES FI FK FO FR GB GE GI GL GR GT HN HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MN MR MT MU NI NL NO OM PK PL PS PT QA RO RS RU SA SC SD SE SI SK SM SO ST SV TL TN TR UA VA VG XK YE".split(),
    map(int, "24 23 28 20 28 20 16 22 22 27 29 28 21 22 28 24 22 27 18 28 20 29 24 18 18 18 27 22 22 23 18 27 28 28 21 28 22 23 23 26 27 30 30 20 28 32 21 20 20 21 25 27 24 22 19 20 27 31 30 28 18 15 23 24 28 29 25 29 24 22 33 24 31 18 24 19 24 27 23 25 28 23 24 26 29 22 24 20 30".split()),
))
_LEAD = {"awskey": 4, "token": 3, "iban": 2}


def luhn(digits: str) -> int:
    """Check digit for these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban(value: str, after: str) -> str | None:
    """The IBAN that ``value`` starts with, cut to its country's length; ``after`` is the character behind ``value``."""
    size = IBAN_LENGTH.get(value[:2])
    if size:
        ends = [i + 1 for i, c in enumerate(value) if c != " "]
        if len(ends) < size:
            return None
        value, after = value[: ends[size - 1]], (value + after)[ends[size - 1] :][:1]
    s = value.replace(" ", "")
    whole = not (after.isalnum() or after == "_")
    return value if whole and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else None


def _checked(kind: str, value: str, after: str) -> str | None:
    """What of a match is an entity: its start, as far as its checks and words go."""
    if kind == "iban":
        return _iban(value, after)
    if kind == "card":
        digits = "".join(filter(str.isdigit, value))
        return value if 13 <= len(digits) <= 19 and int(digits[-1]) == luhn(digits[:-1]) else None
    if kind == "name":
        title, *words = value.split(" ")
        named = list(itertools.takewhile(lambda w: w[0].isupper(), words))
        return " ".join([title, *named]) if named else None
    return value


def scan(text: str) -> list[tuple[int, int, str, str, int]]:
    """(start, end, kind, value, gender) of the entities of a text, in order, none overlapping; a rejected match hides nothing behind its first character.

    Each word of a name is an entity of its own, behind a title or not, if it stands behind
    one anywhere in the text; ``gender`` has the bits of what a title tells of a given name.
    """
    if not _MAYBE.search(text) and not any(t in text for t in TITLES):
        return []
    out, at, titled = [], 0, {}
    while m := _FIND.search(text, at):
        start, end = m.span()
        value = _checked(m.lastgroup, m[0], text[end : end + 1])
        at = start + (1 if value is None else len(value))
        if value is None:
            continue
        if m.lastgroup != "name":
            out.append((start, at, m.lastgroup, value, 0))
            continue
        title, *said = value.split(" ")
        place = start + len(title) + 1
        for i, word in enumerate(said):
            titled[word] = titled.get(word, 0) | (GENDER[TITLES[title.rstrip(".")]] if i + 1 < len(said) else 0)
            out.append((place, place + len(word), "name", word, 0))
            place += len(word) + 1
    if titled:
        taken, k, more = sorted(out), 0, []
        for m in _SAID.finditer(text):
            if m[0] in titled:
                while k < len(taken) and taken[k][1] <= m.start():
                    k += 1
                if k == len(taken) or taken[k][0] >= m.end():
                    more.append((*m.span(), "name", m[0], 0))
        out = [(*e[:4], titled[e[3]]) if e[2] == "name" else e for e in sorted(out + more)]
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """``scan`` without genders."""
    return [e[:4] for e in scan(text)]


def _permute(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of ``range(size)``: eight Feistel rounds over the next even number of bits, repeated while out of range."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(8):
            said = b"/".join([key, tweak, b"%d" % r, right.to_bytes((half + 7) // 8, "big")])
            f = int.from_bytes(hashlib.shake_256(said).digest((half + 7) // 8), "big")
            left, right = right, left ^ (f & mask)
        x = left << half | right
        if x < size:
            return x


#: Draw from which a form counts as nearly full and surrogates get longer, so that redrawing ends.
WIDEN = 8
#: Draws after which something is wrong: forms have grown by dozens of characters then.
ROUNDS = 64
_PUNCTUATION = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_DIGIT, _LOWER, _UPPER, _HEX, _KEY = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@functools.lru_cache(4096)
def _like(c: str) -> str:
    """Characters that may stand for one that is no ASCII letter or digit: punctuation, or its category among its 256 neighbours."""
    if c in _PUNCTUATION:
        return _PUNCTUATION
    first = max(128, ord(c) & ~0xFF)
    return "".join(x for x in map(chr, range(first, (ord(c) | 0xFF) + 1)) if unicodedata.category(x) == unicodedata.category(c) and not x.isspace())


def _hashed(n: int, key: bytes, tweak: str) -> str:
    """A keyed string of ``n`` letters and digits."""
    h = int.from_bytes(hashlib.shake_256(key + tweak.encode()).digest(n + 16), "big")
    out = []
    for _ in range(n):
        h, i = divmod(h, 36)
        out.append((_DIGIT + _LOWER)[i])
    return "".join(out)


def _permuted(value: str, sets: list[str], key: bytes, tweak: str) -> str:
    """``value`` permuted among all strings whose characters are in ``sets``; where a set is empty, the character stays."""
    size, x = 1, 0
    for c, s in zip(value, sets):
        if s:
            size *= len(s)
            x = x * len(s) + s.index(c)
    form = "".join("." if s else c for c, s in zip(value, sets)) + "/" + ",".join(str(len(s)) for s in sets)
    x = _permute(x, size, key, f"{tweak}/{form}".encode())
    out = []
    for c, s in zip(reversed(value), reversed(sets)):
        if s:
            x, i = divmod(x, len(s))
            c = s[i]
        out.append(c)
    return "".join(reversed(out))


def _same_form(value: str, key: bytes, tweak: str, alphabet: str = "", every: bool = False) -> str:
    """``value`` permuted among all strings of its form: each letter or digit stays one of its alphabet, other characters stay, or with ``every`` stay of their kind."""
    sets = [alphabet if alphabet and c in alphabet else next((s for s in (_DIGIT, _LOWER, _UPPER) if c in s), _like(c) if every else "") for c in value]
    return _permuted(value, sets, key, tweak)


def _name(word: str, key: bytes, tweak: str, wider: int, gender: int) -> str:
    """A word of a name: vowels stay vowels and consonants consonants of their script; then the ending for a gender, before it ``wider`` syllables."""
    new = _permuted(word, [next((s for s in _CLASSES if c in s), "" if c == "-" else _like(c)) for c in word], key, tweak)
    script = next((s for s, (a, b) in {"cyrillic": (0x400, 0x52F), "greek": (0x370, 0x3FF)}.items() if a <= ord(word[-1]) <= b), "latin")
    h = int.from_bytes(hashlib.shake_256(f"{tweak}/{word}".encode() + key).digest(16 + wider), "big")
    vowels, consonants = LETTERS[script]
    for _ in range(wider):
        h, i = divmod(h, len(vowels) * len(consonants))
        new += consonants[i % len(consonants)] + vowels[i // len(consonants)]
    new += ENDINGS[script][gender % 3]
    return new.upper() if word.isupper() and len(word) > 1 else new


def surrogate(kind: str, value: str, key: bytes, draw: int = 0, gender: int = 0) -> str:
    """The replacement of ``value``; another one for each ``draw``, and from draw ``WIDEN`` a longer one where the form may be full. ``gender``: bits that tell a given name's, both like none."""
    tweak = f"{kind}/{draw}"
    wider = max(0, draw - WIDEN + 1)
    if kind == "email":
        local, host = value.rsplit("@", 1)
        if not re.search(r"(^|\.)example\.(com|org|net)$", host, re.I):
            name, top = host.rsplit(".", 1)
            host = f"{_same_form(name, key, 'host')}.{top}"
        if wider:
            return f"{_hashed(len(local) + wider, key, f'{tweak}/{value}')}@{host}"
        return f"{_same_form(local, key, f'{tweak}/{host}')}@{host}"
    if kind == "ip":
        x = _permute(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32, key, tweak.encode())
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card":
        digits = "".join(filter(str.isdigit, value))
        lead = digits[: 1 if digits[0] == "4" else 4 if digits.startswith(("2", "6011")) else 3 if digits.startswith(("30", "64")) else 2]
        new = lead + _same_form(digits[len(lead) : -1], key, f"{tweak}/{lead}")
        new += str(luhn(new))
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in value)
    if kind == "iban":
        plain = value.replace(" ", "")
        body = _same_form(plain[4:], key, f"{tweak}/{plain[:2]}")
        rest = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        it = iter(f"{plain[:2]}{98 - rest:02d}{body}")
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "phone":
        lead = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+", value)
        cut = lead.end() if lead else 0
        rest = value[cut:]
        if wider and sum(map(str.isdigit, rest)) < 9:
            rest += "-0000"
        return value[:cut] + _same_form(rest, key, f"{tweak}/{value[:cut]}")
    if kind == "name":
        return _name(value, key, tweak, wider, gender)
    lead = _LEAD.get(kind, 0)
    if kind in ("password", "token") and (wider or not re.search("[^_-]", value[lead:])):
        return value[:lead] + _hashed(len(value) - lead + wider, key, f"{tweak}/{value}")
    return value[:lead] + _same_form(value[lead:], key, f"{tweak}/{value[:lead]}", {"awskey": _KEY, "hexkey": _HEX, "password": _HEX if re.fullmatch("[0-9a-f]+", value) else ""}.get(kind, ""), every=kind == "password")


def _entities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, marks, texts = (b.column(i).to_pylist() for i in range(3))
        rows = [(i, m, *e) for i, m, t in zip(ids, marks, texts) for e in {e[2:] for e in scan(t or "")}]
        cols = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["d", "t", "kind", "value", "gender"])


def _draw(key: bytes, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kind, value, gender, draw = (b.column(i).to_pylist() for i in range(4))
        new = [surrogate(k, v, key, n, g) for k, v, g, n in zip(kind, value, gender, draw)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "value", "gender", "draw", "surrogate"])


def redrawn(values: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, gender, draw, surrogate`` of those distinct ``kind, value`` (with the bits of their genders) that don't get ``surrogate(kind, value, key)``: the first one collides, or a gender is known.

    A round draws anew only for what still collides, and from round ``WIDEN`` on in forms that
    grow by a character or more a round, so few rounds are left then.
    """
    schema = "kind string, value string, gender int, draw int, surrogate string"
    draw = functools.partial(_draw, key)
    values = values.select("kind", "value", F.col("gender").cast("int").alias("gender"))
    taken = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("occurs"))
    todo, settled = values.withColumn("draw", F.lit(0)), []
    for _ in range(ROUNDS):
        fresh = written(todo.mapInArrow(draw, schema), "surrogates")
        owner = fresh.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"))
        used = functools.reduce(DataFrame.unionByName, [taken, *[s.select("kind", "surrogate", F.lit(True).alias("occurs")) for s in settled]])
        marked = fresh.join(owner, ["kind", "surrogate"]).join(used, ["kind", "surrogate"], "left")
        marked = written(marked.withColumn("clash", (F.col("owner") != F.col("value")) | F.col("occurs").isNotNull()).select("kind", "value", "gender", "draw", "surrogate", "clash"), "drawn")
        settled.append(marked.where("not clash").drop("clash"))
        todo = marked.where("clash").select("kind", "value", "gender", F.col("draw") + 1)
        if todo.isEmpty():
            return functools.reduce(DataFrame.unionByName, settled).where("draw > 0 or gender % 3 > 0")
    raise ValueError(f"values without a surrogate after {ROUNDS} draws")


def _replace(key: bytes, carried: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: the carried ones, text, and the document's redrawn values."""
    known: dict[tuple[str, str], str] = {}
    for b in batches:
        texts, counts = [], []
        for text, redrawn in zip(b.column(carried).to_pylist(), b.column(carried + 1).to_pylist()):
            found = find(text) if text else []
            counts.append(len(found))
            if found:
                own = {(r["kind"], r["value"]): r["surrogate"] for r in redrawn or []}
                parts, at = [], 0
                for start, end, kind, value in found:
                    new = own.get((kind, value)) or known.get((kind, value))
                    if new is None:
                        if len(known) > 100_000:
                            known.clear()
                        new = known[kind, value] = surrogate(kind, value, key)
                    parts += [text[at:start], new]
                    at = end
                text = "".join([*parts, text[at:]])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(carried)], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*[f"c{i}" for i in range(carried)], "text", "n_entities"])


def replace(df: DataFrame, key: bytes = b"snapweave", carry: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``carry`` columns, then ``text`` with surrogates and ``n_entities``, of every row.

    Text outside entities stays as it is; null texts stay null; empty ones and rows with a null
    id are treated like others. Repeated rows get equal results, an empty table none.
    """
    mark = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63))).alias("d"), df[text_col].alias("text")).withColumn("t", mark)
    found = written(rows.select("d", "t", "text").mapInArrow(_entities, "d long, t long, kind string, value string, gender int"), "entities")
    odd = written(redrawn(written(found.groupBy("kind", "value").agg(F.bit_or("gender").alias("gender")), "values"), key), "redrawn")
    per_doc = found.drop("gender").join(odd.drop("gender", "draw"), ["kind", "value"]).groupBy("d", "t").agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("redrawn"))
    per_doc = written(per_doc, "redrawn")  # its size is known before the join is planned: texts are shuffled only if it is large
    both = rows.join(per_doc, ["d", "t"], "left").select(*[f"c{i}" for i in range(len(carry))], "text", "redrawn")
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)] + [T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType())]
    out = both.mapInArrow(functools.partial(_replace, key, len(carry)), T.StructType(fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "text", "n_entities")
