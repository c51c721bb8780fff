"""PII: detected entities get keyed surrogates of the same type, format, script and gender.

Entities: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, payment card numbers, IBANs, US social security numbers,
access keys, assigned secrets (password=..., token = "...") and names of persons. A name is found behind a title; its words
(given names and surname, three letters at least) are then found wherever they stand in the same text.

Each word of a name is an entity of its own, so "Mr John Smith", "Dr John Smith", "Smith" and "John" fall into place
together, in every document. Names in Latin letters get names made of syllables by a keyed hash, with the endings of
their gender; those in other scripts a keyed permutation of their letters. The gender of a given name is that of most of
its titles in the corpus, else told by its ending.

Other surrogates are keyed permutations (Feistel rounds over positions, each modulo the size of its character class), so
upper and lower case, digits, vowels and consonants, accents and scripts stay in place, lengths and punctuation stay,
and within a format two entities never get the same surrogate. One entity gets the same surrogate in every document
(coreference), as does a mail domain within different addresses. Cards and IBANs keep whether their check digits hold;
addresses keep their network class, IPv6 addresses their first group.

What remains possible is that a surrogate equals another entity that occurs in the corpus, that two hashed names are the
same, or that two formats meet. So the distinct entities are checked in Spark, across all types: where a surrogate is itself
an entity or comes up twice, the later entities by hash are permuted with a further key, until none is left (mail domains keep
theirs). After ``WIDEN_AFTER`` attempts the format counts as full, and each further attempt makes it wider (``_widened``): names
get syllables or letters, the local part of mail addresses and secrets a letter, phones, cards, IBANs, keys and security numbers
a digit, IPv6 addresses digits, then groups, IPv4 addresses digits in the last two octets, private ones then network 10, and all
of them a port at last. A format that grows by a factor at each attempt leaves room for any number of entities, so the rounds
end, and no surrogate is used unchecked. Exceptions are few; they are sent to all tasks when measured to be at most ``FEW``,
and joined by row otherwise.

The caller supplies the secret key. Null texts stay null; texts without entities stay as they are; repeated rows give
repeated rows; all columns are kept, except that with ``counts`` the columns n_entities and kinds replace any of these names.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._common import free_name, map_slices, read, schema_of, texts_of, written

#: The session setting that holds the secret key of op5 and the pipeline, and the public key of tests and demonstrations.
KEY_SETTING, DEMO_KEY = "webstrata.pii.key", b"demonstration only"
ROUNDS = 6
FEW = 50_000
#: Attempts within the format; later ones make it wider.
WIDEN_AFTER = 6

#: Titles by gender.
MALE = ("Mr", "Herr", "Herrn", "M", "Monsieur", "Sr", "Señor", "Don", "Signor")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Sra", "Señora", "Doña", "Signora")
NEUTRAL = ("Dr", "Prof", "Mx")

_NAME = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+"
_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    ("secret", r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)(?P<secret>(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{6,})"),
    ("access_key", r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"),
    ("ipv4", r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])"),
    ("ipv6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![\w:.]\w)"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("card", r"(?<![\w+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-][0-9]{3,4}){1,2}(?![\w-])|(?<![\w+])\+[0-9]{8,15}(?!\w)"),
    ("name", rf"(?<!\w)(?:{_TITLES})\.?[ ](?P<name>{_NAME}(?:[ -]{_NAME}){{0,2}})"),
)
_ANY = re.compile("|".join(f"(?P<k{k}>{p})" for k, (_, p) in enumerate(PATTERNS)))
#: Something of this kind is in every text with an entity.
_MAY = re.compile(rf"[0-9@]|\b(?:{_TITLES})\.? ")
_GROUP = {"secret": "secret", "name": "name"}


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(type, begin, end, gender) of each entity, from the left; given names and surnames by word."""
    if not text or not _MAY.search(text):
        return []
    out, known = [], {}
    for m in _ANY.finditer(text):
        kind = PATTERNS[int(m.lastgroup[1:]) if m.lastgroup[0] == "k" else next(k for k in range(len(PATTERNS)) if m.group(f"k{k}") is not None)][0]
        begin, end = m.span(_GROUP[kind]) if kind in _GROUP else m.span()
        if kind != "name":
            out.append((kind, begin, end, ""))
            continue
        title = m.group()[: begin - m.start()].strip(" .")
        gender = "m" if title in MALE else "f" if title in FEMALE else ""
        words = [(begin + w.start(), begin + w.end()) for w in re.finditer("[^ ]+", text[begin:end])]
        for k, (b, e) in enumerate(words):
            own = ("surname", "") if k == len(words) - 1 else ("given", gender)
            out.append((own[0], b, e, own[1]))
            if e - b > 2 and known.get(text[b:e], ("given", ""))[1] == "":
                known[text[b:e]] = own
    if known:
        taken = [(b, e) for _, b, e, _ in out]
        again = re.compile(rf"(?<![\w@.-])(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?![\w@-]|\.\w)")
        at = 0
        for m in again.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or m.end() <= taken[at][0]:
                out.append((known[m.group()][0], *m.span(), known[m.group()][1]))
        out.sort(key=lambda f: f[1])
    return out


def _alphabets() -> list[str]:
    span = lambda a, b: "".join(map(chr, range(ord(a), ord(b) + 1)))
    lower = "aeiou", "bcdfghjklmnpqrstvwxyz"
    accents = [c for c in span("à", "ÿ") if c not in "÷ß"]
    return [
        "0123456789", *lower, *(x.upper() for x in lower), "".join(accents), "".join(c.upper() for c in accents if c != "ÿ"),
        span("а", "я"), span("А", "Я"), span("α", "ω"), span("Α", "Ρ") + span("Σ", "Ω"), span("א", "ת"), span("ا", "غ"), span("ف", "ي"),
        span("ぁ", "ゖ"), span("ァ", "ヺ"), span("一", "鿿"), span("가", "힣"), span("अ", "ह"), span("ก", "ฮ"),
    ]


ALPHABETS = _alphabets()
PLACE = {c: (a, k) for a, chars in reversed(list(enumerate(ALPHABETS))) for k, c in enumerate(chars)}
HEX = "0123456789abcdef"


def _rounds(values: list[int], sizes: list[int], key: bytes, form: bytes) -> list[int]:
    """A keyed permutation of the number lists whose k-th number lies below ``sizes[k]``; ``form`` is the tweak."""
    values, half = list(values), len(values) // 2
    sides = (range(half), range(half, len(values))) if half else (range(0), range(len(values)))
    for r in range(ROUNDS):
        mine, other = sides[r % 2], sides[1 - r % 2]
        seed = form + bytes([r]) + struct.pack(f"<{len(other)}I", *(values[k] for k in other))
        stream, n = b"", 0
        while len(stream) < 4 * len(mine):
            stream += blake2b(seed + bytes([n & 255, n >> 8]), key=key[:64], digest_size=64).digest()
            n += 1
        for j, k in enumerate(mine):
            values[k] = (values[k] + int.from_bytes(stream[4 * j : 4 * j + 4], "little")) % sizes[k]
    return values


def permute(text: str, key: bytes, tweak: str, alphabets: dict[str, tuple[int, int]] = PLACE, chars: list[str] = ALPHABETS) -> str:
    """A keyed permutation of the texts with the same character classes at the same places."""
    at = [k for k, c in enumerate(text) if c in alphabets]
    if not at:
        return text
    classes = [alphabets[text[k]][0] for k in at]
    values = [alphabets[text[k]][1] for k in at]
    sizes = [len(chars[c]) for c in classes]
    form = tweak + "\0" + "".join(map(chr, (65 + c for c in classes))) + "\0" + "".join(c for c in text if c not in alphabets)
    values = _rounds(values, sizes, key, form.encode("utf-8", "replace"))
    out = list(text)
    for k, c, v in zip(at, classes, values, strict=True):
        out[k] = chars[c][v]
    return "".join(out)


def _letters(word: str) -> tuple[dict[str, tuple[int, int]], list[str]]:
    """The alphabets, with one for each letter that they lack: those of its category and script among the 32 characters around it."""
    alphabets, chars = PLACE, ALPHABETS
    for c in word:
        if c not in alphabets and c.isalpha():
            like = lambda x: (unicodedata.category(x), unicodedata.name(x, "").partition(" ")[0])
            near = "".join(x for x in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if x not in alphabets and like(x) == like(c))
            alphabets, chars = alphabets | {x: (len(chars), k) for k, x in enumerate(near)}, [*chars, near]
    return alphabets, chars


_DIGITS = {c: (0, k) for k, c in enumerate("0123456789")}
_HEXES = {c: (0, k) for k, c in enumerate(HEX)}
_UPPER_HEXES = {c: (0, k) for k, c in enumerate(HEX.upper())}
_CODES = {c: (0, k) for k, c in enumerate("0123456789")} | {c: (1, k) for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
_CODE_CHARS = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def _check_digit(digits: str) -> int:
    """Luhn check digit to put behind the digits."""
    total = sum(int(d) if k % 2 else (2 * int(d) - 9 * (d > "4")) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _card(value: str, key: bytes, more: int) -> str:
    digits = re.sub(r"\D", "", value)
    body = digits[0] + permute(digits[1:-1] + "0" * more, key, "card", _DIGITS, ["0123456789"])
    made = iter(body + str((_check_digit(body) + int(digits[-1]) - _check_digit(digits[:-1])) % 10))
    return "".join(next(made) if c.isdigit() else c for c in value) + "".join(made)


def _network(octets: list[int]) -> int:
    a, b = octets[:2]
    return 1 if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168) else 2 if a == 127 else 3 if a == 0 or a >= 224 or (a == 169 and b == 254) else 0


def _address(value: str, key: bytes) -> str:
    """Every octet keeps its number of digits; the leading octets that make up a special network stay in it."""
    octets = [int(x) for x in value.split(".")]
    a, b = octets[:2]
    kind = _network(octets)
    spans = [range(0, 10) if len(x) == 1 else range(10, 100) if len(x) == 2 else range(100, 256) for x in map(str, octets)]
    if kind:
        spans[0] = range(224, 256) if a >= 224 else range(a, a + 1)
        if a in (169, 192):
            spans[1] = range(b, b + 1)
        elif a == 172:
            spans[1] = range(16, 32)
    form = repr((kind, *((x.start, x.stop) for x in spans))).encode()
    free = [k for k, x in enumerate(spans) if len(x) > 1]
    while True:  # walk the cycle until the class is the same: still a permutation within the class
        moved = _rounds([octets[k] - spans[k].start for k in free], [len(spans[k]) for k in free], key, form)
        for k, v in zip(free, moved, strict=True):
            octets[k] = spans[k].start + v
        if _network(octets) == kind:
            return ".".join(map(str, octets))


def _iban(value: str, key: bytes, more: int) -> str:
    """Country and format stay; check digits hold if they did, and are off by as much if they did not."""
    plain = value.replace(" ", "")

    def check(body: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97

    made = permute(plain[4:] + "0" * more, key, "iban", _CODES, _CODE_CHARS)
    digits = (check(made) + int(plain[2:4]) - check(plain[4:]) - 2) % 97 + 2
    rest = iter(f"{plain[:2]}{digits:02}{made}")
    return "".join(c if c == " " else next(rest) for c in value) + "".join(rest)


def _ipv6(value: str, key: bytes) -> str:
    head, colon, rest = value.partition(":")
    return head + colon + permute(rest, key, "ipv6" + ("U" if rest.upper() == rest else ""), *((_UPPER_HEXES, [HEX.upper()]) if rest.upper() == rest else (_HEXES, [HEX])))


#: Syllables of made names: beginnings, vowels, and the endings of given names by gender and of surnames.
BEGINNINGS = "b d f g h k l m n p r s t v z br dr kl st".split()
VOWELS = "a e i o u".split()
ENDINGS = {"f": "a ia ina ella".split(), "m": "o an er us".split(), "": "i e is en".split(), "surname": "n r s t l m ck nd".split()}


def default_gender(given: str) -> str:
    """Where no title tells it."""
    return "f" if given[-1:].lower() in "aeiyàáèé" else "m"


def _word(word: str, kind: str, gender: str, key: bytes, syllables: int) -> str:
    """One word of a name."""
    if not word.isascii():  # other scripts and accents keep their letters' classes
        return permute(word, key, kind, *_letters(word))
    number = int.from_bytes(blake2b(f"{kind} {gender} {word.lower()}".encode(), key=key, digest_size=32).digest(), "little")
    out = ""
    for _ in range(syllables):
        number, k = divmod(number, len(BEGINNINGS) * len(VOWELS))
        out += BEGINNINGS[k // len(VOWELS)] + VOWELS[k % len(VOWELS)]
    ends = ENDINGS[gender if kind == "given" else "surname"]
    out += (BEGINNINGS[number % 15] if kind == "given" else "") + ends[number // 15 % len(ends)]
    return out.upper() if len(word) > 1 and word.isupper() else out if word.islower() else out.capitalize()


def _name(value: str, kind: str, gender: str, key: bytes, attempt: int) -> str:
    more = max(0, attempt - WIDEN_AFTER)
    return "-".join(_word(w + ("a" * more if not w.isascii() else ""), kind, gender, key, (2 if kind == "given" else 3) + attempt // 2) if w else "" for w in value.split("-"))


def _widened(kind: str, value: str, by: int) -> str:
    """The value in a format with more room, the more the larger ``by``; names, cards and IBANs grow where they are made."""
    if kind == "email":
        return value.replace("@", "a" * by + "@", 1)
    if kind == "ipv4":
        octets = value.split(".")
        if by > 3 and _network([int(x) for x in octets]) == 1:
            octets = ["10", "100", *octets[2:]]
        return ".".join([*octets[:2], *(x.rjust(min(3, len(x) + by), "1") for x in octets[2:])])
    if kind == "ipv6":
        head, colon, rest = value.partition(":")
        return head + colon + ":".join(g.rjust(min(4, len(g) + by), "0") if g else g for g in rest.split(":")) + ":0000" * (by - 3)
    if kind in ("phone", "ssn", "access_key"):
        return value + "0" * by
    return value + "b" * by if kind == "secret" else value


@lru_cache(maxsize=5_000)
def surrogate(kind: str, value: str, gender: str = "", key: bytes = DEMO_KEY, attempt: int = 0) -> str:
    """The replacement for one entity."""
    first = blake2b(key + kind.encode() + bytes([0]), digest_size=32).digest()
    key = blake2b(key + kind.encode() + attempt.to_bytes(max(1, (attempt.bit_length() + 7) // 8), "big"), digest_size=32).digest()
    more, whole = max(0, attempt - WIDEN_AFTER), value
    if more:
        value = _widened(kind, value, more)
    if kind == "email":  # the domain is the same at every attempt
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{permute(local, key, 'local')}@{permute(host, first, 'host')}.{top}"
    if kind == "card":
        return _card(value, key, more)
    if kind == "ipv4":
        port = permute("0" * (more - 5), key, f"port {whole}", _DIGITS, ["0123456789"])
        return _address(value, key) + (f":{port}" if port else "")
    if kind == "ipv6":
        return _ipv6(value, key)
    if kind in ("given", "surname"):
        return _name(value, kind, gender or default_gender(value) if kind == "given" else "", key, attempt)
    if kind == "phone":  # the country and the first digit of the number stay
        m = re.match(r"(?:\+[0-9]{1,3}(?=[ .(-]))?[^0-9]*[0-9]", value)
        head = m.end() if m else 1
        return value[:head] + permute(value[head:], key, "phone", _DIGITS, ["0123456789"])
    if kind == "access_key":
        return value[:4] + permute(value[4:], key, "key", _CODES, _CODE_CHARS)
    if kind == "iban":
        return _iban(value, key, more)
    if kind == "secret" and set(value) <= set(HEX):
        return permute(value, key, "hex", _HEXES, [HEX])
    return permute(value, key, kind)


def detect(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per entity: id, kind, value, gender, begin and end in characters."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = part.column("id").to_pylist(), []
        for k, text in zip(ids, texts_of(part, "text"), strict=True):
            found += [(k, what, text[b:e], gender, b, e) for what, b, e, gender in find(text)]
        types = (part.schema.field("id").type, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=[id_col, "kind", "value", "gender", "begin", "end"])

    return map_slices(own, "text", f"`{id_col}` {kind}, kind string, value string, gender string, begin int, `end` int", run)


def exceptions(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, gender, attempt) of the entities whose first surrogate collides or whose gender is not what the name tells
    by itself; see the module."""
    votes = F.sum(F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", -1).otherwise(0))
    voted = entities.groupBy("kind", "value").agg(votes.alias("votes"))
    gender = F.when(F.col("kind") == "given", F.when(F.col("votes") > 0, "f").when(F.col("votes") < 0, "m").otherwise("")).otherwise("")
    distinct = written(voted.select("kind", "value", gender.alias("gender")), name="entities")
    own = distinct.withColumn("attempt", F.lit(0))

    def made(rows: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("kind", "value", "gender", "attempt")]
                yield batch.append_column("made", pa.array([surrogate(a, b, c, key, n) for a, b, c, n in zip(*columns, strict=True)], pa.string()))

        return rows.mapInArrow(run, "kind string, value string, gender string, attempt int, made string")

    values = distinct.select(F.col("value").alias("v"))
    while True:  # formats grow at each further attempt, so the rounds end
        now = written(made(own), name="surrogates")
        taken = now.join(values, now.made == values.v, "left_semi")
        keep = now.groupBy("made").agg(F.min(F.struct("attempt", F.xxhash64("value").alias("h"), "kind", "value")).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = now.join(keep, "made").where("kind <> first.kind or value <> first.value").select(now.columns)
        bad = written(taken.unionByName(twice).select("kind", "value").distinct().withColumn("again", F.lit(1)), name="collisions")
        if bad.isEmpty():
            break
        own = written(own.join(bad, ["kind", "value"], "left").select("kind", "value", "gender", (F.col("attempt") + F.coalesce("again", F.lit(0))).cast("int").alias("attempt")), name="attempts")
    return own.where((F.col("attempt") > 0) | ((F.col("gender") != "") & (F.col("gender") != default_gender_of("value"))))


def default_gender_of(given: str):
    """``default_gender`` as a column."""
    return F.when(F.lower(F.substring(given, -1, 1)).isin(*"aeiyàáèé"), "f").otherwise("m")


def replace(docs: DataFrame, *, key: bytes, text_col="text", checked: bool = True, counts: bool = False, few: int = FEW) -> DataFrame:
    """The documents with all entities replaced; with ``counts`` also n_entities and a map of numbers by kind.

    Exceptions are sent to all tasks if they are measured to be at most ``few``; more are joined to the rows that hold them.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if not counts or c.lower() not in ("n_entities", "kinds")]
    own = docs = docs.select(*names)
    at = names.index(text_col)
    row, lists = free_name(names, "row"), free_name(names, "moved")
    moved: dict[tuple[str, str], tuple[str, int]] = {}
    if checked:
        odd = written(exceptions(detect(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), id_col="id"), key), name="exceptions")
        if odd.count() <= few:
            moved = {(r.kind, r.value): (r.gender, r.attempt) for r in odd.collect()}
        else:
            rows = written(docs.withColumn(row, F.monotonically_increasing_id()), name="rows")
            held = detect(rows, id_col=row, text_col=text_col).select(row, "kind", "value").distinct().join(odd, ["kind", "value"])
            own = rows.join(held.groupBy(row).agg(F.collect_list(F.struct("kind", "value", "gender", "attempt")).alias(lists)), row, "left").drop(row)
    shared = spark.sparkContext.broadcast(moved)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, numbers = part.column(at).to_pylist(), []
        by_row = part.column(lists).to_pylist() if lists in part.schema.names else [None] * len(texts)
        for k, text in enumerate(texts):
            moved = shared.value if by_row[k] is None else {(x["kind"], x["value"]): (x["gender"], x["attempt"]) for x in by_row[k]}
            found, pieces, last = find(text or ""), [], 0
            for kind, b, e, _ in found:
                gender, attempt = moved.get((kind, text[b:e]), ("", 0))
                pieces += [text[last:b], surrogate(kind, text[b:e], gender, key, attempt)]
                last = e
            texts[k] = "".join([*pieces, text[last:]]) if found else text
            numbers.append(Counter(f[0] for f in found))
        columns = [part.column(c) if c != at else pa.array(texts, part.schema.field(at).type) for c in range(len(names))]
        if counts:
            columns += [pa.array([n.total() for n in numbers], pa.int64()), pa.array([sorted(n.items()) for n in numbers], pa.map_(pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "n_entities", "kinds"] if counts else names)

    return map_slices(own, text_col, schema_of(docs, *names) + ", n_entities long, kinds map<string,bigint>" * counts, run)


def session_key(spark) -> bytes:
    """The secret key of the session, in ``KEY_SETTING``; without one, a public key that only makes results repeatable."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else DEMO_KEY


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace(read(spark, sf_dir, "documents").select("doc_id", "text"), key=session_key(spark), counts=True)
