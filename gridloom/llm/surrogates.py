"""PII surrogates: detected entities are replaced by keyed stand-ins of the same type, gender, script and format.

All of it is built-in expressions. One pattern finds entities; the text is split around them, each match is replaced and
the pieces are joined again, so a text is never shuffled. A stand-in is a function of the key and of the entity's canonical
form (its letters and digits, in lower case unless case matters) alone, so an entity has the same stand-in everywhere, also in
other notation or letter case (coreference), without any join.

A stand-in keeps every separator, each letter's case and script, and the class of each character. The characters are
encrypted in place by a keyed Feistel network over the two halves of the canonical form, each character within its own
alphabet (digits, hex digits, letters of its script; in names vowels and consonants apart, so that a name can be spoken; other
letters among those of their script and part of Unicode, with case and without apart).
That is a permutation of all strings of a shape: different entities have different stand-ins. What carries meaning stays: top-level
domains, country codes of phones and IBANs, a card's first digit, a key's name or prefix, a name's title (which tells the
gender) and the last letter of words from four letters (which shows it). Check digits of cards and IBANs move with the number, so right ones stay
right; IP addresses are permuted as four octets.

Collision check: ``collisions`` gathers the distinct entities of a corpus and finds stand-ins that two of them share, and entities
with two; ``safe_key`` appends the attempt to the key until there is none. By construction that is the first attempt; if none
is free of them, the one with the fewest is taken with a warning. Entities are counted where their stand-in differs from them.

Defined cases: null texts stay null, empty ones empty; equal texts give equal results; texts without entities are
unchanged; an empty table gives no rows; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import unicodedata
import warnings
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved

KEY = "gridloom-surrogates"
ATTEMPTS = 4
ROUNDS = 3

TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme", "Господин", "Госпожа", "Κύριος", "Κυρία")
_WORD = r"\p{Lu}\p{L}{1,40}(?:-\p{Lu}\p{L}{1,40})?"
_SECRET = r"(?i:password|passwd|token|secret|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
#: A secret's value to its end, of 8 characters at least, or of 5 with a digit; punctuation belongs to it where more of the value
#: follows.
_VALUE = r"(?:[A-Za-z0-9_+/-][A-Za-z0-9_+/.=~!#$%*@^:-]{6,}[A-Za-z0-9_+/-]|(?=[A-Za-z_+/-]{0,6}[0-9])[A-Za-z0-9_+/-]{5,7})"
_TITLE = "(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? "
#: The kinds in the order in which they are tried at a place; all begin where no letter or digit stands before.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,126}\p{L}{2,63}(?![\p{L}\p{N}])",
    "secret": rf"{_SECRET}{_VALUE}",
    "access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<!\.)(?=\d)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!-)[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?![\d-])",
    "phone": r"(?=[+(\d])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d))",
    "name": rf"{_TITLE}{_WORD}(?: {_WORD}){{0,2}}",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(PATTERNS.values()) + ")"
#: What tells a match's kind from the match itself, in this order.
_TELLS = (
    ("secret", f"^{_SECRET}"),
    ("email", "@"),
    ("access_key", "^(?:AKIA|ASIA)[A-Z0-9]{16}$"),
    ("iban", r"^[A-Z]{2}\d{2}"),
    ("ip", r"^\d+\.\d+\.\d+\.\d+$"),
    ("ssn", r"^\d{3}-\d{2}-\d{4}$"),
    ("card", r"^[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}$"),
    ("phone", r"^[+(\d]"),
    ("name", ""),
)
_GAP = r"[ .()-]*"
#: A phone's country code by its digits alone, whatever separates them: codes of one and of two digits; all others have three.
_COUNTRY = "(?:[17]|" + "|".join(f"{a}{_GAP}[{b}]" for a, b in (("2", "07"), ("3", "0-469"), ("4", "013-9"), ("5", "1-8"), ("6", "0-6"), ("8", "1246"), ("9", "0-58"))) + rf"|\d{_GAP}\d{_GAP}\d)"
#: Beginnings that stay as they are, by kind.
_STAYS = {
    "secret": f"^{_SECRET}",
    "access_key": "^....",
    "phone": rf"^\+{_COUNTRY}|^",
    "name": f"^{_TITLE}",
}

_DIGITS, _HEX, _LOWER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC, _GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρσςτυφχψω"
_PLAIN = (_DIGITS, _LOWER, _CYRILLIC, _GREEK)
_CASED = (_DIGITS, _LOWER, _LOWER.upper())
_SPOKEN = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ")


#: Runs of letters that are their own alphabets: Chinese characters, Korean syllables, Tangut.
_RUNS = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x17000, 0x187F8), (0x20000, 0x2A6E0), (0x2A700, 0x2B73A), (0x2B740, 0x2B81E), (0x2B820, 0x2CEA2), (0x2CEB0, 0x2EBE1), (0x30000, 0x3134B), (0x31350, 0x323B0))


@cache
def alphabets() -> tuple[str, ...]:
    """All other letters and digits, by a rule: those of one script, with case (a capital of one letter that leads back) or without,
    and 256 code points; groups of fewer than four are joined by script, then all. Digits by their zero."""
    groups: dict[tuple, list[str]] = {}
    for code in range(128, 0x110000):
        c = chr(code)
        if unicodedata.category(c)[0] in "LN" and c.lower() == c and not any(a <= code < b for a, b in _RUNS):
            cased = c.upper() != c and len(c.upper()) == 1 and c.upper().lower() == c
            script = unicodedata.name(c, "").split(" ")[0]
            zero = code - unicodedata.decimal(c, code) if unicodedata.category(c) == "Nd" else 0
            groups.setdefault((cased, bool(zero), script, zero or code >> 8), []).append(c)
    for width in (3, 2):
        for name in [n for n, own in groups.items() if len(own) < 4 and len(n) > width]:
            groups.setdefault(name[:width], []).extend(groups.pop(name))
    for name in [n for n, own in groups.items() if len(own) < 2]:  # a letter alone joins the largest group of its sort
        max((own for n, own in groups.items() if n[0] == name[0] and n != name), key=len).extend(groups.pop(name))
    return tuple("".join(sorted(own)) for _, own in sorted(groups.items(), key=str))


def kind_of(match: Column) -> Column:
    told = None
    for kind, tell in _TELLS:
        hit = match.rlike(tell)
        told = F.when(hit, kind) if told is None else told.when(hit, kind)
    return told


def _number(key: str, *parts: Column) -> Column:
    """A keyed 48-bit number of the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _moved(c: Column, by: Column, own: tuple[str, ...], others: bool) -> Column:
    """The character ``by`` places on in its alphabet: one of ``own``, or with others that of its script."""
    shifted = lambda at, size: F.pmod(at + by, size.cast("long"))
    out = F.when(F.length(c) == 0, c)
    for a in own:
        at = F.instr(F.lit(a), c)
        out = out.when(at > 0, F.substr(F.lit(a), (shifted(at - 1, F.lit(len(a))) + 1).cast("int"), F.lit(1)))
    if not others:
        return out.otherwise(c)
    out = out.when(F.ascii(c) < 128, c)
    runs = F.expr("array(" + ", ".join(f"struct({a} AS a, {b} AS b)" for a, b in _RUNS) + ")")
    run = F.filter(runs, lambda r: (F.ascii(c) >= r["a"]) & (F.ascii(c) < r["b"]))
    letter = lambda r: F.decode(F.unhex(F.lpad(F.hex(r["a"] + shifted(F.ascii(c) - r["a"], r["b"] - r["a"])), 8, "0")), "UTF-32")
    rest = F.split(F.lit("\n".join(alphabets())), "\n")  # a constant
    other = F.transform(F.filter(rest, lambda a: F.contains(a, c)), lambda a: F.substr(a, (shifted(F.instr(a, c) - 1, F.length(a)) + 1).cast("int"), F.lit(1)))
    return out.otherwise(F.coalesce(F.get(F.concat(F.transform(run, letter), other), F.lit(0)), c))


def _encrypted(x: Column, key: str, kind: str, own: tuple[str, ...], others: bool = False) -> Column:
    """The Feistel network over the halves of x."""
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1).alias("r"))

    def turn(side: Column, other: Column, tag: Column) -> Column:
        # The digest of a long half is made once, so that a long secret costs its length and not its square.
        short = F.array(F.when(F.length(other) > 128, F.sha2(other, 256)).otherwise(other))
        return F.transform(short, lambda o: F.array_join(F.transform(F.split(side, ""), lambda c, i: _moved(c, _number(key, F.lit(kind), tag, o, i.cast("string")), own, others)), ""))[0]

    def both(s: Column, r: Column) -> Column:
        left = turn(s["l"], s["r"], F.concat(r.cast("string"), F.lit("l")))
        return F.struct(left.alias("l"), s["r"].alias("r"))

    def other(s: Column, r: Column) -> Column:
        return F.struct(s["l"].alias("l"), turn(s["r"], s["l"], F.concat(r.cast("string"), F.lit("r"))).alias("r"))

    steps = F.array(*[F.lit(r) for r in range(2 * ROUNDS)])
    return F.aggregate(steps, start, lambda s, r: F.when(r % 2 == 0, both(s, r)).otherwise(other(s, r)), lambda s: F.concat(s["l"], s["r"]))


def _refilled(shape: Column, letters: Column) -> Column:
    """shape with its letters and digits replaced by ``letters`` in order, in the case that they had."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"), letters.alias("new"))  # so they are made once

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(r"[\p{L}\p{N}]")
        new = F.substr(s["new"], s["k"] + 1, F.lit(1))
        new = F.when(c != F.lower(c), F.upper(new)).otherwise(new)
        return F.struct(F.concat(s["out"], F.when(own, new).otherwise(c)).alias("out"), (s["k"] + own.cast("int")).alias("k"), s["new"].alias("new"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _letters(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "")


def _luhn(digits: Column) -> Column:
    """The check digit that follows these digits."""

    def step(s: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(s["odd"], 2).otherwise(1)
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~s["odd"]).alias("odd"))

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), step, lambda s: F.pmod(-s["sum"], F.lit(10)))


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an IBAN."""

    def step(r: Column, c: Column) -> Column:
        at = F.instr(F.lit(_LOWER), c)
        return F.when(at > 0, F.pmod(r * 100 + at + 9, F.lit(97))).otherwise(F.pmod(r * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97)))

    chars = F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: c != "")
    return F.lit(98) - F.aggregate(chars, F.lit(0), step)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    start = F.struct((octets[0] * 256 + octets[1]).alias("l"), (octets[2] * 256 + octets[3]).alias("r"))

    def step(s: Column, r: Column) -> Column:
        moved = F.pmod(s["l"] + _number(key, F.lit("ip"), r.cast("string"), s["r"].cast("string")), F.lit(65536).cast("long"))
        return F.struct(s["r"].alias("l"), moved.alias("r"))

    def text(s: Column) -> Column:
        parts = [F.shiftright(s["l"], 8), s["l"].bitwiseAND(F.lit(255)), F.shiftright(s["r"], 8), s["r"].bitwiseAND(F.lit(255))]
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    return F.aggregate(F.array(*[F.lit(r) for r in range(2 * ROUNDS)]), start, step, text)


def surrogate(match: Column, key: str = KEY) -> Column:
    """The stand-in of a match of PATTERN."""
    kind = kind_of(match)

    def kept(name: str) -> Column:
        return F.regexp_extract(match, _STAYS[name], 0)

    def rest(name: str) -> Column:
        return F.substr(match, F.length(kept(name)) + 1)

    def whole(body: Column, name: str, own: tuple[str, ...], fold: bool = True) -> Column:
        plain = _letters(F.lower(body) if fold else body)
        return _refilled(body, _encrypted(plain, key, name, own, name in ("email", "name")))

    def email() -> Column:
        tail = F.regexp_extract(match, r"\.\p{L}+$", 0)
        return F.concat(whole(F.regexp_replace(match, r"\.\p{L}+$", ""), "email", _PLAIN), tail)

    def secret() -> Column:
        body = rest("secret")
        code = F.when(body.rlike("^[0-9a-f]+$"), whole(body, "hex", (_HEX,))).otherwise(whole(body, "secret", _CASED, fold=False))
        return F.concat(kept("secret"), code)

    def card() -> Column:
        digits = _letters(match)
        n = F.length(digits)
        payload = F.substr(digits, F.lit(2), n - 2)
        first = F.substr(digits, F.lit(1), F.lit(1))
        new = F.concat(first, _encrypted(payload, key, "card", (_DIGITS,)))
        off = F.substr(digits, n).cast("int") - _luhn(F.substr(digits, F.lit(1), n - 1))
        return _refilled(match, F.concat(new, F.pmod(_luhn(new) + off, F.lit(10)).cast("string")))

    def iban() -> Column:
        plain = _letters(F.lower(match))
        country, check, own = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(3), F.lit(2)), F.substr(plain, F.lit(5))
        new = _encrypted(own, key, "iban", (_DIGITS, _LOWER))
        moved = F.pmod(_iban_check(country, new) + check.cast("int") - _iban_check(country, own), F.lit(100))
        return _refilled(match, F.concat(country, F.lpad(moved.cast("string"), 2, "0"), new))

    def name() -> Column:
        moved = lambda w: F.when(F.length(w) < 4, F.length(w)).otherwise(F.length(w) - 1)
        words = F.transform(F.split(rest("name"), "(?<=[ -])|(?=[ -])"), lambda w: F.concat(whole(F.substr(w, F.lit(1), moved(w)), "name", _SPOKEN), F.substr(w, moved(w) + 1)))
        return F.concat(kept("name"), F.array_join(words, ""))

    shaped = {
        "email": email,
        "secret": secret,
        "access_key": lambda: F.concat(kept("access_key"), whole(rest("access_key"), "access_key", _CASED, fold=False)),
        "iban": iban,
        "ip": lambda: _ip(match, key),
        "ssn": lambda: whole(match, "ssn", (_DIGITS,)),
        "card": card,
        "phone": lambda: F.concat(kept("phone"), whole(rest("phone"), "phone", (_DIGITS,))),
        "name": name,
    }
    out = None
    for k, make in shaped.items():
        out = F.when(kind == k, make()) if out is None else out.when(kind == k, make())
    return out


def _canonical(match: Column, kind: Column) -> Column:
    """What is one entity: letters and digits, without the part that stays by its kind's name only."""
    lower = F.regexp_replace(F.lower(match), "\u0307", "")  # what is left of a dotted capital I beside its i
    octets = F.array_join(F.transform(F.split(match, r"\."), lambda o: o.try_cast("long").cast("string")), ".")
    known = F.when(kind == "secret", F.regexp_replace(match, f"^{_SECRET}", "")).when(kind == "access_key", match).when(kind == "ip", octets)
    known = known.when(kind == "name", F.regexp_replace(F.lower(F.regexp_replace(match, f"^{_TITLE}", "")), "\u0307", "")).when(kind == "email", lower)
    # A number with a country code is another one than the same digits without.
    return known.when(kind == "phone", F.concat(F.regexp_extract(match, r"^\+?", 0), _letters(match))).otherwise(_letters(lower))


def matches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct matches of the corpus: (match)."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))).alias("match")).distinct()


def entity_map(found: DataFrame, key: str = KEY) -> DataFrame:
    """The distinct entities of matches: (kind, entity, surrogate) in canonical form."""
    kind = kind_of(F.col("match"))
    found = found.select(kind.alias("kind"), _canonical(F.col("match"), kind).alias("entity"), surrogate(F.col("match"), key).alias("new"))
    return found.select("kind", "entity", _canonical(F.col("new"), F.col("kind")).alias("surrogate")).distinct()


def collisions(found: DataFrame, key: str = KEY) -> DataFrame:
    """Of matches: stand-ins that several entities share, and entities that have several stand-ins."""
    own = saved(entity_map(found, key))
    shared = own.groupBy("kind", F.col("surrogate").alias("form")).agg(F.count_distinct("entity").alias("n")).where("n > 1").select("kind", "form", "n", F.lit("shared").alias("fault"))
    split = own.groupBy("kind", F.col("entity").alias("form")).agg(F.count_distinct("surrogate").alias("n")).where("n > 1").select("kind", "form", "n", F.lit("split").alias("fault"))
    return shared.union(split)


def safe_key(docs: DataFrame, key: str = KEY, text_col: str = "text") -> str:
    """The key, with the number of the first attempt that has no collision on this corpus, or of the one with the fewest."""
    found, faults = saved(matches(docs, text_col)), []
    for attempt in range(ATTEMPTS):
        faults.append((collisions(found, f"{key}:{attempt}").count(), attempt))
        if not faults[-1][0]:
            return f"{key}:{attempt}"
    n, attempt = min(faults)
    warnings.warn(f"stand-ins collide under {ATTEMPTS} keys, {n} of them under the best", stacklevel=2)
    return f"{key}:{attempt}"


def replaced(docs: DataFrame, key: str = KEY, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with its texts' entities replaced; with count_col their number is added."""
    names = docs.columns
    found = "_" * (1 + max(map(len, names)))  # names that no column has
    made = found + "_"
    rows = docs.withColumn(found, F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)))
    rows = rows.withColumn(made, F.transform(F.col(found), lambda m: surrogate(m, key)))
    pieces = F.split(F.col(text_col), PATTERN, -1)
    text = F.when(F.size(found) > 0, F.array_join(F.zip_with(pieces, F.col(made), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")).otherwise(F.col(text_col))
    changed = F.size(F.filter(F.zip_with(F.col(found), F.col(made), lambda m, s: m != s), lambda x: x))
    own = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return rows.select(*own, *([F.greatest(changed, F.lit(0)).alias(count_col)] if count_col else []))


def surrogates(docs: DataFrame, key: str = KEY, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``replaced`` under a key that was checked for collisions on docs."""
    return replaced(docs, safe_key(docs, key, text_col), text_col, count_col)
