"""Personal data by patterns and a linear-chain conditional random field.

Emails, IPv4 addresses, card numbers and phone numbers of fixed forms are found by
pattern in every whole text. A conditional random field over word shapes, trained
from the small labelled table ``examples``, adds what the patterns don't know: phone
numbers without a country code, mail addresses with a bracketed sign, card numbers in
other groupings. Added spans never overlap a pattern's span, and pattern spans stay.

Null and empty texts have no spans. Repeated rows give repeated results; an empty
table gives no rows; other columns are ignored by the query and kept by
``masked``. A text of any length is searched as a whole, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import crf, tagging, words
from colophon.llm.tables import documents_of, table

KINDS = ("email", "ip", "card", "phone")

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_LOCAL = tagging.byte_set(_LETTERS + _DIGITS + "._%+-")
_IS_DIGIT = tagging.byte_set(_DIGITS)
_IP_CHAR = tagging.byte_set(_DIGITS + ".")
_CARD_CHAR = tagging.byte_set(_DIGITS + " -")

_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(rb"[^0-9]+")
# a sign spelt out between marks, and later a dot, written or spelt, with a domain behind it
_SPELT = re.compile(rb"[^A-Za-z0-9]at[^A-Za-z0-9].*?(?:\.|[^A-Za-z0-9]dot[^A-Za-z0-9]+)[A-Za-z]{2}", re.I | re.S)


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = (d - 48) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(data, at, raw):
    """The local part is all that may be one before the sign, after any earlier match."""
    signs = np.flatnonzero(data == ord("@"))
    if not len(signs):
        return
    others = np.concatenate([[-1], np.flatnonzero(~_LOCAL[data])])
    own = tagging.text_of(at, signs)
    left = others[np.searchsorted(others, signs) - 1] + 1
    done = 0
    for p, doc, lo in zip(signs.tolist(), own.tolist(), left.tolist()):
        lo = max(lo, int(at[doc]), done)
        if lo < p and (m := _DOMAIN.match(raw, p, int(at[doc + 1]))):
            done = m.end()
            yield doc, lo, done, "email"


def _octet(part: bytes) -> bool:
    """At most 255, of any number of digits."""
    significant = part.lstrip(b"0")
    return len(significant) < 3 or len(significant) == 3 and significant <= b"255"


def _ips(data, at, raw):
    starts, ends = tagging.runs(_IP_CHAR[data], at)
    keep = crf._sums(data == ord("."), starts, ends) >= 3
    for lo, hi in zip(starts[keep].tolist(), ends[keep].tolist()):
        for chain in _DOTTED.finditer(raw, lo, hi):
            parts, place = chain[0].split(b"."), chain.start()
            edges = np.cumsum([0] + [len(p) + 1 for p in parts]).tolist()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(map(_octet, four)):
                    yield tagging.text_of(at, lo), place + edges[i], place + edges[i + 4] - 1, "ip"


def _cards(data, at, raw):
    starts, ends = tagging.runs(_CARD_CHAR[data], at)
    keep = crf._sums(_IS_DIGIT[data], starts, ends) >= 14
    for lo, hi in zip(starts[keep].tolist(), ends[keep].tolist()):
        for m in _CARD.finditer(raw, lo, hi):
            digits = _NO_DIGIT.sub(b"", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                yield tagging.text_of(at, lo), m.start(), m.end(), "card"


def _phones(data, at, raw):
    for p in np.flatnonzero(data == ord("+")).tolist():
        doc = int(tagging.text_of(at, p))
        if m := _PHONE.match(raw, p, int(at[doc + 1])):
            if 10 <= len(_NO_DIGIT.sub(b"", m[0])) <= 15:
                yield doc, m.start(), m.end(), "phone"


def patterns(data: np.ndarray, at: np.ndarray, raw: bytes) -> list[tuple[int, int, int, str]]:
    """Pattern spans of a slice, in bytes."""
    return [s for find in (_emails, _ips, _cards, _phones) for s in find(data, at, raw)]


def examples(rows: int = 4000, seed: int = 7) -> list[str]:
    """The labelled table: short sentences in which personal data is marked up."""
    rng = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *options: options[rng.integers(len(options))]
    signs = "!#$%&*+,./:;<=>?@^_|~-"
    syllables = "an er on the re in es ti ou de la que ion mente ung ch sch ar os le ba ko mi pu".split()
    word = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, pick(4, 4, 10))))

    def filler() -> str:
        w = word()
        noise = pick(*signs) * int(rng.integers(1, 6))
        return pick(
            w, w, w, w, w, w.capitalize(), f"{w},", f"{w}.", f"{w.capitalize()}.", w.upper(), f"{w}{noise}", f"{noise}{w}",
            noise, " ".join([f"{w},"] * int(rng.integers(2, 8))), " ".join([w.capitalize()] * int(rng.integers(2, 6))),
        )

    def phone() -> str:
        sizes = pick((3, 3, 4), (3, 3, 4), (3, 4), (2, 2, 2, 2, 2), (3, 2, 2, 3), (4, 6), (3, 7), (5, 5), (4, 3, 3), (2, 3, 4), (4, 3, 4), (3, 3, 3), (4, 4, 2))
        sep = pick("-", ".", " ", " ", "/", " - ", "-", ":")
        groups = [number(n) for n in sizes]
        if rng.integers(4) == 0:
            groups[0] = pick("0", "") + groups[0]
        if rng.integers(3) == 0:
            return f"({groups[0]}){pick('', ' ', ' ', '-')}{sep.join(groups[1:])}"
        return pick("", "", "", "", "1-", "1 ", f"00{number(2)} ") + sep.join(groups)

    def email() -> str:
        name = pick(word(), f"{word()}.{word()}", f"{word()}{number(int(rng.integers(1, 5)))}", f"{word()}_{word()}", f"{word()}-{word()}")
        round_, square = ("(", ")"), ("[", "]")
        left, right = pick(round_, round_, round_, square, square, ("{", "}"), ("<", ">"), ("-", "-"), ("_", "_"), ("#", "#"), ("/", "/"), ("=", "="))
        at, dot = (f"{left}{pick(x, x.upper())}{right}" for x in ("at", "dot"))
        end, host, gap = pick("com", "org", "net", "de", "fr", "es", "io", "gov", "com.au", "co.nz"), pick(word(), f"{word()}-{word()}"), pick("", " ", " ")
        return pick(f"{name}{at}{host}{dot}{end}", f"{name}{gap}{at}{gap}{host}{gap}{dot}{gap}{end}", f"{name}{gap}{at}{gap}{host}.{end}", f"{name} {at} {host} {dot} {end}")

    def card() -> str:
        sep = pick(".", "/", "_", ":", "*", "+", "~", " - ", "//", "..", " / ")
        sizes = pick((4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (6, 10), (4, 8, 4), (3, 4, 4, 4), (5, 6, 5), (5, 5, 5), (7, 8))
        digits = pick("3", "4", "5", "6") + number(sum(sizes) - 2)
        digits += next(d for d in _DIGITS if _luhn((digits + d).encode()))
        cuts = np.cumsum([0, *sizes])
        return sep.join(digits[a:b] for a, b in zip(cuts, cuts[1:]))

    def private() -> str:
        ask = pick("", "", "phone ", "call ", "tel. ", "Tel: ", "cell ", "number: ", f"{word()} ")
        write = pick("", "", "mail ", "write to ", "email: ", "address ", f"{word()} ")
        pay = pick("", "", "card ", "Card: ", "account ", f"{word()} ")
        ip = ".".join(str(n) for n in rng.integers(0, 256, 4))
        return pick(
            *[f"{ask}<phone>{phone()}</phone>"] * 4, *[f"{write}<email>{email()}</email>"] * 6, *[f"{pay}<card>{card()}</card>"] * 3,
            f"{write}<email>{word()}.{number(2)}@{word()}.example.com</email>", f"<email>{word()}@{word()}.org</email>",
            f"<ip>{ip}</ip>", f"<phone>+{number(1)} ({number(3)}) {number(3)}-{number(4)}</phone>",
        ) + pick("", "", "", ",", ".", ";")

    def public() -> str:
        """Numbers and signs that are no personal data."""
        hexes = "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(16, 41)))
        return pick(
            "Version 2.0.", "version 3.", f"{number(4)}", f"{number(2)}.{number(1)}.{number(1)}", f"$ {number(3)}.{number(2)}",
            f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"token = \"{hexes}\"", f"password={hexes[:18]}",
            f"AKIA{hexes[:16].upper()}", f"https://{word()}.org/{number(5)}", f"{number(1)}%", f"({number(4)})", f"no. {number(6)}",
            f"page {number(3)}", f"@{word()}", f"{word()}-{word()}", f"{word()}{number(1)}", f"C++ {number(2)}", f"at {word()} dot {word()}",
            f"ISBN {number(3)}-{number(1)}-{number(5)}-{number(3)}-{number(1)}", f"{number(8)}", f"{number(12)}", f"{number(2)}/{number(2)}/{number(4)}",
            number(16), number(15),
            f"({word()})", f"[{word()}]", f"{word()} ({word()}) {word()}", f"| {word()} | {word()} |", f"{number(1)}.{number(3)}.{number(3)}",
        )

    out = []
    for i in range(rows):
        parts = [filler() for _ in range(rng.integers(3, 12))]
        for _ in range(i % 4 % 3):
            parts.insert(int(rng.integers(len(parts) + 1)), private())
        for _ in range(rng.integers(0, 3)):
            parts.insert(int(rng.integers(len(parts) + 1)), public())
        out.append(" ".join(parts))
    return out


def plausible(kind: str, span: bytes) -> bool:
    """What any personal data of a kind has: the exact check of the tagger's spans."""
    digits = _NO_DIGIT.sub(b"", span)
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "email":
        return b"@" in span or _SPELT.search(span) is not None
    return len(digits) >= 4


def spans(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document."""
    model = tagging.trained(examples, KINDS)
    return documents_of(docs).mapInArrow(tagging.digest(patterns, model, KINDS, KINDS, plausible), tagging.schema(KINDS))


def _masker(model: crf.Model):
    """Masked texts of an Arrow array of texts at a time."""

    def mask(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lookup = crf.Lookup(model.keys)
        for array in arrays:
            out, done = [], 0
            for rows, data, at in words.slices([pa.RecordBatch.from_arrays([array], ["text"])], words.STREAM_BYTES):
                base, added = tagging.found(patterns, model, lookup, data, at, plausible)
                for doc in sorted(base.keys() | added.keys()):
                    raw, cut, last = data[at[doc] : at[doc + 1]].tobytes(), [], 0
                    for lo, hi, kind in sorted(base.get(doc, []) + added.get(doc, [])):
                        lo, hi = lo - int(at[doc]), hi - int(at[doc])
                        if lo >= last:  # of overlapping spans the first names the kind
                            cut += [raw[last:lo], f"[{kind.upper()}]".encode()]
                        last = max(last, hi)
                    out.append((done + doc, b"".join([*cut, raw[last:]]).decode()))
                done += rows.num_rows
            yield _replaced(array, out)

    return F.arrow_udf(mask, "string")


def _replaced(array: pa.Array, changed: list[tuple[int, str]]) -> pa.Array:
    """The array with some values exchanged."""
    if not changed:
        return array
    here = np.zeros(len(array), bool)
    here[[i for i, _ in changed]] = True
    return pc.replace_with_mask(array, pa.array(here), pa.array([t for _, t in changed], array.type))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by ``[KIND]``, and ``n_chars``, if any, counted anew."""
    model = tagging.trained(examples, KINDS)
    out = docs.withColumn("text", _masker(model)(F.col("text").cast("string")))
    counts = [(n, t) for n, t in docs.dtypes if n == "n_chars"]
    for name, dtype in counts:
        out = out.withColumn(name, F.when(F.col(name).isNotNull(), F.length("text").cast(dtype)))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
