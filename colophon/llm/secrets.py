"""Secret scans by patterns and a linear-chain conditional random field.

Assignments of secrets, access keys and long hexadecimal strings of fixed forms are
found by pattern in every whole text. A conditional random field tags tokens as
beginning, inside or outside a secret, from their shape, the neighbouring words and
how busy the file is with signs; it is trained from the small labelled table
``examples`` and adds spans of kind ``secret`` that overlap no pattern's span.

Null and empty texts have no spans. Repeated rows give repeated results; an empty
table gives no rows; other columns are ignored. A text of any length is searched as
a whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from colophon.llm import tagging
from colophon.llm.tables import documents_of, table

BASE_KINDS = ("assign", "access", "hex")
TAGGED = "secret"
KINDS = (*BASE_KINDS, TAGGED)

_ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = tagging.byte_set("0123456789abcdef")


def patterns(data: np.ndarray, at: np.ndarray, raw: bytes) -> list[tuple[int, int, int, str]]:
    """Pattern spans of a slice, in bytes."""
    out = []
    signs = np.flatnonzero((data == ord("=")) | (data == ord(":")))
    for doc in np.unique(tagging.text_of(at, signs)).tolist():  # an assignment has a sign
        for m in _ASSIGN.finditer(raw, int(at[doc]), int(at[doc + 1])):
            if len(m[2]) >= 12:
                out.append((doc, m.start(), m.end(), "assign"))
    place = raw.find(b"AKIA")
    while place >= 0:
        doc = int(tagging.text_of(at, place))
        m = _ACCESS.match(raw, place, int(at[doc + 1]))
        if m and len(m[0]) >= 18:
            out.append((doc, m.start(), m.end(), "access"))
        place = raw.find(b"AKIA", m.end() if m else place + 1)
    starts, ends = tagging.runs(_HEX[data], at)
    keep = ends - starts >= 16
    for lo, hi in zip(starts[keep].tolist(), ends[keep].tolist()):
        out.append((int(tagging.text_of(at, lo)), lo, hi, "hex"))
    return out


def examples(rows: int = 3000, seed: int = 11) -> list[str]:
    """The labelled table: short lines of prose and settings with their secrets marked up."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[rng.integers(len(options))]
    some = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    number = lambda n: some("0123456789", n)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "an er on the re in es ti ou de la que ion mente ung ch sch ar os le".split()
    word = lambda: "".join(pick(*syllables) for _ in range(rng.integers(1, pick(4, 4, 10))))
    tag = lambda s: f"<{TAGGED}>{s}</{TAGGED}>"

    def filler() -> str:
        w = word()
        noise = pick(*"!#$%&*+,./:;<=>?@^_|~-") * int(rng.integers(1, 6))
        return pick(w, w, w, w, w.capitalize(), f"{w},", f"{w}.", f"{w.capitalize()}.", w.upper(), f"{w}{noise}", f"{w.upper()}{noise}", noise)

    def secret() -> str:
        long = some(mixed, int(rng.integers(20, 44)))
        return pick(
            f"token = {tag(some('0123456789abcdef', 40))}", tag(f"password={some('0123456789abcdef', 18)}"),
            tag(f"AKIA{some('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 16)}"), f"Bearer {tag(long)}", f"Authorization: Bearer {tag(long)}",
            tag(f"sk_live_{some(mixed, 24)}"), tag(f"{word()}{pick(*"-_.")}{some(mixed, int(rng.integers(18, 40)))}"), tag(f"{long}.{some(mixed, 24)}"), tag(f"ghp_{some(mixed, 36)}"), tag(f"xoxb-{number(12)}-{some(mixed, 24)}"),
            f"secret key {tag(some(mixed + '+/', 40))}", f"private key: {tag(long)}", f"pwd: {tag(some(mixed + '!#$', 14))}",
            f"access key {tag(some(mixed + '+/', 40))}", f"credentials {tag(long)}",
        )

    def public() -> str:
        """Numbers and signs that are no secrets."""
        return pick(
            "Version 2.0.", "version 3.", number(4), number(16), f"+1 ({number(3)}) {number(3)}-{number(4)}", f"{number(2)}.{number(3)}.{number(2)}.{number(1)}",
            f"{word()}.{number(2)}@{word()}{number(1)}.example.com", f"{word()}@{word()}.org", ".".join(str(n) for n in rng.integers(1, 256, 4)), number(12), f"https://{word()}.org/{word()}/{number(4)}", f"{number(4)}-{number(2)}-{number(2)}",
            f"{word()}_{word()}", f"{word()}{number(2)}", f"key = {word()}", f"token {word()}", f"the password {word()}", f"secret: {word()}",
            word() + word() + word(), word().upper() + word().upper(), f"{word()}({word()})", f"x = {number(3)}",
        )

    out = []
    for i in range(rows):
        parts = [filler() for _ in range(rng.integers(3, 12))]
        for _ in range(i % 4 % 3):
            parts.insert(int(rng.integers(len(parts) + 1)), secret())
        for _ in range(rng.integers(0, 4)):
            parts.insert(int(rng.integers(len(parts) + 1)), public() + pick("", "", "", pick(*"!#$%&*") * int(rng.integers(1, 4)), ",", "."))
        out.append(" ".join(parts))
    return out


def spans(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document."""
    model = tagging.trained(examples, (TAGGED,))
    return documents_of(docs).mapInArrow(
        tagging.digest(patterns, model, BASE_KINDS, KINDS), tagging.schema(BASE_KINDS)
    )


def query(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
