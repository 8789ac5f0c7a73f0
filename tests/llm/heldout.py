"""Personal data and secrets in forms that no labelled table has, put into documents."""

from tests.llm import brute


def _number(rng, n):
    return "".join(map(str, rng.integers(0, 10, n)))


def _pick(rng, *options):
    return options[rng.integers(len(options))]


def _name(rng):
    return "".join(rng.choice(list("bcdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 5)))


def _some(rng, n):
    return "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))


def _card(rng, first, sizes, sep):
    digits = first + _number(rng, sum(sizes) - 2)
    digits += next(c for c in "0123456789" if brute.luhn(digits + c))
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(out)


def phone(rng):
    n = lambda k: _number(rng, k)
    form = _pick(
        rng, f"{n(3)}_{n(3)}_{n(4)}", f"0{n(4)}/{n(3)}-{n(2)}", f"{n(2)}-{n(4)}-{n(4)}", f"{n(3)}.{n(4)}.{n(4)}",
        f"({n(3)}) {n(2)}~{n(2)}~{n(3)}",
    )
    return _pick(rng, "mobile", "fax", "Phone:", "ring me at", "Telefon", "Handy"), form


def email(rng):
    a, b, c = _name(rng), _name(rng), _name(rng)
    form = _pick(
        rng, f"{a} *at* {b} *dot* com", f"{a}-{b}(at){c}.co.uk", f"{a} |at| {b} |dot| org", f"{a} [at] {b}-{c} [dot] edu",
        f"{a}{_number(rng, 4)}(at){b}(dot)info",
    )
    return _pick(rng, "contact", "e-mail:", "", "reach", "@:"), form


def card(rng):
    form = _pick(
        rng, _card(rng, "5", (4, 4, 4, 4), "|"), _card(rng, "4", (4, 4, 4, 4), "="), _card(rng, "6", (8, 8), "/"),
        _card(rng, "4", (4, 4, 4, 4), "--"),
    )
    return _pick(rng, "visa", "card no.", "", "pay with", "Kreditkarte"), form


def secret(rng):
    x = lambda k: _some(rng, k)
    form = _pick(
        rng, f"sk-{x(32)}", f"AIza{x(35)}", f"glpat-{x(20)}", f"eyJ{x(20)}.eyJ{x(30)}.{x(27)}", f"npm_{x(36)}", f"SG.{x(22)}.{x(43)}"
    )
    return _pick(rng, "use", "key:", "auth", "the client secret", "credential"), form


def inserted(rng, documents, make, count):
    """``(text, start, end)`` in code points, the form at a random place of each document."""
    for i in range(count):
        words = documents[i % len(documents)].split(" ")
        at = int(rng.integers(len(words) + 1))
        before, form = make(rng)
        head = "".join(w + " " for w in [*words[:at], *([before] if before else [])])
        yield f"{head}{form} {' '.join(words[at:])}", len(head), len(head) + len(form)
