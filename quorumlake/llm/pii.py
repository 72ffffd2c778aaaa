"""Personal data [native]: patterns propose, checksums confirm, context words adjust the score.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns with
fixed tests; a failing match is dropped and not retried.  The method adds further kinds (iban, ssn,
phone_local): a proposal starts from its kind's prior, a passed checksum or validity test raises it
(a failed one rejects), words in the 48 characters before it, back to the end of the last match but
one of its kind, raise or lower it, and proposals of 0.5 or more are returned.  Base spans always
stay.  Offsets are code points, end exclusive.

Spark has no regular expression function that returns offsets, so they come from the pieces
between the matches: a match starts after all earlier pieces and matches.  The sums run in chunks, so
a text of n matches costs about n steps and not their square.

The patterns are possessive, and a match may only start where its first run starts or where the
previous match ended.  Both leave the matches as they are and keep the scan linear in the text.

Defined cases: null and empty texts have no spans; repeated rows and ids give one row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

#: kind -> (cheap test of the text, pattern).  Order is the order of kinds at equal starts.
BASE = {
    "email": (lambda t: F.contains(t, F.lit("@")), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # maximal runs of digits with single separators, those of 12 to 19 digits
    "card": (lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    "phone": (lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ADDED = {
    "iban": (lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": (lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone_local": (lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}"), r"(?<![0-9+(])(?<!\+[0-9]{1,3}[\x20.-]{0,2})\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
}
KINDS = (*BASE, *ADDED)
CONTEXT_CHARS = 48
#: kind -> prior, gain of a passed test (a failed one rejects), and what words before it add and take away.
SCORES = {
    "iban": {
        "prior": 0.2, "test": 0.4, "gain": 0.3, "loss": 0.3,
        "words": r"\b(iban|account|bank|konto|compte|cuenta|payment)\b", "against": r"\b(example|sample|dummy|fake|serial|part no|sku)\b",
    },
    "ssn": {
        "prior": 0.1, "test": 0.2, "gain": 0.5, "loss": 0.4,
        "words": r"\b(ssn|social security|sozialversicherung|tax id)\b", "against": r"\b(example|sample|dummy|fake|isbn|part no|sku|order)\b",
    },
    "phone_local": {
        "prior": 0.1, "test": 0.1, "gain": 0.5, "loss": 0.4,
        "words": r"\b(phone|tel|telephone|call|mobile|cell|fax|tel[eé]fono|telefon)\b", "against": r"\b(example|sample|dummy|fake|isbn|part no|sku|order|invoice)\b",
    },
}
KEEP_SCORE = 0.5
#: Values that one fold appends; code points of a piece of text that redaction cuts from.
CHUNK = 512
PIECE = 4096


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Remainder of an IBAN: first four characters last, letters as 10 to 35, read as a number."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        digit = ch.between("0", "9")
        value = F.ascii(ch) - F.when(digit, 48).otherwise(55)
        return ((acc * F.when(digit, 10).otherwise(100) + value) % 97).cast("int")

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: let(F.ltrim(part, F.lit("0")), lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255"))))
    if kind == "card":
        return F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(m) == 1)
    if kind == "ssn":
        return ~(m.startswith("000") | m.startswith("666") | m.startswith("9") | (F.substring(m, 5, 2) == "00") | m.endswith("0000"))
    if kind == "phone_local":  # neither area nor exchange begins with 0 or 1
        return _digits(m).rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    return F.lit(True)


def _appended(values: Column, at: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``step`` has made of ``at`` and all values before each of ``values``, by appending: for short arrays."""
    zero = F.struct(at.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
    more = lambda acc, x: F.struct(step(acc["at"], x).cast(kind).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    return F.aggregate(values, zero, more, lambda acc: acc["all"])


def running(values: Column, step: Callable[[Column, Column], Column], start: int = 0, kind: str = "int") -> Column:
    """For each of ``values``, ``step`` folded over all before it: sums or maxima.

    Appending costs the square of the length, so long arrays are cut into chunks: first the values at
    the chunks' heads, then each chunk from its head.
    """
    first = F.lit(start).cast(kind)

    def chunked(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))
        total = lambda part: F.aggregate(part, first, lambda a, x: step(a, x).cast(kind))
        heads = lambda parts: _appended(F.transform(parts, total), first, step, kind)
        return let(cut, lambda parts: let(heads(parts), lambda at: F.flatten(F.transform(parts, lambda part, c: _appended(part, F.get(at, c), step, kind)))))

    return let(values, lambda xs: F.when(F.size(xs) <= CHUNK, _appended(xs, first, step, kind)).otherwise(chunked(xs)))


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, kind number, end, score) of the proposals of ``kind`` that hold."""
    gate, pattern = (BASE | ADDED)[kind]
    number = KINDS.index(kind)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")

    def score(m: Column, i: Column, found: Column, pieces: Column) -> Column:
        if kind in BASE:
            return F.when(_valid(kind, m), 1.0).otherwise(0.0)
        rule = SCORES[kind]
        earlier = F.when(i > 0, F.concat(F.get(pieces, i - 1), F.get(found, i - 1))).otherwise("")
        before = F.lower(F.substring(F.concat(earlier, F.get(pieces, i)), -CONTEXT_CHARS, CONTEXT_CHARS))
        near = F.when(before.rlike(rule["words"]), rule["gain"]).otherwise(0.0) - F.when(before.rlike(rule["against"]), rule["loss"]).otherwise(0.0)
        return rule["prior"] + F.when(_valid(kind, m), rule["test"]).otherwise(-1.0) + near

    def located(found: Column, pieces: Column) -> Column:
        """A match starts after all earlier pieces and matches and its own piece."""
        lengths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))

        def span(m: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(pieces, i))
            return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(m)).alias("end"), score(m, i, found, pieces).alias("score"))

        return let(running(lengths, lambda a, x: a + x), lambda at: F.filter(F.transform(found, lambda m, i: span(m, i, at)), lambda x: x["score"] >= KEEP_SCORE))

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    scored = lambda found: let(F.split(text, pattern, -1), lambda pieces: located(found, pieces))
    return F.when(gate(text), let(every, lambda found: F.when(F.size(found) == 0, empty).otherwise(scored(found)))).otherwise(empty)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, one array of spans for each kind)."""
    df = docs.select("doc_id", text_of("text").alias("text"))
    return df.withColumns({f"at_{k}": _spans(F.col("text"), k) for k in KINDS}).drop("text")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    base, every = [F.col(f"at_{k}") for k in BASE], [F.col(f"at_{k}") for k in KINDS]
    return found.select("doc_id", *[F.size(f"at_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_written(F.concat(*base)), 256).alias("base_sha256"), _written(F.concat(*every)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``docs`` (doc_id, text) with every span replaced by its kind's mark; overlapping spans go together under the first one's.

    The text is cut into pieces of ``PIECE`` code points, from which what lies between spans is put together.
    """
    names = F.array(*[F.lit(mark.format(k.upper())) for k in KINDS])
    every = F.sort_array(F.concat(*[_spans(F.col("text"), k) for k in KINDS]))
    df = docs.select("doc_id", text_of("text").alias("text")).select("doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length("text").alias("n"), every.alias("all"))
    # a span that starts behind all earlier ends opens a run; the text before it goes back to those ends
    reach = running(F.transform("all", lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    opened = lambda at: F.filter(F.transform("all", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(at, i).alias("done"))), lambda h: h["start"] >= h["done"])
    df = df.withColumn("heads", let(reach, opened)).withColumn("last", F.coalesce(F.array_max(F.transform("all", lambda s: s["end"])), F.lit(0)))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """Code points [a, b) of the text."""
        p, q = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        inner = F.array_join(F.slice(pieces, p + 2, F.greatest(q - p - 1, F.lit(0))), "")
        return F.when(p == q, F.substring(piece(p), a % PIECE + 1, b - a)).otherwise(F.concat(F.substring(piece(p), a % PIECE + 1, F.lit(PIECE)), inner, F.substring(piece(q), F.lit(1), b % PIECE)))

    part = lambda pieces, h: F.concat(between(pieces, h["done"], h["start"]), F.get(names, h["kind"]))
    whole = lambda pieces: F.concat(F.array_join(F.transform("heads", lambda h: part(pieces, h)), ""), between(pieces, F.col("last"), F.col("n")))
    return df.select("doc_id", let(F.col("pieces"), whole).alias("text"))
