"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score. DataFrame functions only.

Positions are code points, ends exclusive. The base kinds (email, ip, card, phone) follow fixed patterns and tests, and
every one that passes is kept; the further kinds (iban, secret) are kept from a score of KEEP on. A secret is a key of a known
form or whatever follows its name, to its end; a run of twenty or more mixed signs with neither is one only if a context word
stands before it. A failing match is dropped without another try inside it.

Defined results: a null text counts as empty and has no spans; of spans that start together the kind listed first comes
first; rows with null or repeated keys are kept, each with its own result; an empty table gives no rows; all other columns
pass through unchanged, whatever their names. Time and memory are proportional to a text and its findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let, scan, unused

#: In the order in which kinds are listed where two spans start together.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
#: The same matches as the plain patterns, written so that no engine state grows with a match: possessive, and a match
#: begins at the start of its run of characters, or (\G) right after the last one.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{8,}+\"?|[A-Za-z0-9+/_-]{20,}+(?!\x20?[=:]))",
}
#: What a match must hold to be looked for at all (cheap, and true of every match).
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words that make a kind likelier when they stand within REACH code points before a span.
CONTEXT = {
    "email": r"mail|contact|write|reach", "ip": r"address|host|server|ip\b", "card": r"card|visa|credit|payment|tarjeta|karte|carte",
    "phone": r"call|phone|tel|mobile|fax", "iban": r"iban|bank|account|konto|compte|cuenta", "secret": r"key|login|secret|token|password",
}
REACH = 40
#: Of confirmed matches; a context word adds LIFT. A run of signs that nothing names a secret is a weak proposal: context alone
#: brings it to KEEP.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "secret": 0.6}
WEAK = 0.45
LIFT = 0.1
KEEP = 0.5
#: What tells a named secret from a mere run of signs.
NAMED = r"^AKIA[A-Z0-9]{16}$|[=:]"
#: Code points in a piece of text that a masked span is cut from.
_PIECE = 1024


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's test (every second digit from the right doubled)."""
    back = F.split(F.reverse(number), "")
    value = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code's check digits hold: moved to the end, letters as 10 to 35, remainder 1."""
    code = F.regexp_replace(code, " ", "")
    turned = F.split(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4)), "")
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def octets(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


CONFIRM: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(10, 15),
    "iban": mod97,
    "secret": lambda m: m.rlike("[0-9]") & (m.rlike(NAMED) | (m.rlike("[A-Z]") & m.rlike("[a-z]"))),
}


def base_score(kind: str, match: Column) -> Column:
    """A confirmed match's score without its context."""
    return F.when(match.rlike(NAMED), SCORE[kind]).otherwise(WEAK) if kind == "secret" else F.lit(SCORE[kind])


_TYPE = "array<struct<start:bigint,rank:int,end:bigint,score:double>>"


def _spans(kind: str, text: Column, hits: Column) -> Column:
    """The confirmed matches of one kind as structs, in time proportional to text and matches.

    The text is split once into what lies between the matches; positions are running totals of the lengths of gaps and
    matches, and a match's context is the end of the match before it and of the gap.
    """
    rank = KINDS.index(kind)

    def found(gaps: Column) -> Column:
        before = F.concat(F.array(F.lit("")), hits)  # one too many
        lead = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.slice(before, F.lit(1), F.size(hits)), lambda g, h: F.struct(F.length(g).cast("bigint").alias("gap"), F.right(F.concat(F.right(h, F.lit(REACH)), F.right(g, F.lit(REACH))), F.lit(REACH)).alias("context")))
        ends = scan(F.zip_with(lead, hits, lambda x, h: x["gap"] + F.length(h)), lambda x, y: x + y, "bigint")
        each = F.zip_with(F.zip_with(hits, lead, lambda h, x: F.struct(h.alias("match"), x["context"].alias("context"))), ends, lambda m, end: F.struct(m["match"].alias("match"), m["context"].alias("context"), end.alias("end")))
        sure = F.filter(each, lambda s: CONFIRM[kind](s["match"]))
        lift = lambda s: F.when(F.lower(s["context"]).rlike(CONTEXT[kind]), LIFT).otherwise(0.0)
        return F.transform(sure, lambda s: F.struct((s["end"] - F.length(s["match"])).alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), (base_score(kind, s["match"]) + lift(s)).alias("score")))

    out = let(F.split(text, PATTERNS[kind], -1), found).cast(_TYPE)
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= KEEP)


def find_pii(docs: DataFrame, text: str = "text", into: str = "findings") -> DataFrame:
    """docs with a further column into: an array of (start, rank in KINDS, end, score), by start and then rank."""
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the column {into} is there already")
    own = unused(docs, *[f"_{k}" for k in KINDS])
    body = F.coalesce(F.col(text), F.lit(""))

    def hits(kind: str) -> Column:
        all_ = F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(body, F.lit(NEEDS[kind])), all_) if kind in NEEDS else all_

    docs = docs.withColumns({c: hits(k) for k, c in zip(KINDS, own, strict=True)})
    empty = F.array().cast(_TYPE)
    each = [F.when(F.size(F.col(c)) > 0, _spans(k, body, F.col(c))).otherwise(empty) for k, c in zip(KINDS, own, strict=True)]
    return docs.withColumn(into, F.array_sort(F.concat(*each))).drop(*own)


def listing(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scores(findings: Column) -> Column:
    """The spans' scores, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.format_number(s["score"], 2)), ",")


def mask(text: Column, findings: Column) -> Column:
    """text with each span (overlapping ones as one, named after the first) replaced by its kind in square brackets.

    A span begins a mask where it starts at or after the greatest end before it; what lies between masks is cut from pieces
    of the text, so the time is proportional to text and findings.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Code points a to b."""
        i, j = F.floor(a / _PIECE).cast("int"), F.floor((b - 1) / _PIECE).cast("int")
        head = F.substring(F.get(pieces, i), (a % _PIECE + 1).cast("int"), F.least(b - a, F.lit(_PIECE)).cast("int"))
        middle = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        tail = F.when(j > i, F.substring(F.get(pieces, j), F.lit(1), ((b - 1) % _PIECE + 1).cast("int"))).otherwise("")
        return F.when(b > a, F.concat(head, middle, tail)).otherwise("")

    def masked(pieces: Column) -> Column:
        def join(ends: Column) -> Column:
            spans = F.zip_with(findings, F.concat(F.array(F.lit(0).cast("bigint")), ends), lambda s, e: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), e.alias("before")))
            opens = F.filter(spans, lambda s: s["start"] >= s["before"])
            each = F.transform(opens, lambda s: F.concat(cut(pieces, s["before"], s["start"]), F.get(names, s["rank"])))
            return F.concat(F.array_join(each, ""), cut(pieces, F.element_at(ends, -1), F.length(text).cast("bigint")))

        return let(scan(F.transform(findings, lambda s: s["end"]), lambda x, y: F.greatest(x, y), "bigint"), join)

    return F.when(F.size(findings) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), masked)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every finding masked in text; no row is dropped, null stays null."""
    (name,) = unused(docs, "findings")
    found = find_pii(docs, text, name)
    return found.withColumn(text, mask(F.col(text), F.col(name))).drop(name)


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base listing, the listing of all spans, and their scores."""
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "findings")
    of = lambda i: F.filter("findings", lambda s: s["rank"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = F.filter("findings", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("findings")).alias("spans"), scores(F.col("findings")).alias("scores"))
