"""Personal data, native: regular expressions propose spans, checksums confirm them, context words adjust a score.

Kinds and validators: email, ip (four parts of at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits),
iban (mod-97), ssn (three, two and four digits, of an area that is given out), account (8 to 12 digits) and secret (20 or more letters and
digits, both among them). A span that fails its validator is dropped. Its score is the prior of its kind plus
``CONTEXT_GAIN`` if a context word of the kind stands within ``CONTEXT`` characters before it. Spans of the four base kinds
are always kept, the others from ``THRESHOLD`` on: the checksum of an iban suffices, while ssn, account and secret have no checksum and
need a context word. Of a run of letters and digits in groups that starts like an iban, the longest part that passes is the iban;
one that follows another with nothing but a space between may be missed. Offsets are code points, end exclusive.

The expressions are written so that Java's matcher never backtracks over a run: possessive quantifiers, and a
look-behind that lets a match start only where a run starts (or where the last match ended). They match what the plain forms match.

Null and empty texts have no spans. Repeated rows and null ids give one result row each; an empty table an empty one.
Further columns of any name, dots and double underscores included, pass through ``detect`` and ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
CONTEXT_GAIN = 0.25
THRESHOLD = 0.5
#: Matches of a text are placed in blocks of this many, so that the work does not grow with their square.
BLOCK = 128


@dataclass(frozen=True)
class Kind:
    """order sorts spans of equal start; hint is a cheap test for texts that can hold the kind at all."""

    name: str
    order: int
    pattern: str
    hint: str
    prior: float
    context: str
    base: bool = True


KINDS = (
    Kind("email", 0, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"(?i)\b(e-?mail|mailto|contact|write)\b"),
    Kind("ip", 1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"(?i)\b(ip|host|server|address|login)\b"),
    Kind("card", 2, r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, r"(?i)\b(card|visa|credit|debit|payment)\b"),
    Kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"(?i)\b(phone|tel|call|mobile|fax)\b"),
    Kind("iban", 4, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", "", 0.6, r"(?i)\b(iban|bank|account|konto)\b", base=False),
    Kind("ssn", 5, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, r"(?i)\b(ssn|social security)\b", base=False),
    Kind("account", 6, r"(?<![A-Za-z0-9.+-])[0-9]{8,12}+(?![A-Za-z0-9-]|\.[0-9])", "", 0.3, r"(?i)\b(account|acct|konto|cuenta|compte)\b", base=False),
    Kind("secret", 7, r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", "", 0.3, r"(?i)\b(token|secret|api[ _-]?key|access[ _-]?key|password|passwd|bearer)\b", base=False),
)


#: Cheap tests for texts that can hold a kind, where one letter does not tell.
HINTS = {"card": r"[0-9][\x20-]?[0-9]"}


def _digits(match):
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits):
    """Whether a string of digits passes Luhn's check."""
    reverse = F.reverse(F.split(digits, ""))
    parts = F.transform(F.filter(reverse, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x * 2 - 9 * (x > 4)) for x in range(10)]), d.cast("int") + 1)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match):
    """Whether an IBAN (spaces allowed) leaves the remainder 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: Kind, match):
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind.name == "card":
        n = F.length(_digits(match))
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(False)
    if kind.name == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind.name == "iban":
        return match != ""
    if kind.name == "ssn":
        return ~match.rlike("^(000|666|9)") & ~match.rlike("-00-|-0000$")
    if kind.name == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _taken(kind: Kind, match):
    """The part of a match that is the span: all of it, or the longest part up to a space that is an iban."""
    if kind.name != "iban":
        return match
    groups = F.split(match, " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    good = F.filter(parts, lambda p: F.length(F.replace(p, F.lit(" "), F.lit(""))).between(15, 34) & mod97(p))
    return F.when(match.isNotNull(), F.coalesce(F.get(good, F.size(good) - 1), F.lit("")))


def _spans(kind: Kind, text):
    """Valid spans of one kind: struct(start, order, kind, end)."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    found = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), matches.alias("match"))
    empty = "cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)"
    cut = F.transform(F.sequence(F.lit(1), F.size(found), F.lit(BLOCK)), lambda i: F.slice(found, i, BLOCK))
    length = lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["match"]), F.lit(0))
    sizes = F.transform(cut, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + length(x)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))

    def placed(block, i):
        def step(acc, x):
            start, taken = acc["at"] + F.char_length(x["gap"]), _taken(kind, x["match"])
            span = F.struct(start.alias("start"), F.lit(kind.order).alias("order"), F.lit(kind.name).alias("kind"), (start + F.char_length(taken)).alias("end"))
            kept = F.coalesce(taken.isNotNull() & _valid(kind, taken), F.lit(False))
            return F.struct((acc["at"] + length(x)).alias("at"), F.when(kept, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(block, F.struct(F.get(starts, i).alias("at"), F.expr(empty).alias("spans")), step, lambda acc: acc["spans"])

    spans = F.flatten(F.transform(cut, placed))
    some = F.contains(text, F.lit(kind.hint)) if kind.hint else text.rlike(HINTS.get(kind.name, kind.pattern))
    return F.when(some, spans).otherwise(F.expr(empty))


def _free(docs: DataFrame) -> str:
    """A prefix that no column of docs begins with."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def detect(docs: DataFrame, name: str = "pii") -> DataFrame:
    """docs with the column ``name``: array of struct(start, order, kind, end, score), sorted by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    free = _free(docs)
    found = docs.select("*", *[_spans(k, text).alias(f"{free}{k.name}") for k in KINDS])
    spans = F.concat(*[F.col(f"{free}{k.name}") for k in KINDS])

    def scored(s):
        before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        near, prior = F.lit(False), F.lit(0.0)
        for k in KINDS:
            near = F.when(s["kind"] == k.name, before.rlike(k.context)).otherwise(near)
            prior = F.when(s["kind"] == k.name, F.lit(k.prior)).otherwise(prior)
        return F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"), (prior + F.when(near, CONTEXT_GAIN).otherwise(0.0)).alias("score"))

    base = F.array(*[F.lit(k.name) for k in KINDS if k.base])
    kept = F.filter(F.transform(F.array_sort(spans), scored), lambda s: F.array_contains(base, s["kind"]) | (s["score"] >= THRESHOLD))
    return found.withColumn(name, F.when(F.size(spans) > 0, kept).otherwise(F.transform(spans, scored))).drop(*[f"{free}{k.name}" for k in KINDS])


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_other (spans of the other kinds) and scores (of the spans, in their order)."""
    found = detect(docs.select("doc_id", "text")).drop("text")
    names = [k.name for k in KINDS if k.base]
    base = F.filter("pii", lambda s: s["kind"].isin(names))

    def count(name):
        return F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *[count(n) for n in names], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), (F.size("pii") - F.size(base)).cast("long").alias("n_other"), F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; where spans overlap, the first one's name covers them all."""
    name = f"{_free(docs)}pii"
    found = detect(docs, name)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate(name, zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    return found.withColumn("text", F.when(F.size(name) > 0, masked).otherwise(F.col("text"))).drop(name)
