"""Personal data by patterns, checksums and context, in Spark SQL expressions only.

Regular expressions propose spans; validators confirm them (Luhn for cards, mod 97 for
account numbers, ranges for addresses); words near a span adjust its score.  No shuffle,
no Python on the executors.

Positions come from splitting: the pieces between the matches and the matches themselves
alternate, so a running sum of their lengths gives every start; sums, context and the
comparison with base spans take time in proportion to a text and its matches, but for a
logarithm.  Quantifiers are possessive and starts are anchored at the beginnings of runs,
which changes no match but keeps the search linear in long runs.

Base kinds, always kept: ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19 digits,
Luhn), ``phone`` (9 to 15 digits).  Added kinds, kept from a score of ``LEAST`` on and
only where they touch no base span: ``iban`` (mod 97), ``ssn`` and ``tel`` (local number),
of which the last two need a context word.

Cases: null and empty texts have no spans; repeated rows are searched one by one; offsets
count code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm import shared

LEAST = 0.5
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 48, 24
#: Characters of the pieces that a text is cut into to look around matches.
PIECE = 64
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![0-9A-Za-z_])",
    "ssn": r"(?<![0-9A-Za-z_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_])",
    "tel": r"(?<![0-9A-Za-z_])[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z_])",
}
#: Confidence of a confirmed pattern without any context.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35, "tel": 0.3}
#: What a context word adds, and the words.
BOOST = 0.3
CONTEXT = {
    "email": "mail|contact|write to|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
    "tel": "phone|call|tel|fax|mobile|telefon|téléphone|teléfono",
}


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 0, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def octets_fit(address: Column) -> Column:
    def fits(part):
        short = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(short) > 3, F.lit(False)).when(short == "", F.lit(True)).otherwise(short.cast("int") <= 255)

    return F.forall(F.split(address, r"\."), fits)


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return octets_fit(m)
    if kind == "card":
        d = digits_of(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return F.lit(True)


def running(values: Column, join) -> Column:
    """Running ``join`` (a sum, a maximum) of an array, in as many passes as its length has bits."""
    steps = F.filter(F.array(*[F.lit(1 << b) for b in range(31)]), lambda p: p < F.size(values))
    return F.aggregate(steps, values, lambda acc, p: F.transform(acc, lambda v, i: F.when(i >= p, join(v, F.get(acc, i - p))).otherwise(v)))


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """All columns of ``docs`` with ``out_col``: array of (kind, start, end, score), by kind, then start.

    An input column named like ``out_col`` comes back as ``<name>_input``.
    """
    df = shared.boxed(docs, text_col).withColumn("t", F.coalesce("text", F.lit("")))
    df = df.withColumn("numeric", F.col("t").rlike("[0-9]"))
    asked = {k: F.col("numeric") for k in KINDS} | {"email": F.contains("t", F.lit("@")), "phone": F.col("numeric") & F.contains("t", F.lit("+"))}
    nothing = F.array().cast("array<string>")
    df = df.select("*", *[F.when(asked[k], F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(nothing).alias(f"m_{k}") for k in KINDS])
    any_match = F.lit(False)
    for k in KINDS:
        any_match = any_match | (F.size(f"m_{k}") > 0)
    # the text in pieces of PIECE characters, so that what stands near a match is at hand
    df = df.select("*", F.when(any_match, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(nothing).alias("pieces"), *[F.when(F.size(f"m_{k}") > 0, F.split("t", PATTERNS[k], -1)).otherwise(nothing).alias(f"p_{k}") for k in KINDS])
    item = "array<struct<start:int,m:string>>"

    def holds(k):
        return lambda x: confirmed(k, x["m"])

    def placed(k):
        gaps = F.slice(f"p_{k}", F.lit(1), F.size(f"m_{k}"))
        ends = running(F.zip_with(gaps, f"m_{k}", lambda p, m: F.coalesce(F.length(p) + F.length(m), F.lit(0))), lambda a, b: a + b)
        return F.zip_with(ends, f"m_{k}", lambda e, m: F.struct((e - F.length(m)).alias("start"), m.alias("m")))

    df = df.select("row", "text", "pieces", *[F.when(F.size(f"m_{k}") > 0, F.filter(placed(k), holds(k))).otherwise(F.array().cast(item)).alias(k) for k in KINDS])

    def cut(at, n):
        """The text's ``n`` characters from ``at`` on; ``n`` is at most PIECE."""
        nth = F.floor(at / PIECE).cast("int")
        return F.substring(F.concat(F.coalesce(F.get("pieces", nth), F.lit("")), F.coalesce(F.get("pieces", nth + 1), F.lit(""))), at - nth * PIECE + 1, n)

    def scored(k):
        def score(x):
            begin = F.greatest(F.lit(0), x["start"] - BEFORE)
            near = F.lower(F.concat(cut(begin, x["start"] - begin), F.lit(" "), cut(x["start"] + F.length(x["m"]), F.lit(AFTER))))
            return F.struct(F.lit(k).alias("kind"), x["start"].cast("long").alias("start"), (x["start"] + F.length(x["m"])).cast("long").alias("end"), F.round(F.lit(SCORE[k]) + F.when(near.rlike(rf"(?:^|[^a-z])(?:{CONTEXT[k]})"), F.lit(BOOST)).otherwise(F.lit(0.0)), 2).alias("score"))

        return F.transform(k, score)

    more = F.filter(F.concat(*[scored(k) for k in KINDS[len(BASE) :]]), lambda x: x["score"] >= LEAST)
    df = df.select("row", "text", F.concat(*[scored(k) for k in BASE]).alias("base"), more.alias("more"))
    # sweep over base starts and the ends of the others: an added span is apart from all base
    # spans if those that begin before its end reach no farther than its start
    event = lambda at, last, n: F.struct(at.alias("at"), F.lit(last).cast("int").alias("last"), n.cast("long").alias("n"))
    begins = F.transform("base", lambda b: event(b["start"], 1, b["end"]))
    asks = F.transform("more", lambda x, i: event(x["end"], 0, i))
    events = F.array_sort(F.concat(begins, asks))
    swept = df.select("*", F.when((F.size("base") > 0) & (F.size("more") > 0), events).otherwise(F.slice(events, 1, 0)).alias("events"))
    reach = running(F.transform("events", lambda e: F.when(e["last"] == 1, e["n"]).otherwise(F.lit(-1).cast("long"))), F.greatest)
    swept = swept.select("*", F.zip_with("events", reach, lambda e, r: F.struct(e["last"].alias("last"), e["n"].alias("n"), r.alias("reach"))).alias("reached"))
    far = F.transform(F.array_sort(F.transform(F.filter("reached", lambda e: e["last"] == 0), lambda e: F.struct(e["n"].alias("n"), e["reach"].alias("reach")))), lambda e: e["reach"])
    swept = swept.select("row", "text", "base", "more", far.alias("far"))
    # zipped, not indexed: an expression inside a lambda would be evaluated for each element
    both = F.zip_with("more", "far", lambda x, r: F.struct(x.alias("x"), F.coalesce(r, F.lit(-1).cast("long")).alias("r")))
    apart = F.transform(F.filter(both, lambda b: b["r"] <= b["x"]["start"]), lambda b: b["x"])
    return shared.unboxed(swept.select("row", "text", F.concat("base", apart).alias(out_col)), docs, text_col, [out_col])
