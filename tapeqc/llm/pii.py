"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their score. SQL functions only.

Kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (`+`, 9 to 15 digits), and, of this operator's own, iban (mod-97) and
tel (a national number without `+`, kept only when a context word stands near). Spans of a kind never overlap: they are the leftmost ones.

Defined results: a null or empty text has no spans; places count code points from 0, ends are exclusive; texts may be of any length; other
columns and repeated rows are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
# Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
#: Each finds what the plain pattern beside it finds, but a failed run of characters is never tried again from its middle.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",  # [0-9]([\x20-]?[0-9])+ with 13 digits or more
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])",
    "tel": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
BASE = ("email", "ip", "card", "phone")
# Context words by kind.
CONTEXT = {
    "email": "mail|contact|address|write",
    "ip": r"ip|host|server|address|login",
    "card": "card|credit|visa|master|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "tel": "phone|call|tel|mobile|fax",
}
#: A span's score before its context is read; context adds CONTEXT_SCORE. Spans below LEAST_SCORE are dropped; base kinds start above it.
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "tel": 0.3}
CONTEXT_SCORE, LEAST_SCORE, _NEAR = 0.3, 0.5, 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, k: Column) -> Column:
        x = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int") * (k % 2 + 1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether a compact IBAN passes its mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(total: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (total * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        compact = F.replace(value, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & mod97(compact)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(lengths: Column) -> Column:
    """The sum of the lengths before each: summed in runs of the array's square root, lest a long array is copied for each item."""

    def grown(start: Column, items: Column) -> Column:
        return F.aggregate(items, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def in_runs(z: Column) -> Column:
        items, run = z["items"], z["run"]
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / run).cast("int")), lambda k: F.slice(items, k * run + 1, run))
        return _let(runs, lambda rs: _let(grown(F.lit(0), F.transform(rs, lambda r: F.aggregate(r, F.lit(0), lambda s, x: s + x))), lambda firsts: F.flatten(F.transform(rs, lambda r, k: F.slice(grown(F.get(firsts, k), r), F.lit(1), F.size(r))))))

    run = lambda x: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
    return _let(lengths, lambda x: _let(F.struct(x.alias("items"), run(x).alias("run")), in_runs))


def _found(text: Column, kind: str) -> Column:
    """The kind's spans: the matches, placed by the lengths of the pieces of text between them, that pass its check.

    A match's context is read from the pieces beside it and beside its neighbours, so that no text is walked once for each match.
    """
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<kind: string, start: int, end: int, value: string, score: double>>")

    def spans(hits: Column, gaps: Column) -> Column:
        gap, hit = (lambda k: F.coalesce(F.get(gaps, k), F.lit(""))), (lambda k: F.coalesce(F.get(hits, k), F.lit("")))

        def span(h: Column, k: Column, at: Column) -> Column:
            before = F.right(F.concat(F.right(gap(k - 1), F.lit(_NEAR)), hit(k - 1), gap(k)), F.lit(_NEAR))
            after = F.left(F.concat(F.left(gap(k + 1), F.lit(_NEAR)), hit(k + 1), F.left(gap(k + 2), F.lit(_NEAR))), F.lit(_NEAR))
            points = F.lit(PRIOR[kind]) + F.when(F.concat(before, F.lit(" "), after).rlike(f"(?i)\\b(?:{CONTEXT[kind]})"), CONTEXT_SCORE).otherwise(0.0)
            start = F.get(at, k) + F.length(gap(k))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(h)).alias("end"), h.alias("value"), points.alias("score"))

        lengths = F.transform(hits, lambda h, k: F.length(gap(k)) + F.length(h))
        placed = _let(_starts(lengths), lambda at: F.transform(hits, lambda h, k: span(h, k, at)))
        return F.filter(placed, lambda s: F.coalesce(_valid(kind, s["value"]), F.lit(False)) & (s["score"] >= LEAST_SCORE))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda hits: F.when(F.size(hits) > 0, _let(F.split(text, pattern, -1), lambda gaps: spans(hits, gaps))).otherwise(none))


def find_pii(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS), out: str = "spans") -> DataFrame:
    """docs with `out`: array<struct<kind, start, end, value, score>>, by kind in the order given, then by start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(out, F.concat(*[_found(text, k) for k in kinds]))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Code points of a block of text from which gaps between spans are cut.
_BLOCK = 2048


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] in each span's place; spans that overlap are one, named by the first.

    The text is parted into blocks once, and what stands between spans is cut from these and joined: no span walks the text.
    """
    none = F.array().cast("array<struct<start: int, end: int, kind: string>>")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["pos"]
        # A span that begins inside goes on the one before: what it covers more is a span without a name.
        more = F.struct(F.greatest(s["start"], state["pos"]).alias("start"), s["end"].alias("end"), F.when(apart, s["kind"]).otherwise("").alias("kind"))
        return F.struct(F.greatest(state["pos"], s["end"]).alias("pos"), F.when(apart | (s["end"] > state["pos"]), F.array_append(state["out"], more)).otherwise(state["out"]).alias("out"))

    merged = F.aggregate(ordered, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda state: state["out"])
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def gap(b: Column, start: Column, end: Column) -> Column:
        first, last = (F.floor(x / _BLOCK).cast("int") for x in (start, end))
        block = lambda k: F.coalesce(F.get(b, k), F.lit(""))
        within = F.substring(block(first), start % _BLOCK + 1, end - start)
        across = F.concat(F.substring(block(first), start % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(b, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.substring(block(last), F.lit(1), end % _BLOCK))
        return F.when(first == last, within).otherwise(across)

    def parts(b: Column, m: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"])
        named = F.transform(m, lambda s, i: F.concat(gap(b, before(i), s["start"]), F.when(s["kind"] == "", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
        return F.concat(F.array_join(named, ""), gap(b, F.element_at(m, -1)["end"], F.length(text)))

    whole = _let(blocks, lambda b: _let(merged, lambda m: parts(b, m)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
