"""Personal data spans: patterns propose, checksums confirm, nearby words score.

Only DataFrame functions run here. A pattern's matches and the pieces between
them come from the same Java matcher, so running sums of their lengths give code
point positions. Every pattern starts only where a run of its first characters
starts (or where the last match ended) and repeats possessively, which finds the
same matches in linear time on texts of any shape.

Kinds and what confirms them:

* ``email``; ``ip`` (parts of at most 255); ``card`` (12 to 19 digits, Luhn);
  ``phone`` (international, 9 to 15 digits): the base kinds, each leftmost and
  non-overlapping, a failing match dropped without another try;
* ``iban``: two letters, two digits and 11 to 30 letters or digits, in one run
  or in fours, whose rearranged number is 1 modulo 97;
* ``ssn``: ddd-dd-dddd outside the ranges never issued, kept if its score
  reaches the threshold;
* ``tel``: a national telephone number, kept if its score does;
* ``secret``: a key or token, 20 to 128 letters, digits and marks in one run with
  letters, digits and at least ten different characters, kept if its score does.

A span's score starts at its kind's prior; a context word in the
``context_chars`` characters before it raises the score, an opposing one lowers it.
Base spans are kept whatever their score.

Defined results: a null or empty text has no spans; a text of any length is read
whole, in time that grows with it; repeated rows give repeated results; an empty
table none; ``find`` ignores other columns, ``redact`` hands them on whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import as_struct, restored

BASE_KINDS = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
THRESHOLD = 0.6
_GROUP = 256

# The patterns of each kind.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "tel": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,5}\)[ -]?|0[0-9]{1,4}[ /-])[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,128}+={0,2}+(?![A-Za-z0-9_+/=-])",
}
# A character or sequence without which a pattern cannot match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
# A short pattern without which a pattern cannot match.
NEEDS_MATCH = {"card": r"[0-9][\x20-]?[0-9]", "iban": "[0-9]{2}", "tel": "[0-9]{2}", "secret": "[A-Za-z0-9_+/-]{20}"}
# Priors, and words near a span that speak for or against its kind.
PRIORS = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "tel": 0.4, "secret": 0.4}
FOR = {
    "email": "mail|e-mail|email|contact|correo|courriel",
    "ip": "ip|address|host|server|login|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|security number",
    "tel": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "secret": "token|secret|password|passwd|pwd|api key|api_key|api-key|apikey|key|credential|credentials|bearer|auth",
}
AGAINST = {
    "ip": "version|release|section|chapter",
    "card": "isbn|order|invoice|tracking|serial",
    "ssn": "part|model|order|isbn|serial",
    "tel": "isbn|order|invoice|part|serial|version",
    "secret": "commit|revision|checksum|digest|md5|sha1|sha256|uuid",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """The remainder by 97 of an IBAN's number: first four characters last, letters as 10 to 35."""
    bare = F.regexp_replace(value, " ", "")
    moved = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")

    def step(rest: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.right(x, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        d = _digits(value)
        return F.length(d).between(12, 19) & F.call_function("luhn_check", F.when(F.length(d).between(12, 19), d).otherwise("1"))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & (_mod97(value) == 1)
    if kind == "tel":
        return F.length(_digits(value)).between(8, 14)
    if kind == "secret":
        return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (F.size(F.array_distinct(F.split(value, ""))) >= 10)
    return F.lit(True)


def _pairs(kind: str, text: Column) -> Column:
    """Array of (value, piece): a pattern's matches, and the text between the match before and it."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pieces = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    pairs = F.zip_with(found, pieces, lambda v, p: F.struct(v.alias("value"), p.alias("piece")))
    possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.rlike(text, F.lit(NEEDS_MATCH[kind]))
    return F.when(possible, pairs).otherwise(F.array().cast("array<struct<value:string,piece:string>>"))


def _grouped(pairs: Column) -> Column:
    """The pairs in arrays of _GROUP: what is done pair by pair copies at most a group, not all that came before."""
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pairs) / _GROUP).cast("int") - 1, F.lit(0)))
    return F.transform(numbers, lambda g: F.slice(pairs, g * _GROUP + 1, F.lit(_GROUP)))


def _proposed(kind: str, groups: Column) -> Column:
    """Array of (value, start, before) of the valid matches; start and before in code points."""

    def begun(state: Column, group: Column) -> Column:
        size = F.aggregate(group, F.lit(0), lambda n, pair: n + F.length(pair["piece"]) + F.length(pair["value"]))
        return F.struct((state["at"] + size).cast("int").alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all"))

    starts = F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), begun, lambda s: s["all"])

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        span = F.struct(pair["value"].alias("value"), start.alias("start"), F.right(pair["piece"], F.lit(CONTEXT_CHARS)).alias("before"))
        return F.struct(
            (start + F.length(pair["value"])).cast("int").alias("at"),
            F.when(_valid(kind, pair["value"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    none = F.array().cast("array<struct<value:string,start:int,before:string>>")
    return F.flatten(F.zip_with(groups, starts, lambda g, at: F.aggregate(g, F.struct(at.alias("at"), none.alias("spans")), step, lambda s: s["spans"])))


def _confirmed(kind: str, proposed: Column) -> Column:
    """Array of (start, rank, kind, end, score) of the valid matches that their context lets stand."""
    rank = list(PATTERNS).index(kind)

    def score(before: Column) -> Column:
        low = F.lower(before)
        value = F.lit(PRIORS[kind]) + F.when(F.rlike(low, F.lit(rf"(?<!\pL)(?:{FOR[kind]})(?!\pL)")), 0.3).otherwise(0.0)
        if kind in AGAINST:
            value = value - F.when(F.rlike(low, F.lit(rf"(?<!\pL)(?:{AGAINST[kind]})(?!\pL)")), 0.3).otherwise(0.0)
        return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 2)

    spans = F.transform(
        proposed,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (s["start"] + F.length(s["value"])).cast("int").alias("end"),
            score(s["before"]).alias("score"),
        ),
    )
    return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and ``spans``, an array of (start, rank, kind, end, score).

    ``tel`` and ``secret`` spans that overlap a base span are left out: they are the same data.
    """
    out = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = out.withColumns({f"_{k}": _pairs(k, F.col("_text")) for k in PATTERNS}).drop("_text")
    out = out.withColumns({f"_{k}": _grouped(F.col(f"_{k}")) for k in PATTERNS})
    out = out.withColumns({f"_{k}": _proposed(k, F.col(f"_{k}")) for k in PATTERNS})
    out = out.withColumns({f"_{k}": _confirmed(k, F.col(f"_{k}")) for k in PATTERNS})
    base = F.concat(*[F.col(f"_{k}") for k in BASE_KINDS])
    more = F.filter(
        F.concat(*[F.col(f"_{k}") for k in PATTERNS if k not in BASE_KINDS]),
        lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & s["kind"].isin("tel", "secret")),
    )
    return out.withColumn("_base", base).select("doc_id", F.array_sort(F.concat("_base", more)).alias("spans"))


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, all spans as text, and counts of the other kinds and of all spans."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        *[count(k) for k in PATTERNS if k not in BASE_KINDS], F.size("spans").cast("long").alias("n_spans"),
    )


def redact(documents: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with each span's text replaced by ``[KIND]``; where spans overlap, the first stands."""
    # The caller's columns travel in one struct, so that their names cannot clash.
    text = F.col("row")[text_col]
    spans = found.groupBy(F.col("doc_id").alias("_id")).agg(F.first("spans").alias("_spans"))

    def step(state: Column, s: Column) -> Column:
        fits = s["start"] >= state["at"]
        piece = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.when(fits, s["end"]).otherwise(state["at"]).alias("at"),
            F.when(fits, F.concat(state["out"], piece, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(state["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1))
    joined = documents.select(as_struct(documents)).join(spans, F.col("row")[id_col].eqNullSafe(F.col("_id")), "left")
    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", zero, step, rest)).otherwise(text)
    return restored(joined, documents.columns, **{text_col: clean})
