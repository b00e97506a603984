"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. The patterns match what their plain forms (in comments) match, but are written so that
Java's matcher neither backtracks over long runs nor recurses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.matches import CONTEXT, matches

#: Base kinds, in the order of the digest.
BASE = ["email", "ip", "card", "phone"]
#: Kinds that the method adds: bank accounts by their checksum, social security numbers by their context.
ADDED = ["iban", "ssn"]

#: Characters of an account number by country, as registered.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size, codes in IBAN_SIZES.items()]
_OTHER_COUNTRY = rf"(?!{'|'.join(' '.join(IBAN_SIZES.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+"

PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: such matches are whole runs, so shorter and longer runs are no match
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": "|".join([*_IBAN, _OTHER_COUNTRY]),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Cheap conditions that any text with a match meets.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Words near a span, in lower case, that make its kind more likely, and how likely the kind is without them.
WORDS = {
    "email": r"e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse|addr",
    "card": r"card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel|call|mobile|fax|handy",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social security",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
#: What a context word adds.
CONTEXT_BONUS = 0.1
#: Spans of the added kinds need this score.
LEAST_SCORE = 0.5

_VERSION_WORDS = r"version|release|build|v\.? ?$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octets(x: Column) -> Column:
    def small(part: Column) -> Column:
        value = F.ltrim(part, F.lit("0"))
        return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))

    return F.forall(F.split(x, r"\."), small)


def _mod97(x: Column) -> Column:
    plain = F.regexp_replace(x, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).when(code >= 48, (acc * 10 + code - 48) % 97).otherwise(acc).cast("int")

    return F.aggregate(turned, F.lit(0), step) == 1


def _apart(m: Column, kinds: str) -> Column:
    """Neither neighbour of the match is of these characters."""
    return ~F.right(m["before"], F.lit(1)).rlike(f"^[{kinds}]") & ~F.left(m["after"], F.lit(1)).rlike(f"^[{kinds}]")


#: What a proposed span must pass.
VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: _octets(m["value"]),
    "card": lambda m: F.call_function("luhn_check", _digits(m["value"])),
    "phone": lambda m: F.length(_digits(m["value"])).between(9, 15),
    "iban": lambda m: _apart(m, "A-Za-z0-9") & _mod97(m["value"]),
    "ssn": lambda m: _apart(m, "0-9-") & ~m["value"].rlike("^(000|666|9)|-00-|-0000$"),
}


def _score(kind: str, m: Column) -> Column:
    near = F.lower(F.concat_ws(" ", m["before"], m["after"])).rlike(WORDS[kind])
    score = F.lit(PRIOR[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
    if kind == "ip":  # four numbers after such a word are more likely a version
        score = score - F.when(F.lower(m["before"]).rlike(_VERSION_WORDS), 0.3).otherwise(0.0)
    return F.round(score, 3)


def spans(text: Column, kind: str) -> Column:
    """The confirmed spans of a kind: start, end, value, score, in order."""
    found = F.filter(matches(text, PATTERNS[kind], HINTS[kind](text)), VALID[kind])
    scored = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), _score(kind, m).alias("score")))
    return F.filter(scored, lambda s: s["score"] >= LEAST_SCORE) if kind in ADDED else scored


def found(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with one array of spans (start, end, value, score) for each kind, in code points, ends exclusive.

    A null text counts as empty: empty arrays. Columns with the names of the kinds are replaced. Texts are taken
    whole, repeated rows get the same answer, and an empty table stays empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({kind: spans(whole, kind) for kind in [*BASE, *ADDED]})


def _listed(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def digest(kinds: list[str]) -> Column:
    """kind:start:end of every span, by kind, then start, joined with commas."""
    return F.array_join(F.flatten(F.array(*[_listed(k) for k in kinds])), ",")


def redacted(text: str, kind: str) -> Column:
    """The text with the spans of a kind replaced by the kind in brackets."""
    ends = F.concat(F.array(F.lit(0)), F.transform(kind, lambda s: s["end"]))
    starts = F.concat(F.transform(kind, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a)), f"[{kind.upper()}]")


def _kind_sql(kind: str, pattern: str, valid: str) -> str:
    """Spans of a kind as kind:start:end texts, for each document."""
    near = f"right(p[i], {CONTEXT})"
    after = f"left(p[i + 1], {CONTEXT})"
    size = lambda part: f"coalesce(list_sum(list_transform({part}, lambda s: length(s))), 0)"
    return f"""
  SELECT doc_id, '{kind}' AS kind, pos, pos + length(v) AS till FROM (
    SELECT doc_id, CAST({size("p[1:i]")} + {size("m[1:i - 1]")} AS BIGINT) AS pos, m[i] AS v, {near} AS before, {after} AS after FROM (
      SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM texts)))
  WHERE {valid}"""


_NUMBER = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""length({_NUMBER}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_NUMBER}) + 1), lambda k:
    CASE WHEN k % 2 = 1 THEN CAST(reverse({_NUMBER})[k] AS INTEGER) ELSE (2 * CAST(reverse({_NUMBER})[k] AS INTEGER)) // 10 + (2 * CAST(reverse({_NUMBER})[k] AS INTEGER)) % 10 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4], ''), lambda c:
    CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, b: CASE WHEN b >= 10 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1"""
_KINDS_SQL = " UNION ALL ".join(
    _kind_sql(kind, pattern, valid)
    for kind, pattern, valid in [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_NUMBER}) BETWEEN 9 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", f"NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]') AND {_MOD97}"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", f"NOT regexp_matches(right(before, 1), '[0-9-]') AND NOT regexp_matches(left(after, 1), '[0-9-]') AND NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') AND regexp_matches(lower(before || ' ' || after), '{WORDS['ssn']}')"),
    ]
)
#: Counts, digest and spans of every document.
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS MATERIALIZED ({_KINDS_SQL}
), ordered AS (
  SELECT doc_id, kind, kind || ':' || pos || ':' || till AS span, list_position({[*BASE, *ADDED]}, kind) AS k, pos FROM spans
), joined AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in [*BASE, *ADDED])},
    string_agg(span, ',' ORDER BY k, pos) FILTER (k <= {len(BASE)}) AS base, string_agg(span, ',' ORDER BY k, pos) AS spans
  FROM ordered GROUP BY doc_id
)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ADDED)}
FROM texts t LEFT JOIN joined j ON t.doc_id = j.doc_id
"""
