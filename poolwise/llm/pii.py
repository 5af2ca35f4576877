"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust their score.

A narrow scan without any shuffle, in DataFrame functions alone.  For one kind, ``split`` gives the text
between matches and ``regexp_extract_all`` the matches, so running lengths give each span's place in code
points.  Expressions for the base kinds are written so that a run of characters is entered at its start
only (a look-behind, or the end of the match before) and never given back; the matches are those of the
plain form in ``BASE``, in time that grows with the text.

Kinds: email, ip (parts to 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits); beyond these, iban
(15 to 34 characters, remainder 1 by 97) and nin (ddd-dd-dddd, kept only where nearby words raise its score
to ``KEEP``).  Overlaps between kinds stay: each kind is found by itself.

Defined cases: a null or empty text has no spans, zero counts, and the hash of the empty string; repeated
rows give repeated results; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The plain expressions of each kind, in the order in which kinds are listed.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}([\x20]?[A-Z0-9]{4}){2,7}([\x20]?[A-Z0-9]{1,3})?",
    "nin": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
BASE = ("email", "ip", "card", "phone")

#: The same matches, entered at the start of a run and without giving back.
_FAST = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
}
#: What a text must contain for a kind to be looked for.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "nin": "-"}

#: Score of a confirmed span in hundredths, what nearby words add, and the least score that is kept.
SCORE = {"email": 80, "ip": 60, "card": 80, "phone": 60, "iban": 80, "nin": 35}
ADDED, KEEP, NEAR = 20, 50, 40
#: Words that make a kind likelier, looked for in the NEAR code points before and after a span.
CONTEXT = {
    "email": "mail|contact|kontakt|contacto|correo|courriel",
    "ip": "server|host|address|adresse|dirección|ping",
    "card": "card|visa|credit|carte|karte|tarjeta|payment",
    "phone": "phone|call|tel|fax|anruf|appel|llama",
    "iban": "iban|bank|konto|compte|cuenta|account",
    "nin": "ssn|social|security|national id|insurance",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(char: Column, i: Column) -> Column:
        n = char.try_cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(text: Column) -> Column:
    bare = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.length(bare).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


def _confirmed(kind: str, text: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(text, r"\."), part)
    if kind == "card":
        return F.length(_digits(text)).between(16, 19) & _luhn(_digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return _mod97(text) if kind == "iban" else F.lit(True)


def _placed(kind: str, text: Column) -> Column:
    """Array of (start, end, found) in code points, of all matches."""
    found = F.regexp_extract_all(text, F.lit(_FAST[kind]), 0)
    both = F.arrays_zip(F.slice(F.split(text, _FAST[kind], -1), F.lit(1), F.size(found)).alias("gap"), found.alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _spans(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, score)."""

    def scored(span: Column) -> Column:
        before = F.substr(text, F.greatest(span["start"] - NEAR, F.lit(0)) + 1, F.least(span["start"], F.lit(NEAR)))
        after = F.substr(text, span["end"] + 1, F.lit(NEAR))
        near = F.lower(F.concat(before, F.lit("\n"), after)).rlike(CONTEXT[kind])
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), (F.lit(SCORE[kind]) + F.when(near, ADDED).otherwise(0)).alias("score"))

    kept = F.transform(F.filter(_placed(kind, text), lambda s: _confirmed(kind, s["found"])), scored)
    kept = F.filter(kept, lambda s: s["score"] >= KEEP)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:int>>")
    seen = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(seen, kept).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and, for each kind, an array of (kind, start, end, score)."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select(id_col, *(_spans(kind, F.col("_text")).alias(kind) for kind in PLAIN))


def _joined(spans: Column, score: bool = False) -> Column:
    parts = lambda s: [s["kind"], s["start"], s["end"], *([s["score"]] if score else [])]
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *(p.cast("string") for p in parts(s)))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(_joined(F.concat(*BASE)), 256).alias("base_sha256"),
        _joined(F.concat(*PLAIN)).alias("spans"),
        _joined(F.concat(*PLAIN), score=True).alias("scores"),
    )


def _oracle() -> str:
    digits = "regexp_replace(m.found, '[^0-9]', '', 'g')"
    luhn = "list_sum([CASE WHEN i % 2 = 1 THEN CAST(DIG[len(DIG) - i + 1] AS INT) WHEN CAST(DIG[len(DIG) - i + 1] AS INT) > 4 THEN CAST(DIG[len(DIG) - i + 1] AS INT) * 2 - 9 ELSE CAST(DIG[len(DIG) - i + 1] AS INT) * 2 END for i in range(1, len(DIG) + 1)]) % 10 = 0".replace("DIG", digits)
    moved = "(substr(replace(m.found, ' ', ''), 5) || substr(replace(m.found, ' ', ''), 1, 4))"
    rest = f"list_reduce(list_prepend(0, [CASE WHEN ascii(c) >= 65 THEN ascii(c) + 45 ELSE ascii(c) - 48 END for c in string_split({moved}, '')]), lambda a, x: CASE WHEN x >= 110 - 10 THEN (a * 100 + x - 100) % 97 ELSE (a * 10 + x) % 97 END) = 1"
    checks = {
        "ip": "list_bool_and([len(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) <= 255 for p in string_split(m.found, '.')])",
        "card": f"len({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"len({digits}) BETWEEN 8 AND 15",
        "iban": f"len(replace(m.found, ' ', '')) BETWEEN 15 AND 34 AND {rest}",
    }
    parts = []
    for kind, pattern in PLAIN.items():
        score = f"{SCORE[kind]} + CASE WHEN regexp_matches(lower(substr(t, greatest(m.s - {NEAR}, 0) + 1, least(m.s, {NEAR})) || chr(10) || substr(t, m.e + 1, {NEAR})), '{CONTEXT[kind]}') THEN {ADDED} ELSE 0 END"
        parts.append(f"""
  SELECT doc_id, {list(PLAIN).index(kind)} AS k, '{kind}' AS kind, m.s, m.e, {score} AS score FROM (
    SELECT doc_id, t, unnest(list_transform(found, lambda f, i: struct_pack(found := f,
             s := CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: len(x))), 0) AS INT),
             e := CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + list_sum(list_transform(found[1:i], lambda x: len(x))) AS INT)))) AS m
    FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM d)
  ) WHERE {checks.get(kind, 'true')}""")
    counts = ",\n  ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)
    one = "string_agg(kind || ':' || s || ':' || e{}, ',' ORDER BY k, s)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counts},
  {one.format('')} FILTER (k < {len(BASE)}) AS base, {one.format('')} AS spans, {one.format(" || ':' || score")} AS scores
  FROM s WHERE score >= {KEEP} GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE = _oracle()
