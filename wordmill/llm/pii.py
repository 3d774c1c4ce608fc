"""Personal data in texts, with column functions only: patterns propose, checksums confirm, context words score.

Kinds: email, ip (four parts of at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits) and, beyond these,
iban (ISO 13616: country, check digits, 11 to 30 more characters, mod 97). Matches of a kind are leftmost and do
not overlap; one that fails its check is dropped and not tried again. Spans are code points, end exclusive.

An iban has the length of its country; only where no such length ends a run of letters and digits is it as long as the pattern goes.
One that fails its check does not hide another that begins in it. The SQL has the plain pattern, so these cases are covered by the
tests alone.

The patterns name the same matches as the plain ones in ``PLAIN``, written so that no text makes them recurse or run in
quadratic time: possessive repeats, and starts only where a run of characters begins or the last match ended.

Defined cases: a null or empty text has no spans; spans of different kinds may overlap and are all reported, by start
and then by kind in the order above; ``redact`` merges overlapping spans under the name of the first one. Texts of any length
are walked whole, in blocks of matches; repeated rows each get their own result, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import fresh

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

#: The patterns as they are defined.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}",
}
#: Countries by the length of their iban (registry of ISO 13616).
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
SIZED = "|".join(f"(?:{'|'.join(codes.split())})[0-9][0-9](?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in LENGTHS.items())
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": PLAIN["phone"],
    "iban": rf"(?<![A-Za-z0-9])(?=((?:{SIZED})(?![A-Za-z0-9])|{PLAIN['iban']}))",
}
#: A text without one of these has no span of the kind.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9]",
}
#: Words that make a kind likelier when they stand in the ``REACH`` code points before a span.
CONTEXT = {
    "email": "mail|contact|write to|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
REACH = 40
#: Score of a confirmed span without and with a context word nearby; checksums weigh more than shapes.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.8), "card": (0.7, 0.95), "phone": (0.5, 0.85), "iban": (0.9, 1.0)}

SPAN = "struct<start:int,kind:int,end:int,hit:string,score:double>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, pair: Column) -> Column:
        d = pair["d"] * F.when(pair["i"] % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    figures = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("d"), i.alias("i")))
    return F.aggregate(figures, F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether country, check digits and account number give 1 modulo 97."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).when(value >= 48, (rest * 10 + value - 48) % 97).otherwise(rest)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, hit: Column, before: Column) -> Column:
    """The check that a proposed match must pass; ``before`` is the text between it and the match before."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(hit)).between(12, 19) & luhn(digits(hit))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    if kind == "iban":
        return ~F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") & mod97(hit)
    return F.lit(True)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(items: Column) -> Column:
    """An array cut into about as many blocks as a block has items.

    Each step of a walk copies what it carries, so it carries the results of its block alone: n to the power of 1.5 in place of n squared.
    """

    def cut(all_: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(all_))).cast("int"))
        last = F.floor((F.size(all_) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(all_, b * size + 1, size))

    return bound(items, cut)


def spans(text: Column, kind: str) -> Column:
    """Confirmed spans (start, kind number, end, hit, score) of one kind."""
    inner = kind == "iban"  # matches of no width, each with what begins there; a blank ahead, since none may stand at the start
    source = F.concat(F.lit(" "), text) if inner else text
    parts = F.zip_with(
        F.split(source, FAST[kind], -1),
        F.regexp_extract_all(source, F.lit(FAST[kind]), F.lit(int(inner))),
        lambda piece, hit: F.struct(piece.alias("piece"), hit.alias("hit")),
    )
    number = KINDS.index(kind)
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    low, high = SCORES[kind]

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["piece"])
        near = F.lower(F.right(part["piece"], F.lit(REACH))).rlike(f"(?:^|[^a-z])(?:{CONTEXT[kind]})(?:[^a-z]|$)")
        found = F.struct(
            start.alias("start"), F.lit(number).alias("kind"), (start + F.length(part["hit"])).alias("end"),
            part["hit"].alias("hit"), F.when(near, high).otherwise(low).alias("score"),
        )
        good = part["hit"].isNotNull() & confirmed(kind, part["hit"], part["piece"])
        if inner:
            good = good & (acc["to"] <= start)
        return F.struct(
            (start if inner else start + F.coalesce(F.length(part["hit"]), F.lit(0))).alias("at"),
            F.when(good, found["end"]).otherwise(acc["to"]).alias("to"),
            F.when(good, F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    def block(acc: Column, part: Column) -> Column:
        walked = F.aggregate(part, F.struct(acc["at"].alias("at"), acc["to"].alias("to"), none.alias("out")), step)
        return bound(walked, lambda w: F.struct(w["at"].alias("at"), w["to"].alias("to"), F.array_append(acc["done"], w["out"]).alias("done")))

    begin = F.struct(F.lit(-1 if inner else 0).alias("at"), F.lit(0).alias("to"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("done"))
    walked = F.aggregate(blocks(parts), begin, block, lambda acc: F.flatten(acc["done"]))
    return F.when(F.coalesce(text.rlike(NEEDS[kind]), F.lit(False)), walked).otherwise(none)


def find(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """The rows with a column of their spans (start, kind number, end, hit, score), by start and kind."""
    return docs.withColumn(to, F.array_sort(F.concat(*[spans(F.col(text), kind) for kind in KINDS])))


def kind_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), number + 1)


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets; a null text stays null."""
    [spans] = fresh(docs, "_pii")
    found = find(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), text, spans)

    body = F.col(f"`{text}`")

    def step(acc: Column, s: Column) -> Column:
        part = F.substr(acc["chunk"], acc["at"] - acc["base"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["base"].alias("base"), acc["chunk"].alias("chunk"),
            F.when(s["start"] >= acc["at"], F.array_append(acc["out"], F.concat(part, F.lit("<"), kind_name(s["kind"]), F.lit(">"))))
            .otherwise(acc["out"]).alias("out"),
        )

    none = F.expr("cast(array() as array<string>)")

    def block(acc: Column, part: Column) -> Column:
        """The walk over one block of spans, on the stretch of the text that they lie in."""
        chunk = F.substr(body, acc["at"] + 1, F.greatest(F.array_max(part["end"]) - acc["at"], F.lit(0)))
        begin = F.struct(acc["at"].alias("at"), acc["at"].alias("base"), chunk.alias("chunk"), none.alias("out"))
        return bound(
            F.aggregate(part, begin, step),
            lambda w: F.struct(w["at"].alias("at"), F.array_append(acc["done"], F.array_join(w["out"], "")).alias("done")),
        )

    clean = F.aggregate(
        blocks(F.col(spans)), F.struct(F.lit(0).alias("at"), none.alias("done")), block,
        lambda acc: F.concat(F.array_join(acc["done"], ""), F.substr(body, acc["at"] + 1)),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body)).drop(spans)


def _is(number: int) -> Callable[[Column], Column]:
    return lambda kind: kind == number


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: counts of the base kinds, digest of their spans, all spans, all scores."""
    found = find(docs.select(F.col(key), F.col(text)), text)
    base = F.filter("pii", lambda s: s["kind"] < len(BASE))
    kinds = F.transform("pii", lambda s: s["kind"])
    count = [F.size(F.filter(kinds, _is(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    score = F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select(key, *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), score.alias("scores"))


def _sql() -> str:
    def walked(kind: str) -> str:
        return f"""
            SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, p, h, {KINDS.index(kind)} AS kind FROM (
                SELECT doc_id, regexp_split_to_array(t, '{PLAIN[kind]}') AS p, regexp_extract_all(t, '{PLAIN[kind]}') AS h FROM docs)"""

    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0",
        "card": "length(num) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(num) + 1), lambda j: CASE WHEN j % 2 = 1 THEN num[-j]::INT WHEN num[-j]::INT > 4 THEN num[-j]::INT * 2 - 9 ELSE num[-j]::INT * 2 END)) % 10 = 0",
        "phone": "length(num) BETWEEN 9 AND 15",
        "iban": "NOT regexp_matches(right(p[i], 1), '[A-Za-z0-9]') AND list_aggregate(list_transform(range(1, length(code) + 1), lambda j: 1), 'sum') > 0 AND (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(code, ''), lambda c: (CASE WHEN ascii(c) >= 65 THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END)::BIGINT)), lambda r, c: CASE WHEN c >= 1000 THEN (r * 100 + c - 1000) % 97 ELSE (r * 10 + c) % 97 END)) = 1",
    }
    near = " ".join(f"WHEN kind = {i} AND regexp_matches(lower(right(p[i], {REACH})), '(?:^|[^a-z])(?:{CONTEXT[k]})(?:[^a-z]|$)') THEN {round(SCORES[k][1] * 100)}" for i, k in enumerate(KINDS))
    else_ = " ".join(f"WHEN kind = {i} THEN {round(SCORES[k][0] * 100)}" for i, k in enumerate(KINDS))
    good = " ".join(f"WHEN kind = {i} THEN {checks[k]}" for i, k in enumerate(KINDS))
    names = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        hits AS ({" UNION ALL ".join(walked(k) for k in KINDS)}),
        placed AS (
            SELECT *, h[i] AS hit, regexp_replace(h[i], '[^0-9]', '', 'g') AS num,
                substr(replace(h[i], ' ', ''), 5) || left(replace(h[i], ' ', ''), 4) AS code,
                (length(array_to_string(p[1:i], '')) + length(array_to_string(h[1:i - 1], '')))::BIGINT AS start
            FROM hits),
        kept AS (
            SELECT doc_id, kind, start, CASE kind {names} END || ':' || start || ':' || (start + length(hit)) AS span,
                CASE {near} {else_} END AS score
            FROM placed WHERE CASE {good} END),
        sums AS (
            SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE))},
                coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}), '') AS base,
                string_agg(span, ',' ORDER BY start, kind) AS spans, string_agg(score::VARCHAR, ',' ORDER BY start, kind) AS scores
            FROM kept GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
            coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
        FROM docs d LEFT JOIN sums USING (doc_id)"""


SQL = _sql()
