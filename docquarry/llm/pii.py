"""Personal data in whole texts. DataFrame functions only: no Python, no shuffle.

Regular expressions propose spans, checks confirm them (Luhn for cards, number ranges for addresses, digit counts for
phones, mod-97 for bank accounts, letters and digits together for credentials), and whole words that stand near a span
raise its score. Kinds that are too weak on their own, such as national numbers, count only with such a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points on either side of a span in which context words are sought, and the score from which a span counts.
NEAR, ACCEPT, BONUS = 40, 0.6, 0.3
#: Neighbouring matches that hold so many code points at least: a match has two or more, a gap between two one or more.
STEPS = NEAR // 2


@dataclass(frozen=True)
class Kind:
    """pattern: what proposes spans. Possessive quantifiers keep long runs linear and off the stack; none changes a match."""

    name: str
    pattern: str
    score: float
    words: str
    base: bool = True
    digits: tuple[int, int] | None = None


# The patterns, number ranges and order of kinds that results are compared by.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "e?mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", 0.9, "card|visa|credit|payment|paid", digits=(16, 19)),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, "phone|call|tel|mobile|fax", digits=(8, 15)),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9_])", 0.8, "iban|account|bank|transfer", base=False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", 0.4, "ssn|social security", base=False),
    Kind("access_key", r"(?<![A-Za-z0-9_])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9_])", 0.7, "aws|access|key|secret", base=False),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0.9, "key|secret", base=False),
    Kind("credential", r"[A-Za-z0-9_]{16,}+", 0.4, "token|secret|password|passwd|pwd|api_key|apikey|api key|bearer", base=False),
)


def _luhn(digits: str) -> str:
    """SQL: the digits' Luhn sum is a multiple of ten."""
    return f"""aggregate(sequence(1, length({digits})), 0, (sum, n) -> sum + CASE
        WHEN n % 2 = 1 THEN cast(substring({digits}, -n, 1) AS int)
        WHEN cast(substring({digits}, -n, 1) AS int) > 4 THEN 2 * cast(substring({digits}, -n, 1) AS int) - 9
        ELSE 2 * cast(substring({digits}, -n, 1) AS int) END) % 10 = 0"""


def _mod97(code: str) -> str:
    """SQL: the account number's remainder is one, with its first four signs at the end and letters as 10 to 35."""
    turned = f"concat(substring({code}, 5), substring({code}, 1, 4))"
    return f"""aggregate(split({turned}, ''), 0, (rem, c) -> CASE WHEN c = '' THEN rem
        WHEN c >= 'A' THEN (rem * 100 + ascii(c) - 55) % 97 ELSE (rem * 10 + ascii(c) - 48) % 97 END) = 1"""


def _holds(kind: Kind, text: str) -> str:
    digits = f"regexp_replace({text}, '[^0-9]', '')"
    if kind.name == "ip":
        return f"forall(split({text}, '[.]'), q -> q rlike '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')"
    if kind.name == "iban":
        return _mod97(f"replace({text}, ' ', '')")
    if kind.name == "ssn":
        return f"NOT {text} rlike '^(000|666|9)|-00-|-0000$'"
    if kind.name == "credential":
        return f"({text} rlike '[0-9]' AND {text} rlike '[A-Za-z]')"
    if kind.digits:
        ends = f"length({digits}) BETWEEN {kind.digits[0]} AND {kind.digits[1]}"
        return f"({ends} AND {_luhn(digits)})" if kind.name == "card" else ends
    return "true"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _beside(f: str, g: str) -> str:
    """SQL: the NEAR code points before span s and after it, with a blank between, in lower case.

    They are put together from the matches f and what lies between, g, so that a long text is not searched from its
    start for each span. A match and the gap behind it have three code points or more, so STEPS of them reach far enough.
    """
    before = f"transform(sequence(greatest(0, s.i - {STEPS}), s.i), k -> concat(CASE WHEN k > 0 THEN right({f}[k - 1], {NEAR}) ELSE '' END, right({g}[k], {NEAR})))"
    after = f"transform(sequence(s.i + 1, least(size({f}), s.i + 1 + {STEPS})), k -> concat(left({g}[k], {NEAR}), CASE WHEN k < size({f}) THEN left({f}[k], {NEAR}) ELSE '' END))"
    return f"lower(concat(right(array_join({before}, ''), {NEAR}), ' ', left(array_join({after}, ''), {NEAR})))"


def _spans(kind: Kind) -> Column:
    """ARRAY<STRUCT<kind, start, end, text, score>> of the confirmed spans, from columns f_<kind> (matches) and g_<kind> (what lies between).

    Offsets are sums of lengths; they run in blocks of 256 so that a text with very many matches stays cheap.
    """
    f, g = f"f_{kind.name}", f"g_{kind.name}"
    parts = f"transform({f}, (m, i) -> named_struct('i', i, 'gap', char_length({g}[i]), 'len', char_length(m)))"
    placed = f"""flatten(transform(sequence(0, (size({f}) - 1) div 256), b -> aggregate(slice(parts, b * 256 + 1, 256),
        named_struct('at', aggregate(slice(parts, 1, b * 256), 0, (a, p) -> a + p.gap + p.len),
                     'out', cast(array() AS array<struct<i:int,start:int,stop:int>>)),
        (a, p) -> named_struct('at', a.at + p.gap + p.len, 'out', array_append(a.out,
            named_struct('i', p.i, 'start', a.at + p.gap, 'stop', a.at + p.gap + p.len))),
        a -> a.out)))"""
    score = f"least(1.0D, {kind.score}D + CASE WHEN {_beside(f, g)} rlike r'{_anchored(kind.words)}' THEN {BONUS}D ELSE 0D END)"
    made = f"""filter(transform(filter({placed}, s -> {_holds(kind, f'{f}[s.i]')}), s -> named_struct('kind', '{kind.name}',
        'start', s.start, 'end', s.stop, 'text', {f}[s.i], 'score', {score})), s -> {str(kind.base).lower()} OR s.score >= {ACCEPT})"""
    empty = "cast(array() AS array<struct<kind:string,start:int,end:int,text:string,score:double>>)"
    whole = f"CASE WHEN size({f}) = 0 THEN {empty} ELSE transform(array({parts}), parts -> {made})[0] END"
    return F.expr(whole)


def _anchored(words: str) -> str:
    """Whole words only, signs and digits beside them allowed: ip in "ip=" or "IP4", not in "shipping"."""
    return f"(^|[^a-z])({words})($|[^a-z])"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, spans for each row: ARRAY<STRUCT<kind, start, end, text, score>> by kind as listed, then start.

    Offsets count code points, the end is exclusive. The score is that of the kind, and BONUS more where one of the kind's
    words stands whole within NEAR code points before or behind the span, whatever else lies there. Base kinds keep every
    confirmed span; the others need a score of ACCEPT. A null text is an empty one and has no spans. Rows that repeat an identifier come out once each, an empty
    table gives an empty result, and no other column is read.
    """
    rows = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    sign = {"email": "contains(body, '@')", "ip": "contains(body, '.')", "phone": "contains(body, '+')", "ssn": "contains(body, '-')", "access_key": "body rlike 'A[KS]IA'",
            "private_key": "contains(body, 'PRIVATE KEY')", "credential": f"lower(body) rlike '{KINDS[-1].words}'"}
    none = "cast(array() AS array<string>)"
    matches = [F.expr(f"CASE WHEN {sign.get(k.name, 'true')} THEN regexp_extract_all(body, {_quoted(k.pattern)}, 0) ELSE {none} END").alias(f"f_{k.name}") for k in KINDS]
    found = rows.select("doc", "body", *matches)
    gaps = [F.expr(f"CASE WHEN size(f_{k.name}) > 0 THEN split(body, {_quoted(k.pattern)}, -1) ELSE {none} END").alias(f"g_{k.name}") for k in KINDS]
    found = found.select("doc", *(f"f_{k.name}" for k in KINDS), *gaps)
    return found.select("doc", *(_spans(k).alias(k.name) for k in KINDS)).select("doc", F.concat(*(F.col(k.name) for k in KINDS)).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each confirmed span of the base kinds in text_col replaced by its kind in brackets; null texts stay null."""
    kinds = [k for k in KINDS if k.base]
    body = f"`{text_col}`"
    out = df
    for k in kinds:
        p = _quoted(k.pattern)
        pieces = f"""array_join(transform(split({body}, {p}, -1), (gap, i) -> concat(gap, CASE
            WHEN i >= size(m) THEN '' WHEN {_holds(k, 'm[i]')} THEN '[{k.name.upper()}]' ELSE m[i] END)), '')"""
        out = out.withColumn(text_col, F.expr(f"transform(array(regexp_extract_all({body}, {p}, 0)), m -> CASE WHEN size(m) = 0 THEN {body} ELSE {pieces} END)[0]"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    base = [k.name for k in KINDS if k.base]
    is_base = " OR ".join(f"s.kind = '{k}'" for k in base)
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in base]
    return found.select(F.col("doc").alias("doc_id"), *counts, F.sha2(F.expr(joined.format(f"filter(spans, s -> {is_base})")), 256).alias("base_sha256"),
                        F.expr(joined.format("spans")).alias("spans"), F.expr("array_join(transform(spans, s -> cast(s.score AS decimal(3, 2))), ',')").alias("scores"), F.size("spans").cast("long").alias("n_spans"))


def _oracle() -> str:
    """The same in SQL of a linear-time engine: no look-around, word boundaries instead, greedy quantifiers."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "access_key": r"\bA[KS]IA[A-Z0-9]{16}\b", "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "credential": r"[A-Za-z0-9_]{16,}",
    }
    digits = "regexp_replace(s.x, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda n: CASE WHEN n % 2 = 1 THEN substr({digits}, -n, 1)::INT
      WHEN substr({digits}, -n, 1)::INT > 4 THEN 2 * substr({digits}, -n, 1)::INT - 9 ELSE 2 * substr({digits}, -n, 1)::INT END)) % 10 = 0"""
    code = "replace(s.x, ' ', '')"
    signs = f"string_split(substr({code}, 5) || substr({code}, 1, 4), '')"
    mod97 = f"list_reduce(flatten(list_transform({signs}, lambda c: CASE WHEN c >= 'A' THEN [(ascii(c) - 55) // 10, (ascii(c) - 55) % 10] ELSE [c::INT] END)), lambda a, b: (a * 10 + b) % 97) = 1"
    holds = {
        "email": "true", "ip": "len(list_filter(string_split(s.x, '.'), lambda q: length(ltrim(q, '0')) > 3 OR coalesce(try_cast(q AS HUGEINT), 999) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15", "iban": mod97, "ssn": "NOT regexp_matches(s.x, '^(000|666|9)|-00-|-0000$')",
        "access_key": "true", "private_key": "true", "credential": "regexp_matches(s.x, '[0-9]') AND regexp_matches(s.x, '[A-Za-z]')",
    }
    found, kept = [], []
    for kind in KINDS:
        k = kind.name
        found.append(f"""list_transform(range(len(m_{k})), lambda i: {{'x': m_{k}[i + 1],
          'a': list_sum(list_transform(g_{k}[1:i + 1], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m_{k}[1:i], lambda x: length(x))), 0)::BIGINT}}) AS s_{k}""")
        near = f"lower(substr(t, greatest(s.a - {NEAR}, 0) + 1, least(s.a, {NEAR})) || ' ' || substr(t, s.a + length(s.x) + 1, {NEAR}))"
        score = f"least(1.00, {kind.score:.2f} + CASE WHEN regexp_matches({near}, '{_anchored(kind.words)}') THEN {BONUS:.2f} ELSE 0.00 END)::DECIMAL(3, 2)"
        scored = f"list_transform(list_filter(s_{k}, lambda s: {holds[k]}), lambda s: {{'s': '{k}:' || s.a || ':' || (s.a + length(s.x)), 'p': {score}}})"
        kept.append(f"{scored if kind.base else f'list_filter({scored}, lambda s: s.p >= {ACCEPT})'} AS v_{k}")
    cuts = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in plain.items())
    base, every = " || ".join(f"v_{k.name}" for k in KINDS if k.base), " || ".join(f"v_{k}" for k in plain)
    counts = ", ".join(f"len(v_{k.name})::BIGINT AS n_{k.name}" for k in KINDS if k.base)
    joined = "array_to_string(list_transform({}, lambda s: s.{}), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, t, {cuts} FROM d), f AS (SELECT doc_id, t, {", ".join(found)} FROM c),
     v AS (SELECT doc_id, {", ".join(kept)} FROM f)
     SELECT doc_id, {counts}, sha256({joined.format(base, "s")}) AS base_sha256, {joined.format(every, "s")} AS spans, {joined.format(every, "p")} AS scores, len({every})::BIGINT AS n_spans FROM v"""


ORACLE = _oracle()
