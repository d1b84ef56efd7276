"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, checksum validators (Luhn for cards, mod-97 for account numbers) and range
checks confirm them, and context words near a span, whole ones, adjust its score. The score says how likely a span is personal data; every confirmed span is returned, whatever its score. Offsets count code points, ends are exclusive.

A kind's matches and the gaps between them come from the same expression, so their lengths add up to the offsets without a
row-wise function. The expressions are written so that each takes time linear in the text: runs are
possessive, and a run that cannot match is not tried again from its middle.

Defined results: a null text is the empty one, with no spans and the digest of the empty string; repeated rows come back as often
as they went in; an empty table gives an empty one; only the id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The kinds in their order, what proposes them (for Spark; for SQL), the score of a confirmed span,
# and the words that raise it.
LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", rf"{LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 80, "e-?mail|mail|contact|write|reach"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 50, "ip|host|server|address|login"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9])+", 70, "card|visa|mastercard|amex|credit|debit|pay|paid|payment"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 50, "phone|telephone|tel|call|mobile|cell|fax"),
    "iban": (r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z_])", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 90, "iban|account|bank|transfer"),
}
BASE = ("email", "ip", "card", "phone")
BEFORE, AFTER, RAISE = 40, 20, 10
RARE_SIGN = {"email": "@", "ip": ".", "phone": "+"}


def _whole(words: str) -> str:
    """A pattern for these words, or their plurals, between characters that are no letters a-z."""
    return f"(^|[^a-z])({words})s?([^a-z]|$)"


def _running(lengths: str) -> str:
    """SQL for the running totals of an array, in blocks of about the root of its size, so that long arrays stay cheap."""
    add = "aggregate({}, struct(0 AS t, cast(array() AS array<int>) AS a), (s, x) -> struct(s.t + x AS t, array_append(s.a, s.t + x) AS a))"
    blocks = f"transform(sequence(0, size({lengths}) - 1, cast(ceil(sqrt(size({lengths}))) AS int)), s -> slice({lengths}, s + 1, cast(ceil(sqrt(size({lengths}))) AS int)))"
    within = f"transform({blocks}, w -> {add.format('w')})"
    return f"transform(array({within}), r -> flatten(zip_with(r, {add.format('transform(r, w -> w.t)')}.a, (w, t) -> transform(w.a, x -> x + t - w.t))))[0]"


def _confirmed(kind: str) -> str:
    """SQL for whether the match ``x.h`` of a kind holds."""
    digits = "regexp_replace(x.h, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(x.h, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 AND cast(concat('0', right(regexp_replace(p, '^0+', ''), 3)) AS int) <= 255)"
    if kind == "card":
        return f"length({digits}) BETWEEN 16 AND 19 AND luhn_check({digits})"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    if kind == "iban":
        bare = "replace(x.h, ' ', '')"
        turned = f"split(concat(substring({bare}, 5), substring({bare}, 1, 4)), '')"
        step = "(r, c) -> if(c BETWEEN '0' AND '9', r * 10 + cast(c AS int), r * 100 + ascii(c) - 55) % 97"
        return f"length({bare}) BETWEEN 15 AND 34 AND aggregate(filter({turned}, c -> c <> ''), 0, {step.replace('cast(c AS int)', '(ascii(c) - 48)')}) = 1"
    return "true"


def find_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and an array ``<kind>`` of ``(start, end, score, value)`` for each kind, confirmed spans only, by start."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    none = "cast(array() AS array<struct<start:int,end:int,score:int,value:string>>)"
    for kind, (found, _, score, words) in KINDS.items():
        pattern = F.lit(found)
        hits = F.regexp_extract_all("text", pattern, F.lit(0))
        if kind in RARE_SIGN:
            hits = F.when(F.contains("text", F.lit(RARE_SIGN[kind])), hits)
        rows = rows.withColumn("hits", hits)
        rows = rows.withColumn("gaps", F.when(F.size(F.coalesce("hits", F.array())) > 0, F.split("text", found, -1)))
        around = f"zip_with(slice(gaps, 1, size(hits)), slice(gaps, 2, size(hits)), (g, a) -> struct(length(g) AS n, lower(concat(right(g, {BEFORE}), '|', left(a, {AFTER}))) AS near))"
        pairs = f"zip_with(hits, {around}, (h, g) -> struct(h, g.n + length(h) AS n, g.near AS near))"
        rows = rows.withColumn("pairs", F.expr(f"if(gaps IS NULL, NULL, {pairs})"))
        rows = rows.withColumn("lens", F.expr("transform(pairs, x -> x.n)"))
        rows = rows.withColumn("ends", F.expr(f"if(pairs IS NULL, NULL, {_running('lens')})"))
        # Arrays meet in zip_with, not by index: an index would have its array made anew for every element.
        whole = "zip_with(pairs, ends, (x, e) -> struct(x.h, x.near, e AS end))"
        spans = f"transform(filter({whole}, x -> {_confirmed(kind)}), x -> struct(x.end - length(x.h) AS start, x.end, {score} + if(x.near RLIKE '{_whole(words)}', {RAISE}, 0) AS score, x.h AS value))"
        rows = rows.withColumn(kind, F.expr(f"coalesce(if(pairs IS NULL, NULL, {spans}), {none})")).drop("hits", "gaps", "pairs", "lens", "ends")
    return rows.drop("text")


def _joined(kinds: tuple[str, ...], what: str) -> Column:
    return F.expr(f"array_join(concat({', '.join(f'transform({k}, x -> {what.format(k=k)})' for k in kinds)}), ',')")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    place = "concat('{k}:', x.start, ':', x.end)"
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(BASE, place), 256).alias("base_sha256"),
        _joined(tuple(KINDS), place).alias("spans"),
        F.size("iban").cast("long").alias("n_iban"),
        _joined(tuple(KINDS), "cast(x.score AS string)").alias("scores"),
    )


def _sql_confirmed(kind: str) -> str:
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    if kind == "ip":
        return "len(list_filter(string_split(h, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || right(ltrim(p, '0'), 3))::INT > 255)) = 0"
    if kind == "card":
        twice = f"substr(reverse({digits}), i, 1)::INT * 2"
        luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i, 1)::INT WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END)) % 10 = 0"
        return f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    if kind == "iban":
        bare = "replace(h, ' ', '')"
        turned = f"(substr({bare}, 5) || left({bare}, 4))"
        value = f"list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN ascii(substr({turned}, i, 1)) < 58 THEN ascii(substr({turned}, i, 1)) - 48 ELSE ascii(substr({turned}, i, 1)) - 55 END)"
        return f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, {value}), lambda a, b: CASE WHEN b < 10 THEN a * 10 + b ELSE a * 100 + b END % 97) = 1"
    return "true"


def _op9_sql() -> str:
    parts = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for kind, (_, found, score, words) in KINDS.items():
        parts += [
            f"a_{kind} AS (SELECT r, unnest(regexp_extract_all(text, '{found}')) AS h, unnest(regexp_split_to_array(text, '{found}')) AS g, unnest(range(1, len(regexp_split_to_array(text, '{found}')) + 1)) AS i FROM d)",
            f"b_{kind} AS (SELECT r, h, sum(length(g) + length(h)) OVER (PARTITION BY r ORDER BY i) AS stop, lower(right(g, {BEFORE}) || '|' || left(lead(g) OVER (PARTITION BY r ORDER BY i), {AFTER})) AS near FROM a_{kind})",
            f"c_{kind} AS (SELECT r, count(*) AS n, string_agg('{kind}:' || (stop - length(h))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop) AS p, string_agg(({score} + CASE WHEN regexp_matches(near, '{_whole(words)}') THEN {RAISE} ELSE 0 END)::VARCHAR, ',' ORDER BY stop) AS s FROM b_{kind} WHERE h IS NOT NULL AND {_sql_confirmed(kind)} GROUP BY r)",
        ]
    joined = lambda what, kinds: f"concat_ws(',', {', '.join(f'c_{k}.{what}' for k in kinds)})"
    counts = ", ".join(f"coalesce(c_{k}.n, 0)::BIGINT AS n_{k}" for k in KINDS)
    tables = " ".join(f"LEFT JOIN c_{k} ON c_{k}.r = d.r" for k in KINDS)
    return f"WITH {', '.join(parts)} SELECT doc_id, {counts}, sha256({joined('p', BASE)}) AS base_sha256, {joined('p', KINDS)} AS spans, {joined('s', KINDS)} AS scores FROM d {tables}"


OP9_SQL = _op9_sql()
