"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Spark expressions only.

Positions come from the pattern engine itself: every match is put between marks, the text is split at the marks, and a running
length gives start and end in code points (end exclusive). Characters of the text that equal a mark are first exchanged for
another single character that no pattern accepts, so positions stay. A match that fails its check is dropped, with no retry
inside it. Card groups and the labels of a mail address are made one run first (a separator between digits, a dot between label
characters becomes a mark), so that no pattern repeats a group: the engine then needs no recursion however long a run is.

Kinds: email; ip (parts at most 255); card (14-19 digits, Luhn); phone (10-15 digits); iban (ISO 13616, mod 97).
Score: a base per kind, more for a passed checksum, more for a context word within 40 characters before the match.

Edge cases: a null or empty text has no spans. Kinds do not exclude each other, so spans may overlap; order is start, then
kind as listed above. Rows are independent: repeated rows, ties and empty tables need no rule. Columns other than the
id and the text are not read. Very long texts are one expression per row; the span list of a text is built by appending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, JOINER, OTHER = "\u0001", "\u0002", "�"
LOCAL, LABEL = f"[{JOINER}A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# What becomes a JOINER before the pattern is tried: one character for one.
JOINED = {"email": rf"(?<={LABEL})\.(?={LABEL})", "card": r"(?<=[0-9])[\x20-](?=[0-9])"}
# Possessive quantifiers and the look-behind only spare hopeless attempts; the matches are those of the plain patterns.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++{JOINER}[{JOINER}{LABEL[1:]}*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{JOINER}])[0-9][0-9{JOINER}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
KINDS = tuple(PATTERNS)
BASE_KINDS = KINDS[:4]
NEEDS = {"email": "@", "ip": ".", "phone": "+"}  # a character without which there is no match
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|payment",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|account|bank|konto",
}
NEAR = 40  # characters before a match that are searched for context words
SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,score:double>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Is the digit string a Luhn number."""

    def worth(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Does the account number leave 1 when its letters stand for 10 to 35 and its first four characters go last."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        number = digits(found)
        return F.length(number).between(14, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(found)).between(10, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind; `text` holds no marks."""
    source = F.regexp_replace(text, JOINED[kind], JOINER) if kind in JOINED else text
    marked = F.regexp_replace(source, PATTERNS[kind], f"{MARK}$0{MARK}")
    if kind in NEEDS:
        marked = F.when(F.contains(text, F.lit(NEEDS[kind])), marked).otherwise("")
    start = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("hit"), F.lit("").alias("before"),
        F.expr("cast(array() as array<struct<start:int,stop:int,found:string,before:string>>)").alias("spans"),
    )

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("stop"), part.alias("found"), acc["before"].alias("before"))
        return F.struct(
            end.alias("at"),
            (~acc["hit"]).alias("hit"),
            F.right(part, F.lit(NEAR)).alias("before"),
            F.when(acc["hit"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    found = F.aggregate(F.split(marked, MARK), start, step, lambda acc: acc["spans"])
    near = lambda s: F.when(F.lower(s["before"]).rlike(CONTEXT[kind]), 0.2).otherwise(0.0)
    return F.transform(
        F.filter(found, lambda s: confirmed(kind, s["found"])),
        lambda s: F.struct(
            s["start"], F.lit(KINDS.index(kind)).alias("rank"), s["stop"], F.lit(kind).alias("kind"), (F.lit(SCORES[kind]) + near(s)).alias("score")
        ),
    )


def spans(text: Column) -> Column:
    """All spans of a text as array<struct<start, rank, stop, kind, score>>, by start, then kind."""
    plain = F.translate(F.coalesce(text, F.lit("")), MARK + JOINER, OTHER * 2)
    return F.array_sort(F.concat(*(kind_spans(plain, kind) for kind in KINDS)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row."""
    return docs.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col)).alias("spans"))


def masked(text: Column, found: Column, least: float = 0.5) -> Column:
    """The text with every span of a sufficient score replaced by <KIND>; of overlapping spans the first, then longest, stays."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        took = F.struct(s["stop"].alias("at"), F.concat(acc["out"], between, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        hidden = F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["score"] >= least) & (s["start"] >= acc["at"]), took).when(s["score"] >= least, hidden).otherwise(acc)

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data masked and n_chars, where there is such a column, counted anew; texts without any stay as they are,
    nulls too."""
    own = "spans"
    while own in docs.columns:
        own += "_"
    found = F.col(own)
    changes = {"text": F.when(F.size(found) > 0, masked(F.col("text"), found)).otherwise(F.col("text"))}
    changed = docs.withColumn(own, spans(F.col("text"))).withColumns(changes)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.drop(own)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(of, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    only = r"regexp_replace({}, '[^0-9]', '', 'g')"
    number = only.format("found")
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(found, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"length({number}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length({number})), lambda i: "
        f"CASE WHEN i % 2 = 0 THEN CAST({number}[length({number}) - i] AS INT) ELSE (CAST({number}[length({number}) - i] AS INT) * 2) // 10 "
        f"+ (CAST({number}[length({number}) - i] AS INT) * 2) % 10 END)) % 10 = 0",
        "phone": f"length({number}) BETWEEN 10 AND 15",
    }
    parts = []
    for rank, kind in enumerate(BASE_KINDS):
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(found) AS stop FROM (
  SELECT doc_id, p[i] AS found, list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS start
  FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(t, '({patterns[kind]})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM plain))) q
WHERE {checks[kind]}"""
        )
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in BASE_KINDS)
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')"
    return f"""WITH plain AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(65533)) AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256({listed}) AS base_sha256, {listed} AS spans
FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


#: No account number occurs in the driver's tables, so the twin has the four base kinds; the fifth is tested on its own.
ORACLE_SQL = _sql()
